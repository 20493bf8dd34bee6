"""Main text of web pages by minimum-cut labelling of their blocks.

A page is cut into blocks: text between block-level tags, with the elements that are open around it. A block's
evidence for content is a log-odds sum of its surroundings (semantic elements, roles, names in class and id) and of its
shape (length, share of links, punctuation), whose weights are fitted by logistic regression on blocks that semantic
elements already label, over at most SAMPLE pages, the first by a hash of the id. Evidence becomes a block's capacity
from the source (content) or to the sink (boilerplate); blocks that follow each other and blocks close in the element
tree are tied by smoothness edges. The minimum cut is the labelling of least cost.

Most pages need little flow: a block whose own capacity is at least the sum of its edges has its label in every
minimum cut, so it is fixed and its edges are added to its neighbours' capacities. Maximum flow solves what is left.
Pages are independent; all work is inside a task, page by page.
"""

from __future__ import annotations

import html
import re
from collections import deque
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from alertloom.llm import texts as T
from alertloom.session import durable

SAMPLE = 500
SAMPLE_ITEMS = 16 << 20  # 8 bytes each
FOLLOW, SIBLING = 0.6, 0.5  # smoothness of consecutive blocks, and of consecutive ones with one parent
TIED, BESIDE = 4.0, 1.0  # smoothness inside a list of short items, and of its ends and the blocks beside it
ITEM_WORDS, ITEM_LINKS = 12, 0.3  # most words of a short item, and the most that is linked of a list that is no menu
MOST_SHAPE = 4.0  # evidence that shape alone can give
UNMARKED = 2.0  # evidence of blocks without any mark, on pages where no element is marked as content

_MARKUP = re.compile(
    r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)"
    r"|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>"
    r"|<(/?)([a-zA-Z][^\s/>]*)([^>]*)(?:>|\Z)",
    re.S,
)
_ATTRIBUTE = re.compile(r"([^\s\"'=<>/]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_NAME = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")

#: Elements of HTML, by what they mean here (fixed values).
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd mark q ruby rb rp rt rtc s samp small span strike strong sub sup time tt u var wbr img br "
    "math mrow mi mn mo ms mtext mspace msup msub msubsup mfrac msqrt mroot mover munder munderover mstyle semantics annotation annotation-xml".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
UNSEEN = frozenset("head title script style noscript template textarea select option iframe object svg canvas audio video map datalist button annotation annotation-xml".split())
VERBATIM = frozenset("script style textarea title iframe noscript".split())
BOILERPLATE = frozenset("nav footer aside form menu dialog fieldset label legend".split())
CONTENT = frozenset("article main".split())
LISTS = frozenset("ul ol dl table".split())
CONTAINER = frozenset("article main section div body html td th li blockquote figure ul ol table nav aside header footer form dd".split())
#: An opening tag on the left closes an open one on the right, up to the next container.
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}}
BAD_NAMES = frozenset(
    "ad ads advert adverts advertisement advertising adsense banner sponsor sponsored promo promotion sidebar side nav navbar navigation menu "
    "breadcrumb breadcrumbs footer header masthead topbar toolbar cookie cookies consent notice notices gdpr alert popup modal overlay comment comments "
    "commentlist reply replies disqus respond form login signup subscribe newsletter share sharing social related recommended widget copyright legal "
    "pagination pager hidden adsbygoogle adbox adslot adverts disclaimer".split()
)
GOOD_NAMES = frozenset("article content main post entry story text body".split())
#: Words after these tell of other elements, as in `page-with-sidebar`.
ABOUT_OTHERS = frozenset("no not has with without hide show".split())
#: Names that end so tell of a state of the page, as in `sidebar-open`.
STATES = frozenset("open opened closed collapsed expanded enabled toggled".split())
#: `hidden` is a name's own meaning alone or after the first words, and before no word for some screens only.
HIDDEN = frozenset("is js u visually".split())
SCREENS = frozenset("xs sm md lg xl xxl phone mobile tablet desktop print".split())
#: First words of names that file an article under something, as in `category-social-media`.
FILED = frozenset("category cat tag tags topic topics format story post type status single section hentry".split())
#: Names for a sidebar that hold one of these are of what surrounds it and the content, as in `content-sidebar-wrap`.
LAYOUTS = frozenset("layout layouts".split())
WRAPS = frozenset("wrap wrapper wrappers container grid row columns group holder".split())
#: Names of places whose article elements are comments and teasers.
OF_OTHERS = frozenset("comment comments commentlist reply replies respond disqus related recommended".split())
#: Second words of names for places around an article, as in `post-comments`.
OWN_PLACES = frozenset("ad ads advert adverts comment comments respond reply replies footer header sidebar nav navigation navbar menu share sharing social related recommended breadcrumb breadcrumbs pagination pager newsletter subscribe copyright".split())
#: Whole class names of articles that are adverts.
ADVERTS = frozenset("ad ads advert adverts advertisement advertising banner sponsor sponsored promo promotion widget adslot adbox".split())
#: Words for what is no text of an article even inside of it.
NEVER = OF_OTHERS | frozenset("ad ads advert adverts advertisement advertising sponsored adslot adbox footer sidebar nav navbar navigation breadcrumb breadcrumbs pagination pager".split())
BAD_ROLES = frozenset("navigation banner contentinfo complementary search form alert dialog alertdialog menu menubar".split())


@dataclass
class Node:
    tag: str
    parent: Node | None
    depth: int
    evidence: float
    known: int  # 1 in an element for content, -1 in one for boilerplate, else 0
    seen: bool
    plain: float = 0.0  # evidence without the marks that only a class or id gave
    firm: bool = False  # in an element for boilerplate by its tag, role or being hidden
    named: frozenset[str] = frozenset()  # bad words of the class names and ids around
    items: Node | None = None  # the innermost list or table around


@dataclass
class Block:
    text: str
    node: Node
    linked: int
    parts: list[str] = field(default_factory=list)


def _is_mark(word: str, own: list[str]) -> bool:
    """Whether a bad word of a name is what the element itself is."""
    if word == "hidden":
        at = own.index(word)
        return HIDDEN.issuperset(own[:at]) and SCREENS.isdisjoint(own[at + 1 :])
    if own[-1] in STATES:
        return False
    if own[0] in FILED and not (own[0] in ("post", "single", "story", "section") and own[1:2] == [word] and word in OWN_PLACES):
        return False
    if word in ("sidebar", "side"):
        after = own[own.index(word) + 1 :]
        both = "content" in own or "article" in own or "page" in after
        return LAYOUTS.isdisjoint(own) and not (both and own[-1] in WRAPS)
    return True


def _names(given: str) -> set[str]:
    """Lower-case words of class names and ids, bad ones only where they are the element's own role.

    Names such as `no-sidebar`, `page-with-menu`, `content-sidebar-wrap` and `overflow-hidden` tell of others.
    """
    found: set[str] = set()
    for name in given.split():
        own = [n.lower() for n in _NAME.findall(name)]
        own = own[: next((i for i, n in enumerate(own) if n in ABOUT_OTHERS), len(own))]
        found.update(n for n in own if n not in BAD_NAMES or _is_mark(n, own))
    return found


def _inside(tag: str, attributes: str, parent: Node | None, inner: bool) -> Node:
    evidence, known = (parent.evidence, parent.known) if parent else (0.0, 0)
    plain, firm, named = (parent.plain, parent.firm, parent.named) if parent else (0.0, False, frozenset())
    seen = (parent.seen if parent else True) and tag not in UNSEEN
    given = {m[1].lower(): m[2] or m[3] or m[4] or "" for m in _ATTRIBUTE.finditer(attributes)} if attributes and not attributes.isspace() else {}
    role = given.get("role", "").lower()
    main = tag == "main" or role == "main"
    if tag in BOILERPLATE or (tag == "header" and known <= 0):
        evidence, known, plain, firm = evidence - 12, -1, plain - 12, True
    elif tag in CONTENT or main:
        if known < 0 and not firm and (main or inner and named.isdisjoint(OF_OTHERS)):
            evidence, known, named = plain, 0, frozenset()  # class names and ids around are of layout
        if known >= 0:
            evidence, known = max(evidence, evidence + 6 if known == 0 else evidence), 1
            plain = evidence
    elif re.fullmatch("h[1-6]", tag):
        evidence, plain = evidence + 1, plain + 1
    if given:
        names = _names(given.get("class", "") + " " + given.get("id", ""))
        if known > 0 and tag != "header":
            names.discard("header")  # the headline's surroundings
        bad = names & BAD_NAMES if tag not in ("body", "html") and not main else frozenset()
        if tag == "article" and known > 0:
            bad &= OF_OTHERS | ADVERTS.intersection(given.get("class", "").lower().split())  # others tell what it is about
        if role in BAD_ROLES:
            evidence, known, plain, firm = evidence - 10, -1, plain - 10, True
        elif bad:
            # Comments, teasers, adverts and the like stay out of the text however surely it is content.
            evidence = min(evidence - 10, -10) if bad & NEVER else evidence - 10
            known, named = -1, named | bad
        elif names & GOOD_NAMES or role in ("main", "article"):
            evidence, plain = evidence + 2, plain + 2
        if "hidden" in given or given.get("aria-hidden") == "true" or "display:none" in given.get("style", "").replace(" ", "").lower():
            evidence, known, plain, firm = evidence - 10, -1, plain - 10, True
    made = Node(tag, parent, parent.depth + 1 if parent else 0, evidence, known, seen, plain, firm, named, parent and parent.items)
    if tag in LISTS:
        made.items = made
    return made


def blocks(page: str) -> list[Block]:
    """Visible blocks with text, in order; references decoded, white space made single spaces.

    A main element is content whatever the class names and ids around it. So is an article, on pages without any other
    element for content, unless the names around it are those of comments or teasers.
    """
    found = _blocks(page, False)
    if any(b.node.known > 0 for b in found) or not any(b.node.named for b in found):
        return found
    return _blocks(page, True)


def _blocks(page: str, inner: bool) -> list[Block]:
    root = node = Node("", None, 0, 0.0, 0, True)
    found: list[Block] = []
    parts: list[str] = []
    links = linked = 0

    def close() -> None:
        nonlocal parts, linked
        text = " ".join(html.unescape("".join(parts)).split()) if parts else ""
        if text:
            found.append(Block(text, holder(), linked))
        parts, linked = [], 0

    def holder() -> Node:
        at = node
        while at.tag in INLINE and at.parent:
            at = at.parent
        return at

    def add(text: str) -> None:
        nonlocal linked
        if text and node.seen:
            parts.append(text)
            if links:
                linked += len(text)

    at, end = 0, len(page)
    while at < end:
        m = _MARKUP.search(page, at)
        if not m:
            add(page[at:])
            break
        add(page[at : m.start()])
        at = m.end()
        tag = (m[2] or m[5] or "").lower()
        if not tag:
            continue
        closing, attributes = m[1] or m[4], m[3] or m[6] or ""
        if tag == "br":
            add(" ")
            continue
        if tag not in INLINE:
            close()
        if closing:
            links = max(0, links - 1) if tag == "a" else links
            up = node
            while up is not root and up.tag != tag:
                if tag in INLINE and up.tag not in INLINE:
                    up = root
                    break
                up = up.parent
            if up is not root:
                node = up.parent
            continue
        if tag in VOID:
            continue
        if tag not in INLINE:
            # Open inline elements and a paragraph end where a block begins; list items and cells end each other.
            ends = CLOSES.get(tag, set()) | {"p"}
            up, last = node, None
            while up is not root and (up.tag not in CONTAINER or up.tag in ends):
                if up.tag in ends:
                    last = up
                up = up.parent
            node = last.parent if last else node
            if last:
                links = 0
        node = _inside(tag, attributes, node, inner)
        links += tag == "a"
        if tag in VERBATIM and not attributes.rstrip().endswith("/"):
            stop = re.compile(rf"</{tag}(?=[\s/>]|\Z)[^>]*(?:>|\Z)", re.I).search(page, at)
            at, node = (stop.end() if stop else end), node.parent
    close()
    return found


def shape(block: Block) -> list[float]:
    text = block.text
    words = text.split(" ")
    n = len(words)
    return [
        1.0,
        np.log1p(n),
        min(1.0, block.linked / max(1, len(text))),
        float(text[-1] in ".!?…\"'”’"),
        min(1.0, (text.count(",") + text.count(".")) / n),
        min(1.0, sum(w[0].isupper() for w in words) / n),
        min(1.0, sum(map(text.count, "|©·»›/")) / n),
    ]


#: Weights of shape when no page of the sample labels any block, in the order above.
PLAIN_SHAPE = np.array([-2.5, 1.0, -5.0, 1.5, 0.5, -1.0, -3.0])


def _distance(a: Node, b: Node) -> int:
    """Steps between two elements in the tree."""
    steps = 0
    while a is not b:
        if a.depth >= b.depth:
            a = a.parent
        else:
            b = b.parent
        steps += 1
    return steps


def edges(found: list[Block]) -> list[tuple[int, int, float]]:
    out = []
    last: dict[int, int] = {}
    for i, block in enumerate(found):
        if i:
            out.append((i - 1, i, FOLLOW / (1 + 0.5 * _distance(found[i - 1].node, block.node))))
        parent = id(block.node.parent)
        if parent in last:
            out.append((last[parent], i, SIBLING))
        last[parent] = i
    return out


def minimum_cut(evidence: list[float], ties: list[tuple[int, int, float]]) -> list[bool]:
    """Which nodes are content in a cut of least cost; evidence > 0 is a capacity from the source, < 0 to the sink.

    Of several such cuts, one with the nodes of evidence 0 and no stronger tie as boilerplate.
    """
    n = len(evidence)
    z = list(evidence)
    near: list[dict[int, float]] = [{} for _ in range(n)]
    for a, b, w in ties:
        near[a][b] = near[a].get(b, 0.0) + w
        near[b][a] = near[b].get(a, 0.0) + w
    label: list[bool | None] = [None] * n
    todo = deque(range(n))
    while todo:
        i = todo.popleft()
        if label[i] is None and abs(z[i]) >= sum(near[i].values()):
            label[i] = z[i] > 0
            for j, w in near[i].items():
                z[j] += w if label[i] else -w
                del near[j][i]
                todo.append(j)
            near[i] = {}
    rest = [i for i in range(n) if label[i] is None]
    if rest:
        content = _flow(rest, z, near)
        for i in rest:
            label[i] = i in content
    return [bool(x) for x in label]


def _flow(nodes: list[int], z: list[float], near: list[dict[int, float]]) -> set[int]:
    """Nodes on the source's side after a maximum flow (Dinic's levels and blocking flows)."""
    source, sink = -1, -2
    room: dict[int, dict[int, float]] = {i: dict(near[i]) for i in nodes} | {source: {}, sink: {}}
    for i in nodes:
        if z[i] > 0:
            room[source][i], room[i][source] = z[i], 0.0
        elif z[i] < 0:
            room[i][sink], room[sink][i] = -z[i], 0.0
    tiny = 1e-9
    while True:
        level, queue = {source: 0}, deque([source])
        while queue:
            a = queue.popleft()
            for b, r in room[a].items():
                if r > tiny and b not in level:
                    level[b] = level[a] + 1
                    queue.append(b)
        if sink not in level:
            return {i for i in level if i >= 0}
        ahead = {a: iter([b for b in room[a] if level.get(b, -1) == level[a] + 1]) for a in level}
        path = [source]
        while path:
            a = path[-1]
            if a == sink:
                least = min(room[x][y] for x, y in zip(path, path[1:], strict=False))
                for x, y in zip(path, path[1:], strict=False):
                    room[x][y] -= least
                    room[y][x] = room[y].get(x, 0.0) + least
                full = next(k for k, (x, y) in enumerate(zip(path, path[1:], strict=False)) if room[x][y] <= tiny)
                path = path[: full + 1]
                continue
            b = next(ahead[a], None)
            while b is not None and room[a][b] <= tiny:
                b = next(ahead[a], None)
            if b is None:
                path.pop()
            else:
                path.append(b)


def short_lists(found: list[Block]) -> list[tuple[int, int]]:
    """Ranges of blocks that are the short items or cells of one list or table which is no menu."""
    out = []
    i = 0
    while i < len(found):
        first, j = found[i].node, i + 1
        while first.items and j < len(found) and found[j].node.items is first.items and (found[j].node.evidence, found[j].node.known) == (first.evidence, first.known):
            j += 1
        own = found[i:j]
        if j - i > 1 and all(b.text.count(" ") < ITEM_WORDS for b in own) and sum(b.linked for b in own) <= ITEM_LINKS * sum(len(b.text) for b in own):
            out.append((i, j))
        i = j
    return out


def _beside(items: Node, block: Block) -> bool:
    """Whether a block lies next to a list, in the same element or on its next level."""
    return block.node is items.parent or block.node.parent is items.parent


def extract(page: str, weights: np.ndarray) -> list[str]:
    """The content blocks of a page, in order.

    The short items of a list or table, such as those of a recipe, have the shape of all of them together, and go together.
    """
    found = blocks(page)
    if not found:
        return []
    unmarked = UNMARKED if not any(b.node.known > 0 for b in found) else 0.0
    evidence = [b.node.evidence + unmarked * (b.node.known == 0) for b in found]
    lists = short_lists(found)
    ties = edges(found)
    together: dict[int, Block] = {}
    for x, y in lists:
        whole = Block(" ".join(b.text for b in found[x:y]), found[x].node, sum(b.linked for b in found[x:y]))
        together |= dict.fromkeys(range(x, y), whole)
        ties += [(i, i + 1, TIED) for i in range(x, y - 1)]
        items = found[x].node.items
        ties += [(i, i + 1, BESIDE) for i, j in ((x - 1, x - 1), (y - 1, y)) if 0 <= j < len(found) and _beside(items, found[j])]
    # Shape is looked at only where it and all ties of a block could change its label.
    shapes: dict[int, float] = {}
    for i, block in enumerate(found):
        if i in together or abs(evidence[i]) <= MOST_SHAPE + 2 * (FOLLOW + SIBLING):
            looked = together.get(i, block)
            if id(looked) not in shapes:
                shapes[id(looked)] = min(MOST_SHAPE, max(-MOST_SHAPE, float(np.dot(shape(looked), weights))))
            evidence[i] += shapes[id(looked)]
    return [b.text for b, good in zip(found, minimum_cut(evidence, ties), strict=True) if good]


def _taught(chunk: list[bytes]) -> dict[str, pa.Array]:
    rows = []
    for page in chunk:
        rows.append([[float(b.node.known > 0), *shape(b)] for b in blocks(page.decode()) if b.node.known])
    return {"rows": pa.array([sum(r, []) for r in rows], pa.list_(pa.float64()))}


def fit(pages: DataFrame, most: int = SAMPLE) -> np.ndarray:
    """Weights of shape, from the blocks that semantic elements label on the sampled pages.

    Of a page_id with several rows the sample has the first html in order; the driver gets at most SAMPLE_ITEMS numbers.
    """
    ids = pages.where("page_id is not null").select("page_id").distinct().orderBy(F.xxhash64("page_id"), "page_id").limit(most)
    rows = pages.select("page_id", "html").join(F.broadcast(ids), "page_id", "left_semi")  # at most `most` ids
    rows = rows.groupBy("page_id").agg(F.min("html").alias("html"))
    taught = T.over_texts(rows, "html", _taught, "rows array<double>", ["page_id"])
    taught = durable(taught.withColumn("_items", F.size("rows")))
    got = T.within(taught, "page_id", "_items", SAMPLE_ITEMS).toArrow()
    width = len(PLAIN_SHAPE) + 1
    data = np.asarray(pa.chunked_array(got["rows"]).combine_chunks().flatten()).reshape(-1, width) if len(got) else np.zeros((0, width))
    data = data[np.lexsort(data.T[::-1])]
    y, x = data[:, 0], data[:, 1:]
    if not 0 < y.sum() < len(y):
        return PLAIN_SHAPE
    share = np.where(y == 1, 0.5 / y.sum(), 0.5 / (1 - y).sum())
    w = np.zeros(width - 1)
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        gradient = x.T @ ((p - y) * share) + 1e-2 * (w - 0.3 * PLAIN_SHAPE)
        w = w - np.linalg.solve((x.T * (p * (1 - p) * share)) @ x + 1e-2 * np.eye(len(w)), gradient)
    return w


def main_text(pages: DataFrame, weights: np.ndarray, keep: list[str]) -> DataFrame:
    """Columns `keep` of pages (html, ...) with `text`, its content blocks joined by empty lines, and `n_chars`.

    Null and empty pages, and those without content, have the empty text. Every row is handled for itself, so repeated
    rows get equal results; columns not in `keep` are left out, whatever their names.
    """

    def run(chunk: list[bytes]) -> dict[str, pa.Array]:
        out = ["\n\n".join(extract(page.decode(), weights)) for page in chunk]
        return {"text": pa.array(out, pa.string()), "n_chars": pa.array(list(map(len, out)), pa.int64())}

    return T.over_texts(pages, "html", run, "text string, n_chars long", keep)
