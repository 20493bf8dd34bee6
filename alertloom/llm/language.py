"""Language identification by prediction by partial matching over bytes.

Each language has a tree of byte contexts of order 0 to 3, counted on sample texts and then frozen. A text's code
length under a language is the sum over its bytes of -log2 p(byte | context), with method C escapes: in a context seen
n times with d different bytes, a byte seen c times has probability c / (n + d); any other escapes with probability
d / (n + d) to the next shorter context, and from the empty one to a uniform byte. Unseen contexts escape for free.
The language with the shortest code is predicted; the score is its share of 2 ** -length over all languages.

Bytes: A-Z and the Latin-1 capitals are lower-cased, every run of ASCII bytes that are no letters is one gap, and a
text begins after three gaps. The trees of all languages are kept together: a row of code lengths, escapes included,
for each (context, byte) that any language has seen, found by two array lookups. Fitting reads at most SAMPLE texts of
each language, the first by a hash of the id, whole.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window as W, functions as F

from alertloom.llm import texts as T
from alertloom.session import durable

SAMPLE = 1000
ORDER = 3
UNKNOWN = "und"

_LETTER = np.zeros(256, bool)
_LETTER[[*range(65, 91), *range(97, 123), *range(128, 256)]] = True


def symbols(chunk: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(symbols, first): text i is symbols[first[i] + ORDER : first[i + 1]], after ORDER gaps (0)."""
    pad = b"\0" * ORDER
    buffer = np.frombuffer(pad + pad.join(chunk), np.uint8)
    starts = np.concatenate([[0], np.cumsum([len(t) + ORDER for t in chunk])])
    low = T.LOWER[buffer]
    capital = (low[1:] >= 0x80) & (low[1:] <= 0x9E) & (low[1:] != 0x97) & (low[:-1] == 0xC3)
    low[1:][capital] += 0x20
    low = np.where(_LETTER[buffer], low, 0)
    keep = np.ones(len(low), bool)
    keep[1:] = (low[1:] > 0) | (low[:-1] > 0)
    for j in range(ORDER):
        keep[starts[:-1] + j] = True
    at = np.concatenate([[0], np.cumsum(keep)])
    return low[keep], at[starts]


def grams(chunk: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(context and byte as one number, first): text i has grams[first[i]:first[i + 1]]."""
    s, first = symbols(chunk)
    wide = s.astype(np.uint32)
    g = (wide[:-3] << 24) | (wide[1:-2] << 16) | (wide[2:-1] << 8) | wide[3:]
    # Those that begin in a text's gaps before the last three symbols of the text before it are not its own.
    inside = np.ones(len(g), bool)
    for j in range(ORDER):
        inside[first[1:-1] - ORDER + j] = False
    return g[inside], first - np.arange(len(first)) * ORDER


@dataclass
class Model:
    languages: list[str]
    code: np.ndarray  # byte to symbol; the last symbol is any byte never seen
    trees: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]  # by order: context, row, lengths, escapes
    floor: np.ndarray  # lengths of an unseen byte in the empty context, by language

    def lengths(self, g: np.ndarray) -> np.ndarray:
        """Code lengths in bits, a row for each gram and a column for each language."""
        out = np.zeros((len(g), len(self.languages)), np.float32)
        left = np.arange(len(g))
        s = [self.code[(g >> np.uint32(8 * j)) & np.uint32(255)] for j in range(ORDER + 1)]  # s[0] is the byte itself
        width = int(self.code.max()) + 1
        for order in range(ORDER, -1, -1):
            context, rows, table, escapes = self.trees[order]
            at = np.zeros(len(left), np.int64)
            for j in range(order, 0, -1):
                at = at * width + s[j][left]
            known = context[at]
            row = rows[known, s[0][left]]
            hit = row >= 0
            out[left[hit]] += table[row[hit]]
            miss = ~hit
            out[left[miss]] += escapes[known[miss]]
            left = left[miss]
            if not len(left):
                return out
        out[left] += 8.0
        return out


def build(counts: dict[str, tuple[np.ndarray, np.ndarray]]) -> Model:
    """Frozen trees from each language's grams and how often it has them."""
    languages = sorted(counts)
    seen = np.zeros(256, bool)
    for g, _ in counts.values():
        for j in range(ORDER + 1):
            seen[np.unique((g >> np.uint32(8 * j)) & np.uint32(255))] = True
    code = np.full(256, int(seen.sum()), np.int64)
    code[seen] = np.arange(int(seen.sum()))
    width = int(seen.sum()) + 1
    trees: list[tuple] = []
    lower: Model | None = None
    for order in range(ORDER + 1):
        # Context and byte as one number, in symbols.
        keyed = []
        for name in languages:
            g, c = counts[name]
            key = np.zeros(len(g), np.int64)
            for j in range(order, -1, -1):
                key = key * width + code[(g >> np.uint32(8 * j)) & np.uint32(255)]
            unique, inverse = np.unique(key, return_inverse=True)
            keyed.append((unique, np.bincount(inverse, c, len(unique))))
        every = np.unique(np.concatenate([k for k, _ in keyed])) if keyed else np.zeros(0, np.int64)
        contexts = np.unique(every // width)
        context = np.full(width**order, len(contexts), np.int32)  # the last row: a context that no language has seen
        context[contexts] = np.arange(len(contexts))
        rows = np.full((len(contexts) + 1, width), -1, np.int32)
        rows[context[every // width], every % width] = np.arange(len(every))
        escapes = np.zeros((len(contexts) + 1, len(languages)), np.float32)
        table = np.zeros((len(every), len(languages)), np.float32)
        for column, (unique, c) in enumerate(keyed):
            at = context[unique // width]
            n = np.bincount(at, c, len(contexts) + 1)
            d = np.bincount(at, minlength=len(contexts) + 1)
            with np.errstate(divide="ignore", invalid="ignore"):
                escapes[:, column] = np.where(n > 0, -np.log2(d / (n + d)), 0.0)
            own = np.searchsorted(every, unique)
            table[own, column] = -np.log2(c / (n + d)[at])
            others = np.setdiff1d(np.arange(len(every)), own)
            shorter = 8.0 if lower is None else _at(lower, every[others], order, width)[:, column]
            table[others, column] = escapes[context[every[others] // width], column] + shorter
        trees.append((context, rows, table, escapes))
        lower = Model(languages, code, trees, np.zeros(0))
    return Model(languages, code, trees, np.full(len(languages), 8.0))


def _at(model: Model, key: np.ndarray, order: int, width: int) -> np.ndarray:
    """Code lengths of (context, byte) numbers of `order`, in the trees below it."""
    out = np.zeros((len(key), len(model.languages)), np.float32)
    left = np.arange(len(key))
    for below in range(order - 1, -1, -1):
        context, rows, table, escapes = model.trees[below]
        known = context[(key[left] // width) % width**below]
        row = rows[known, key[left] % width]
        hit = row >= 0
        out[left[hit]] += table[row[hit]]
        out[left[~hit]] += escapes[known[~hit]]
        left = left[~hit]
    out[left] += 8.0
    return out


def _counted(chunk: list[bytes]) -> dict[str, pa.Array]:
    """Per text, as the language differs by row."""
    g, first = grams(chunk)
    found = [np.unique(g[a:b], return_counts=True) for a, b in zip(first[:-1], first[1:], strict=True)]
    offsets = pa.array(np.concatenate([[0], np.cumsum([len(u) for u, _ in found])]).astype(np.int32))
    lists = [pa.ListArray.from_arrays(offsets, pa.array(np.concatenate([f[i] for f in found]).astype(np.int64))) for i in (0, 1)]
    return {"gram": lists[0], "times": lists[1]}


def fit(docs: DataFrame, most: int = SAMPLE) -> Model:
    """A model from docs (doc_id, text, lang), of each lang the first `most` by a hash of doc_id; null langs are left out."""
    rows = docs.select("doc_id", "text", "lang").where("lang is not null and text is not null and doc_id is not null")
    first = W.partitionBy("lang").orderBy(F.xxhash64("doc_id"), "doc_id")
    # Ranked by id alone, so that no text is moved but the sample's.
    ids = rows.select("doc_id", "lang").withColumn("rank", F.row_number().over(first)).where(F.col("rank") <= most)
    picked = rows.join(T.small(durable(ids.select("doc_id", "lang").distinct())), ["doc_id", "lang"], "left_semi")
    counted = T.over_texts(picked, "text", _counted, "gram array<long>, times array<long>", ["lang"])
    pairs = counted.select("lang", F.explode(F.arrays_zip("gram", "times")).alias("g")).groupBy("lang", "g.gram")
    got = pairs.agg(F.sum("g.times").alias("times")).toArrow().combine_chunks()
    lang = np.asarray(got["lang"].to_pylist(), object)
    gram, times = got["gram"].to_numpy().astype(np.uint32), got["times"].to_numpy().astype(np.float64)
    return build({str(name): (gram[lang == name], times[lang == name]) for name in set(lang)})


def identified(docs: DataFrame, model: Model) -> DataFrame:
    """docs with lang_pred and lang_score (0 to 1).

    Null texts, texts without a letter, and all texts if the model knows no language are `und` with score 0. Ties go to
    the first language by name. Columns of docs stay, but for earlier ones of the two names, which are replaced.
    """

    def run(chunk: list[bytes]) -> dict[str, pa.Array]:
        lettered = np.array([_has_letter(t) for t in chunk])
        best, score = np.zeros(len(chunk), np.int64), np.zeros(len(chunk))
        if model.languages:
            g, first = grams(chunk)
            each = model.lengths(g).astype(np.float64)
            total = np.stack([T.per_text(np.ascontiguousarray(each[:, c]), first) for c in range(each.shape[1])], axis=1)
            best = total.argmin(axis=1)
            score = 1 / np.exp2(np.maximum(total.min(axis=1)[:, None] - total, -1000)).sum(axis=1)
            lettered &= np.diff(first) > 0
        else:
            lettered[:] = False
        names = [model.languages[b] if ok else UNKNOWN for b, ok in zip(best, lettered, strict=True)]
        return {"lang_pred": pa.array(names, pa.string()), "lang_score": pa.array(np.where(lettered, score, 0.0))}

    docs = docs.drop("lang_pred", "lang_score")
    return T.over_texts(docs, "text", run, "lang_pred string, lang_score double", docs.columns)


def _has_letter(text: bytes) -> bool:
    b = np.frombuffer(text[:4096], np.uint8)
    if (_LETTER[b] & (b < 128)).any():
        return True
    return any(map(str.isalpha, text.decode(errors="replace")))
