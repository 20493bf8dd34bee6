"""Packing documents into sequences of at most SEQUENCE tokens.

Tokenizing: a text's ids are those of its words, one after the other, because white space separates words for the
tokenizer and nothing it does looks across it. So each word's ids are made once per worker and kept in a bounded
table. Words of common scripts take a short way (lower case, the tokenizer's own split pattern, then its merge model);
all others go through the whole tokenizer.

Packing: pieces are dealt into groups of about GROUP by a hash, whatever their document, so groups are even and each
fits one task; a group leaves at most a few sequences underfull. In a group, best-fit decreasing makes the first
packing. Then a local search works on the underfull bins: it takes the emptiest and hands its documents on, one or two
for none, one or two of a bin that is at least as full and has room for the difference, so that the sum of squared
fills grows with every step and bins run empty. The step of the largest gain is looked up by the total given back, over
all such choices of all underfull bins. The search ends at the fewest bins that the tokens need, or when a whole pass
over the underfull bins finds no step.
"""

from __future__ import annotations

import heapq
import itertools
import re
import unicodedata
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from alertloom.llm.texts import release_memory, released, ship

SEQUENCE = 2048
GROUP = 16384
END = 0  # id after each document
KEPT_BYTES = 112 << 20  # of the words whose ids a worker keeps, and of the parts of words; the next one starts anew
KEPT_LENGTH = 100  # characters of a word or part that is kept
ENTRY_BYTES = 250  # of a kept word besides its letters and ids

_WORDS = re.compile("[^\x20\x09-\x0d]+").findall
_ODD_SPACE = re.compile("[\x1c-\x1f]").search  # white space to str.split, not to the tokenizer
_FAR = re.compile("[^\x00-ɏ]").search
#: Split pattern and byte letters of the tokenizer file (fixed values).
_SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
_PRINTED = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]


class WordIds(dict):
    """Little-endian uint32 ids of a word, made when first asked for."""

    def __init__(self, path: str):
        import regex
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.split = regex.compile(_SPLIT).findall
        unprinted = [b for b in range(256) if b not in _PRINTED]
        self.letters = {b: chr(b) for b in _PRINTED} | {b: chr(256 + i) for i, b in enumerate(unprinted)}
        self.parts: dict[str, bytes] = {}
        self.words_bytes = self.parts_bytes = 0
        self.most = KEPT_BYTES

    def _part(self, part: str) -> bytes:
        known = self.parts.get(part)
        if known is None:
            spelled = part if part.isascii() and part.isprintable() else "".join(map(self.letters.__getitem__, part.encode()))
            known = b"".join(t.id.to_bytes(4, "little") for t in self.model.tokenize(spelled))
            if len(part) <= KEPT_LENGTH:
                self.parts_bytes += len(part) + len(known) + ENTRY_BYTES
                if self.parts_bytes > self.most:
                    self.parts.clear()
                    self.parts_bytes = 0
                self.parts[part] = known
        return known

    def __missing__(self, word: str) -> bytes:
        if _FAR(word) or "<|" in word or len(word) > 100:
            made = b"".join(i.to_bytes(4, "little") for i in self.tokenizer.encode(word, add_special_tokens=False).ids)
        else:
            made = b"".join(map(self._part, self.split(word.lower())))
        if len(word) <= KEPT_LENGTH:
            self.words_bytes += len(word) + len(made) + ENTRY_BYTES
            if self.words_bytes > self.most:
                self.clear()
                self.words_bytes = 0
            self[word] = made
        return made

    def of(self, text: str) -> bytes:
        # Lower case first, so that a word is kept once; beyond the scripts of the short way, it may depend on context.
        plain = not _FAR(text)
        if plain and not text.isascii():
            text = unicodedata.normalize("NFC", text)
        text = text.lower() if plain else text
        found = text.split() if plain and not _ODD_SPACE(text) else _WORDS(text)
        return b"".join(map(self.__getitem__, found))


_known: dict[str, WordIds] = {}  # of this worker, by tokenizer file


def word_ids(path: str) -> WordIds:
    if path not in _known:
        _known[path] = WordIds(path)
    return _known[path]


def pieces(docs: DataFrame, tokenizer: str, length: int = SEQUENCE, with_ids: bool = False, kept_bytes: int = KEPT_BYTES) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32[, ids]): each document's ids and END, cut every `length` tokens.

    Null texts count as empty: they are END alone. Repeated rows give repeated pieces.
    """
    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids = word_ids(tokenizer)
        ids.most = kept_bytes
        end = END.to_bytes(4, "little")
        for batch in batches:
            for lo in range(0, batch.num_rows, 512):
                part = batch.slice(lo, 512)
                doc, piece, start, size, crc, held = [], [], [], [], [], []
                for doc_id, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                    data = ids.of(text or "") + end
                    for i, at in enumerate(range(0, len(data), 4 * length)):
                        own = data[at : at + 4 * length]
                        doc.append(doc_id), piece.append(i), start.append(at // 4), size.append(len(own) // 4)
                        crc.append(zlib.crc32(own))
                        if with_ids:
                            held.append(np.frombuffer(own, "<u4").astype(np.int32))
                columns = [pa.array(doc, pa.int64()), pa.array(piece, pa.int32()), *(pa.array(x, pa.int64()) for x in (start, size, crc))]
                names = ["doc_id", "piece", "start", "length", "ids_crc32"]
                if with_ids:
                    columns.append(pa.array(held, pa.list_(pa.int32())))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(columns, names=names)

    source = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].cast("string").alias("text"))
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long"
    return source.mapInArrow(released(run), schema + (", ids array<int>" if with_ids else ""))


def best_fit(sizes: np.ndarray, length: int) -> np.ndarray:
    """The bin of each size: largest first, each into the fullest bin that has room."""
    bins = np.zeros(len(sizes), np.int64)
    by_room: list[list[int]] = [[] for _ in range(length + 1)]
    rooms = 0  # bit r: a bin with room r
    n = 0
    for i in np.argsort(-sizes, kind="stable").tolist():
        size = int(sizes[i])
        fitting = rooms >> size
        if fitting:
            room = size + (fitting & -fitting).bit_length() - 1
            b = by_room[room].pop()
            if not by_room[room]:
                rooms &= ~(1 << room)
        else:
            room, b, n = length, n, n + 1
        bins[i] = b
        if room > size:
            by_room[room - size].append(b)
            rooms |= 1 << (room - size)
    return bins


def _sums(own: list[int], most: int) -> list[int]:
    """The distinct totals of none, one and two of these sizes, up to `most`."""
    own = sorted(own)
    kinds = sorted(set(own))
    twice = {2 * a for a, b in itertools.pairwise(own) if a == b}
    found = {0, *kinds, *twice, *(a + b for a, b in itertools.combinations(kinds, 2))}
    return [x for x in found if x <= most]


def _chosen(own: list[int], sizes: list[int], total: int) -> list[int]:
    """At most two of the pieces `own` with this total."""
    if not total:
        return []
    seen: dict[int, int] = {}
    pair = None
    for i in own:
        if sizes[i] == total:
            return [i]
        if pair is None and total - sizes[i] in seen:
            pair = [seen[total - sizes[i]], i]
        seen[sizes[i]] = i
    return pair


class _Partners:
    """Underfull bins by what they can give back: for each total of none, one or two of their pieces, the most room."""

    def __init__(self, length: int):
        self.length = length
        self.reach = np.full(length + 1, -1, np.int64)  # by total given back: the most that can be taken for it
        self.bin = [-1] * (length + 1)
        self.heaps: list[list[tuple[int, int, int]]] = [[] for _ in range(length + 1)]
        self.totals: dict[int, list[int]] = {}
        self.version: dict[int, int] = {}

    def add(self, b: int, room: int, own: list[int]) -> None:
        version = self.version[b] = self.version.get(b, 0) + 1
        self.totals[b] = _sums(own, self.length)
        for total in self.totals[b]:
            heapq.heappush(self.heaps[total], (-room, b, version))
            if total + room > self.reach[total]:
                self.reach[total], self.bin[total] = total + room, b

    def drop(self, b: int) -> None:
        self.version[b] += 1
        for total in self.totals.pop(b):
            if self.bin[total] == b:
                heap = self.heaps[total]
                while heap and heap[0][2] != self.version[heap[0][1]]:
                    heapq.heappop(heap)
                self.reach[total], self.bin[total] = (total - heap[0][0], heap[0][1]) if heap else (-1, -1)

    def best(self, given: np.ndarray) -> tuple[int, int, int] | None:
        """(total given, total given back, bin) of the largest gain for a bin."""
        # The least that any bin gives back for a total is where the running maximum gets to it.
        back = np.searchsorted(np.maximum.accumulate(self.reach), given)
        gain = np.where(back <= self.length, given - back, 0)
        i = int(gain.argmax())
        return (int(given[i]), int(back[i]), self.bin[int(back[i])]) if gain[i] > 0 else None


def local_search(sizes: np.ndarray, bins: np.ndarray, length: int) -> np.ndarray:
    """Empty bins by handing documents of the emptiest underfull bins on to fuller ones, until no step is left."""
    size, bins = sizes.tolist(), bins.tolist()
    n = max(bins, default=-1) + 1
    own: list[list[int]] = [[] for _ in range(n)]
    fill = [0] * n
    for i, b in enumerate(bins):
        own[b].append(i)
        fill[b] += size[i]
    used = sum(f > 0 for f in fill)
    fewest = -(-sum(size) // length)
    helped = True
    while helped and used > fewest:
        helped = False
        partners = _Partners(length)
        turns = [(f, b) for b, f in enumerate(fill) if 0 < f < length]
        heapq.heapify(turns)
        for f, b in turns:
            partners.add(b, length - f, [size[i] for i in own[b]])
        stuck: list[int] = []  # bins without a step that are as full as the next ones, so that those may hand on to them
        while turns and used > fewest:
            f, victim = heapq.heappop(turns)
            if f != fill[victim]:  # it was handed something
                if fill[victim] < length:
                    heapq.heappush(turns, (fill[victim], victim))
                continue
            for b in [b for b in stuck if fill[b] < f]:
                partners.drop(b)
                stuck.remove(b)
            partners.drop(victim)  # all others are at least as full
            while fill[victim]:
                found = partners.best(np.array(_sums([size[i] for i in own[victim]], length)))
                if found is None:
                    break
                given, back, into = found
                helped = True
                give, take = _chosen(own[victim], size, given), _chosen(own[into], size, back)
                own[victim] = [i for i in own[victim] if i not in give] + take
                own[into] = [i for i in own[into] if i not in take] + give
                fill[victim] -= given - back
                fill[into] += given - back
                partners.drop(into)
                again = into in stuck
                if again:
                    stuck.remove(into)
                if fill[into] < length:
                    if again:
                        heapq.heappush(turns, (fill[into], into))
                    partners.add(into, length - fill[into], [size[i] for i in own[into]])
            used -= not fill[victim]
            if fill[victim]:
                partners.add(victim, length - fill[victim], [size[i] for i in own[victim]])
                stuck.append(victim)
    out = np.empty(len(size), np.int64)
    for b, members in enumerate(own):
        out[members] = b
    return out


def packed(parts: DataFrame, length: int = SEQUENCE, group: int = GROUP) -> DataFrame:
    """Add sequence_id and offset to stored pieces (doc_id, piece, length, ...); lengths must be 1 to `length`.

    Pieces are dealt to groups by a hash with their place in the stored table, so repeated rows are spread like others.
    """
    ship(parts.sparkSession)
    rows = parts.count()
    groups = max(1, -(-rows // group))
    salted = F.xxhash64("doc_id", "piece", "ids_crc32", F.monotonically_increasing_id())
    keyed = parts.withColumn("_group", F.pmod(salted, F.lit(groups)))

    def pack(data: pa.Table) -> pa.Table:
        number = data["_group"][0].as_py()
        order = np.lexsort((data["piece"].to_numpy(), data["doc_id"].fill_null(-1).to_numpy(), -data["length"].to_numpy()))
        data = data.take(pa.array(order)).combine_chunks()
        sizes = data["length"].to_numpy()
        bins = local_search(sizes, best_fit(sizes, length), length)
        _, bins = np.unique(bins, return_inverse=True)
        by_bin = np.argsort(bins, kind="stable")
        ends = np.cumsum(sizes[by_bin])
        first = np.searchsorted(bins[by_bin], bins[by_bin])
        offset = np.empty(len(sizes), np.int64)
        offset[by_bin] = ends - sizes[by_bin] - (ends - sizes[by_bin])[first]
        data = data.drop_columns(["_group"])
        data = data.append_column("sequence_id", pa.array(bins.astype(np.int64) + (int(number) << 32)))
        data = data.append_column("offset", pa.array(offset))
        release_memory()
        return data

    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in parts.schema]
    return keyed.groupBy("_group").applyInArrow(pack, ", ".join([*fields, "sequence_id long", "offset long"]))


def pack_documents(docs: DataFrame, tokenizer: str, length: int = SEQUENCE, with_ids: bool = False, kept_bytes: int = KEPT_BYTES) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32[, ids], sequence_id, offset) of all documents (doc_id, text).

    A null or empty text is one piece with END alone; a null doc_id stays null; repeated rows are packed each for
    itself; an empty table gives no rows. Other columns are ignored. kept_bytes bounds a worker's table of words and that of parts.
    """
    from alertloom.session import durable

    # Written: the number of groups needs a count, and tokenizing is dear.
    return packed(durable(pieces(docs, tokenizer, length, with_ids, kept_bytes)), length)
