"""Near-duplicate documents: minimum hashes, a multi-index Hamming join, confirmation on whole shingle sets.

A document's set holds its distinct shingles of WIDTH words (A-Z lower-cased). Two documents link when
100 * intersection >= percent * union. Steps:

1. Documents with equal sets form a class; its smallest doc_id stands for it. Copies never meet pair by pair.
2. Each class gets a signature of PLACES = CHUNKS * CHUNK minimum hashes of b = 16 bits. Signatures that differ in at
   most CHUNKS * (ERRORS + 1) - 1 places differ, by pigeonhole, in at most ERRORS places of some chunk. A chunk's
   allowed errors are enumerated by masking: one key for each choice of ERRORS places left out. Signatures within that
   distance therefore share a key, always; further ones do with the chance that some chunk has at most ERRORS errors.
   A candidate shares a key and has a signature distance of at most FAR. A pair at similarity 0.75 is missed in 1 of 9
   million cases (no shared key) plus 1 of 100 million (distance above FAR), one at 0.8 in 1 of 2 billion.
3. Candidates are confirmed on the full sets. Pairs whose classes are joined already need no confirmation, since only
   components are asked for. So a crowd of near copies is linked through leaders: every bucket of a key names one, each
   class is checked against the nearest leader it meets, and after a few such rounds what is left - classes of one
   bucket, but of different components - is compared signature by signature, all of it, inside tasks that hold at most
   two blocks of BLOCK rows of one bucket. Each pair counts in the first bucket that it shares. Where a bucket's pairs
   within FAR are few, they leave the task and are confirmed one by one; as soon as they outnumber its rows, the rows do
   instead, with their sets, and are confirmed inside a task that holds at most two blocks of about SET_HASHES shingles.
   It takes the rows one by one, looks only at those of other components, and names a link only if it joins two, so a
   crowd of copies is done after its first rows. No pair leaves a task for being a pair; what is moved of a bucket of n
   rows is n rows for each of its n / BLOCK blocks.

Each class has as many keys as all others, so a bucket holds at most a share of 1 / (CHUNKS * masks) of the keyed rows,
however many near copies there are. No task holds a class or component.
"""
from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from alertloom.llm import texts as T
from alertloom.llm.texts import small
from alertloom.operators.components import components
from alertloom.session import durable

WIDTH = 5
PERCENT = 75
CHUNKS, CHUNK, ERRORS = 16, 5, 1
PLACES = CHUNKS * CHUNK
FAR = 43
LEADER_ROUNDS = 2
BLOCK = 2048
COMPARED = 1 << 15  # pairs that are compared at once
SET_HASHES = 1 << 20  # shingles of a block whose sets are compared, about
CELL = ("key", "low", "high")  # a bucket and two of its blocks

_rng = np.random.default_rng(75)
_ODD = _rng.integers(0, 2**31, CHUNKS * CHUNK, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
_XOR = _rng.integers(0, 2**32, CHUNKS * CHUNK, dtype=np.uint32)
_PLACE = _rng.integers(0, 2**63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_MASKS = [[c * CHUNK + i for i in kept] for c in range(CHUNKS) for kept in itertools.combinations(range(CHUNK), CHUNK - ERRORS)]


def shingle_hashes(chunk: list[bytes], width: int = WIDTH) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, first): the shingles of text i, repeats included, are hashes[first[i]:first[i + 1]]."""
    buffer, bounds = T.laid_out(chunk)
    buffer = T.LOWER[buffer]
    w = T.words(buffer, bounds)
    h = T.run_hashes(buffer, w.start, w.end)
    n = np.diff(w.first)
    count = np.where(n >= width, n - width + 1, (n > 0).astype(np.int64))
    first = np.concatenate([[0], np.cumsum(count)])
    if not len(h):
        return np.zeros(0, np.uint64), first
    # Word j of the shingle that begins at a word, or nothing where the text has ended.
    start = np.repeat(w.first[:-1] - first[:-1], count) + np.arange(first[-1])
    stop = np.repeat(w.first[1:], count)
    total = np.zeros(len(start), np.uint64)
    for j in range(width):
        at = start + j
        total += np.where(at < stop, h[np.minimum(at, len(h) - 1)] * _PLACE[j], np.uint64(0))
    return T.mix64(total), first


def _distinct(h: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, first) with each text's repeats left out, its hashes in order."""
    h = h.copy()
    for a, b in itertools.pairwise(first):
        h[a:b].sort()
    fresh = np.ones(len(h), bool)
    fresh[1:] = h[1:] != h[:-1]
    fresh[first[:-1][first[1:] > first[:-1]]] = True
    return h[fresh], np.concatenate([[0], np.cumsum(fresh)])[first]


def _signed(chunk: list[bytes]) -> dict[str, pa.Array]:
    own, first = _distinct(*shingle_hashes(chunk))
    one, two = T.per_text(own, first), T.per_text(T.mix64(own ^ np.uint64(0x5851F42D4C957F2D)), first)
    full = first[1:] > first[:-1]
    places = np.zeros((len(_ODD), len(chunk)), "<u2")
    if len(own):
        low, start = (own >> np.uint64(32)).astype(np.uint32), first[:-1][full]
        mixed = np.empty_like(low)
        for k in range(len(_ODD)):
            np.multiply(np.bitwise_xor(low, _XOR[k], out=mixed), _ODD[k], out=mixed)
            least = np.minimum.reduceat(mixed, start)
            places[k, full] = T.mix64(least.astype(np.uint64)) & np.uint64(0xFFFF)
    signature = np.ascontiguousarray(places.T)
    signed = [signature[i].tobytes() if full[i] else None for i in range(len(chunk))]
    made = {"n": pa.array(np.diff(first)), "h1": pa.array(one.view(np.int64)), "h2": pa.array(two.view(np.int64))}
    return made | {"signature": pa.array(signed, pa.binary())}


def _key(signatures: np.ndarray, mask: int) -> np.ndarray:
    """The key of each row of places under one mask."""
    packed = np.zeros(len(signatures), np.uint64)
    for place in _MASKS[mask]:
        packed = (packed << np.uint64(16)) | signatures[:, place].astype(np.uint64)
    return T.mix64(packed ^ T.mix64(np.full(1, mask, np.uint64)))


def _places(signatures: pa.Array) -> np.ndarray:
    data = np.frombuffer(b"".join(signatures.to_pylist()), "<u2")
    return data.reshape(-1, PLACES)


def _keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, id): every key of each (id, signature)."""
    for batch in batches:
        for lo in range(0, batch.num_rows, 1024):
            part = batch.slice(lo, 1024)
            places = _places(part.column(1))
            keys = np.stack([_key(places, m) for m in range(len(_MASKS))], axis=1)
            ids = np.repeat(part.column(0).to_numpy(), len(_MASKS))
            yield pa.RecordBatch.from_arrays([pa.array(keys.ravel().view(np.int64)), pa.array(ids)], names=["key", "id"])


def _first_key(same: np.ndarray, places: np.ndarray) -> np.ndarray:
    """Of pairs with places[i] on one side and equal to the other side's where same[i], the first key they share."""
    errors = (~same).reshape(-1, CHUNKS, CHUNK)
    chunk = (errors.sum(axis=2) <= ERRORS).argmax(axis=1)
    out = np.zeros(len(same), np.uint64)
    left = np.ones(len(same), bool)
    for mask, kept in enumerate(_MASKS):
        hit = left & (chunk == kept[0] // CHUNK)
        hit[hit] = same[np.ix_(np.flatnonzero(hit), kept)].all(axis=1)
        if hit.any():
            out[hit] = _key(places[hit], mask)
            left &= ~hit
    return out


def _cells(table: pa.Table) -> tuple[dict[str, np.ndarray], list[tuple[int, int]]]:
    """(columns, row ranges of cells) of rows sorted by cell; `places` are the unpacked signatures."""
    rows = {c: table[c].to_numpy() for c in (*CELL, "id", "n", "root", "block")}
    rows["places"] = _places(table["signature"].combine_chunks())
    change = np.zeros(max(0, table.num_rows - 1), bool)
    for c in CELL:
        change |= rows[c][1:] != rows[c][:-1]
    return rows, list(itertools.pairwise([0, *(np.flatnonzero(change) + 1).tolist(), table.num_rows]))


def _sides(rows: dict[str, np.ndarray], x: int, y: int) -> tuple[np.ndarray, np.ndarray | None]:
    """Left and right rows of a cell, rows x to y: its two blocks, or its one block and None."""
    at = np.arange(x, y)
    if rows["low"][x] == rows["high"][x]:
        return at, None
    low = rows["block"][x:y] == rows["low"][x]
    return at[low], at[~low]


def _partners(rows: dict[str, np.ndarray], i: int, others: np.ndarray, percent: int) -> np.ndarray:
    """Those of other rows that row i is a candidate pair with, by size and signature; a pair counts under its first key."""
    n, places = rows["n"], rows["places"]
    others = others[100 * np.minimum(n[i], n[others]) >= percent * np.maximum(n[i], n[others])]
    same = places[i] == places[others]
    close = same.sum(axis=1) >= PLACES - FAR
    others, same = others[close], same[close]
    if not len(others):
        return others
    first = _first_key(same, np.broadcast_to(places[i], same.shape))
    return others[first.view(np.int64) == rows["key"][i]]


def _streamed(handle):
    """Run handle on tables of whole cells, of batches that come sorted by cell; a task holds one batch and one cell."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            table = pa.Table.from_batches([*held, batch]).combine_chunks()
            last = np.ones(table.num_rows, bool)  # the last cell may go on in the next batch
            for c in CELL:
                values = table[c].to_numpy()
                last &= values == values[-1]
            at = int(np.argmax(last))
            if at:
                yield from handle(table.slice(0, at).combine_chunks())
            held = table.slice(at).combine_chunks().to_batches()
        if held:
            yield from handle(pa.Table.from_batches(held).combine_chunks())

    return run


def _near(percent: int):
    """What a cell has to confirm: its candidate pairs, or, once those are more than its rows, all its rows.

    A pair is a row with both ids and no key, a row of a cell has its key and blocks. So neither the output nor what a
    task holds is longer than the input, however dense a bucket is.
    """
    names = ["a", "b", *CELL, "block", "n"]

    def pairs(rows: dict[str, np.ndarray], x: int, y: int) -> list[tuple[np.ndarray, np.ndarray]] | None:
        found: list[tuple[np.ndarray, np.ndarray]] = []
        left, right = _sides(rows, x, y)
        root, n, places = rows["root"], rows["n"], rows["places"]
        others = left if right is None else right
        step = max(1, COMPARED // max(1, len(others)))
        total = 0
        for at in range(0, len(left), step):
            a = left[at : at + step]
            low, high = np.minimum(n[a][:, None], n[others]), np.maximum(n[a][:, None], n[others])
            allowed = (root[a][:, None] != root[others]) & (100 * low >= percent * high)
            if right is None:
                allowed &= a[:, None] < others
            i, j = np.nonzero(allowed)
            i, j = a[i], others[j]
            same = places[i] == places[j]
            close = same.sum(axis=1) >= PLACES - FAR
            if not close.any():
                continue
            i, j, same = i[close], j[close], same[close]
            # A pair may share many keys; its first one speaks for it.
            own = _first_key(same, places[i]).view(np.int64) == rows["key"][x]
            found.append((i[own], j[own]))
            total += int(own.sum())
            if total > y - x:
                return None
        return found

    def handle(table: pa.Table) -> Iterator[pa.RecordBatch]:
        rows, cells = _cells(table)
        met: list[tuple[np.ndarray, np.ndarray]] = []
        for x, y in cells:
            found = pairs(rows, x, y) if y - x > 1 else []
            if found is None:
                cell = [pa.array(rows[c][x:y].astype(np.int64)) for c in (*CELL, "block", "n")]
                yield pa.RecordBatch.from_arrays([pa.array(rows["id"][x:y]), pa.nulls(y - x, pa.int64()), *cell], names=names)
            else:
                met += found
        if met:
            a, b = (rows["id"][np.concatenate(side)] for side in zip(*met, strict=True))
            none = pa.nulls(len(a), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b)), none, none, none, none, none], names=names)

    return _streamed(handle)


def _linked(percent: int):
    """Links of dense cells, confirmed on full sets: (a, b), at most one less than the cell has components."""

    def links_of(rows: dict[str, np.ndarray], x: int, y: int, sets: pa.ListArray) -> Iterator[tuple[int, int]]:
        own = np.asarray(sets.offsets).astype(np.int64)
        _, codes = np.unique(np.asarray(sets.values)[own[0] : own[-1]], return_inverse=True)
        own -= own[0]
        here = np.zeros(int(codes.max(initial=-1)) + 1, bool)
        size = np.diff(own)
        _, label = np.unique(rows["root"][x:y], return_inverse=True)
        left, right = _sides(rows, x, y)
        for k, i in enumerate((left - x).tolist()):
            others = (left[k + 1 :] if right is None else right) - x
            others = _partners(rows, x + i, x + others[label[others] != label[i]], percent) - x
            if not len(others):
                continue
            here[codes[own[i] : own[i + 1]]] = True
            while len(others):
                # As many at once as have about a block's shingles; what those join needs no look.
                upto = max(1, int(np.searchsorted(np.cumsum(size[others]), SET_HASHES)))
                now, others = others[:upto], others[upto:]
                begin = np.cumsum(size[now]) - size[now]
                at = np.repeat(own[now] - begin, size[now]) + np.arange(size[now].sum())
                both = np.add.reduceat(here[codes[at]].astype(np.int64), begin)
                for j in now[100 * both >= percent * (size[i] + size[now] - both)].tolist():
                    if label[i] != label[j]:
                        label[label == label[j]] = label[i]
                        yield int(rows["id"][x + i]), int(rows["id"][x + j])
                others = others[label[others] != label[i]]
            here[codes[own[i] : own[i + 1]]] = False

    def handle(table: pa.Table) -> Iterator[pa.RecordBatch]:
        rows, cells = _cells(table)
        lists = table["shingles"].combine_chunks()
        for x, y in cells:
            out = list(links_of(rows, x, y, lists.slice(x, y - x)))
            if out:
                pairs = np.array(out, np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(pairs.min(axis=1)), pa.array(pairs.max(axis=1))], names=["a", "b"])

    return _streamed(handle)


def _sets(chunk: list[bytes]) -> dict[str, pa.Array]:
    own, first = _distinct(*shingle_hashes(chunk))
    return {"shingles": pa.ListArray.from_arrays(pa.array(first.astype(np.int32)), pa.array(own.view(np.int64)))}


def _near_in_size(a: str, b: str, percent: int):
    """Necessary for a link, from the sizes alone."""
    return 100 * F.least(a, b) >= percent * F.greatest(a, b)


def _confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """(a, b, linked) of stored pairs (a, b), from their full shingle sets."""
    asked = T.small(pairs.select("a", "b"))
    left = sets.join(asked, sets["id"] == asked["a"]).select("a", "b", F.col("shingles").alias("left"))
    right = sets.join(asked, sets["id"] == asked["b"]).select("a", "b", F.col("shingles").alias("right"))
    both = F.size(F.array_intersect("left", "right")).cast("long")
    union = F.size("left").cast("long") + F.size("right").cast("long") - F.col("both")
    joined = left.join(right, ["a", "b"]).select("a", "b", both.alias("both"), "left", "right")
    return joined.select("a", "b", (100 * F.col("both") >= percent * union).alias("linked"))


def _distance(x: str, y: str):
    """Places in which two signatures differ."""
    differs = lambda i: (F.substring(x, 2 * i + 1, 2) != F.substring(y, 2 * i + 1, 2)).cast("int")
    total = differs(0)
    for i in range(1, PLACES):
        total = total + differs(i)
    return total


def _cut_by_shingles(cells: DataFrame) -> DataFrame:
    """Cells (id, n, key, low, high, block) whose blocks are cut further, to about SET_HASHES shingles each.

    Every two parts of a cell's blocks become a cell of their own.
    """
    parts = cells.groupBy(*CELL, "block").agg(F.greatest(F.ceil(F.sum("n") / SET_HASHES), F.lit(1)).alias("parts"))
    other = parts.select(*CELL, F.col("block").alias("_other"), F.col("parts").alias("_parts"))
    cut = cells.join(parts, [*CELL, "block"]).withColumn("_other", F.col("low") + F.col("high") - F.col("block")).join(other, [*CELL, "_other"])
    # A block's parts are numbered so that no two blocks of a bucket share one.
    number = lambda block, part: block * (1 << 32) + part
    own = number(F.col("block"), F.pmod(F.xxhash64("id", F.lit(9)), F.col("parts")))
    cut = cut.withColumn("_own", own).withColumn("_with", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_parts") - 1)))
    cut = cut.withColumn("_with", number(F.col("_other"), F.col("_with")))
    return cut.select("id", "n", "key", F.least("_own", "_with").alias("low"), F.greatest("_own", "_with").alias("high"), F.col("_own").alias("block"))


def links(classes: DataFrame, sets_of, percent: int = PERCENT) -> DataFrame:
    """(a, b): links that join the stored classes (id, n, signature) to their components.

    sets_of(ids) gives (id, shingles) for a table of ids.
    """
    # One shuffle by key serves the counts and the rows that they are joined to.
    spread = classes.select("id", "signature").mapInArrow(T.released(_keys), "key long, id long").repartition("key")
    lead = F.min(F.struct(F.xxhash64("id").alias("o"), "id"))["id"]
    crowded = spread.groupBy("key").agg(F.count("*").alias("size"), lead.alias("lead")).where("size > 1")
    buckets = durable(spread.join(crowded.select("key", "lead"), "key"))
    met = durable(buckets.select("id").distinct())
    sets = durable(sets_of(T.small(met)))
    heads = durable(classes.join(T.small(met), "id", "left_semi"))
    other = heads.select(*(F.col(c).alias(f"lead_{c}") for c in ("n", "signature")), F.col("id").alias("lead"))
    checked: DataFrame | None = None
    rows = buckets.select("key", "id", F.col("id").alias("root"), "lead", F.col("lead").alias("lead_root"))
    for turn in range(LEADER_ROUNDS):
        offers = rows.where("root != lead_root").select("id", "lead").distinct()
        offers = offers.select("*", F.least("id", "lead").alias("a"), F.greatest("id", "lead").alias("b"))
        if checked is not None:
            offers = offers.join(checked.select("a", "b"), ["a", "b"], "left_anti")
        offers = offers.join(heads, "id").join(other, "lead").where(_near_in_size("n", "lead_n", percent))
        offers = offers.select("id", "lead", "a", "b", _distance("signature", "lead_signature").alias("distance")).where(F.col("distance") <= FAR)
        best = F.min(F.struct("distance", F.xxhash64("lead"), "a", "b")).alias("best")
        pairs = durable(offers.groupBy("id").agg(best).select("best.a", "best.b").distinct())
        found = durable(_confirmed(pairs, sets, percent))
        checked = found if checked is None else checked.unionByName(found)
        joined = checked.where("linked")
        labels = durable(components(joined.select("a", "b")).select(F.col("node").alias("id"), "root"))
        degrees = joined.select(F.explode(F.array("a", "b")).alias("id")).groupBy("id").agg(F.count("*").alias("degree"))
        known = labels.join(degrees, "id", "full").select("id", F.col("root").alias("_root"), "degree")
        rows = buckets.select("key", "id").join(T.small(durable(known)), "id", "left")
        rows = rows.select("key", "id", F.coalesce("_root", "id").alias("root"), F.coalesce("degree", F.lit(0)).alias("degree"))
        lead = F.max(F.struct("degree", F.xxhash64("id").alias("o"), "id", "root")).alias("lead")
        leads = rows.groupBy("key").agg(lead, F.count("*").alias("size"), F.min("root").alias("least"), F.max("root").alias("most"))
        # Buckets of one component have nothing left to find.
        leads = leads.where("least < most").select("key", "size", F.col("lead.id").alias("lead"), F.col("lead.root").alias("lead_root"))
        rows = durable(rows.drop("degree").join(leads, "key"))
    # What is left: all pairs of different components in a bucket, block against block.
    blocks = F.ceil(F.col("size") / BLOCK).cast("int")
    own = F.pmod(F.xxhash64("id", F.lit(5)), blocks).cast("int")
    rest = rows.join(heads, "id").select("key", "id", "n", "root", "signature", blocks.alias("blocks"), own.alias("block"))
    rest = rest.withColumn("with", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    rest = rest.select("key", F.least("block", "with").alias("low"), F.greatest("block", "with").alias("high"), "id", "n", "root", "signature", "block")
    arranged = lambda df: df.repartition(*CELL).sortWithinPartitions(*CELL)
    asked = durable(arranged(rest).mapInArrow(T.released(_near(percent)), "a long, b long, key long, low long, high long, block long, n long"))
    pairs = durable(asked.where("b is not null").select("a", "b").join(checked.select("a", "b"), ["a", "b"], "left_anti"))
    crowds = asked.where("b is null").select(F.col("a").alias("id"), "n", *CELL, "block")
    known = rows.select("id", "root").distinct().join(heads, "id").join(sets.withColumnRenamed("id", "_id"), F.col("id") == F.col("_id")).drop("_id")
    dense = arranged(_cut_by_shingles(crowds).drop("n").join(known, "id")).mapInArrow(T.released(_linked(percent)), "a long, b long")
    found = _confirmed(pairs, sets, percent).where("linked").select("a", "b")
    return durable(checked.where("linked").select("a", "b").unionByName(found).unionByName(dense))


def near_duplicates(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """(doc_id, n_shingles, class_id, component_id, kept), a row for each row of docs (doc_id, text).

    class_id is the smallest doc_id with the same set, component_id the smallest one reachable over links; kept tells
    whether that is the document itself. Texts that are null or have no word have the empty set, link with nothing and
    are kept. Rows without doc_id get null ids, link with nothing and are kept. Repeated rows get equal results; where
    a doc_id stands for several texts and leads several classes, its largest set is the one that links. Other columns
    of docs are ignored.
    """
    source = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].alias("text"))
    signed = durable(T.over_texts(source, "text", _signed, "n long, h1 long, h2 long, signature binary"))
    full = signed.where("n > 0 and doc_id is not null")
    classes = full.groupBy("h1", "h2", "n").agg(F.min("doc_id").alias("class_id"))
    members = signed.select("doc_id", "n", "h1", "h2").join(classes.where("class_id is not null"), ["h1", "h2", "n"], "left")
    members = durable(members.select("doc_id", "n", F.when(F.col("doc_id").isNotNull(), F.coalesce("class_id", "doc_id")).alias("class_id"), "h1", "h2"))
    heads = members.where("n > 0 and doc_id = class_id").groupBy("doc_id").agg(F.max(F.struct("n", "h1", "h2")).alias("own"))
    heads = heads.select("doc_id", "own.n", "own.h1", "own.h2")
    # A head may be repeated, as a copy with the same id.
    leaders = full.join(heads, ["doc_id", "n", "h1", "h2"], "left_semi").select(F.col("doc_id").alias("id"), "n", "signature")
    leaders = durable(leaders.dropDuplicates(["id"]))

    def sets_of(ids: DataFrame) -> DataFrame:
        met = source.join(ids.withColumnRenamed("id", "doc_id"), "doc_id", "left_semi")
        own = T.over_texts(met, "text", _sets, "shingles array<long>")
        # Of an id with several texts, the set of its class.
        sized = own.where(F.size("shingles") > 0).groupBy("doc_id").agg(F.max_by("shingles", F.size("shingles")).alias("shingles"))
        return sized.select(F.col("doc_id").alias("id"), "shingles")

    roots = components(links(leaders, sets_of, percent))
    found = members.select("doc_id", "n", "class_id").join(roots.withColumnRenamed("node", "class_id"), "class_id", "left")
    component = F.coalesce("root", "class_id")
    return found.select(
        "doc_id",
        F.col("n").alias("n_shingles"),
        "class_id",
        component.alias("component_id"),
        F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"),
    )


def one_of_each(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """The rows of docs (doc_id, text, ...) without near-duplicates, with all their columns as they are.

    Of each component the document with the smallest doc_id stays, of one doc_id the longest text. Where a doc_id
    stands for several texts, each is a document of its own; equal rows of such an id are one. Rows without doc_id stay.
    """
    columns = docs.columns
    ids = docs.where("doc_id is not null").groupBy("doc_id").agg(F.count("*").alias("n"))
    several = durable(ids.where("n > 1").select("doc_id"))
    if several.isEmpty():
        gone = durable(near_duplicates(docs, percent).where("not kept").select("doc_id"))
        return docs.join(small(gone), "doc_id", "left_anti").select(*columns)
    single = docs.join(small(several), "doc_id", "left_anti")
    low, high = docs.agg(F.min(F.col("doc_id").cast("long")), F.max(F.col("doc_id").cast("long"))).first()
    # Numbers that no doc_id has stand for the texts; the ids decide below which of them is kept.
    number = F.monotonically_increasing_id()
    number = high + 1 + number if high < 2**62 else low - 1 - number
    several_texts = docs.join(small(several), "doc_id", "left_semi").dropDuplicates(["doc_id", "text"])
    texts = durable(several_texts.select(F.struct(*columns).alias("row"), "doc_id", "text", number.alias("node")))
    nodes = single.select(F.col("doc_id").cast("long").alias("doc_id"), "text").unionByName(texts.select(F.col("node").alias("doc_id"), "text"))
    found = near_duplicates(nodes, percent).where("doc_id is not null")
    found = durable(found.select(F.col("doc_id").alias("node"), "component_id", "kept"))
    real = durable(texts.select("node", F.col("doc_id").cast("long").alias("real"), (-F.coalesce(F.length("text"), F.lit(0))).alias("size")))
    known = found.join(small(real), "node", "left")
    met = durable(known.where("real is not null").select("component_id").distinct())
    own = known.join(small(met), "component_id", "left_semi")
    rank = F.struct(F.coalesce("real", "node").alias("id"), F.coalesce("size", F.lit(0)).alias("size"), "node")
    first = own.groupBy("component_id").agg(F.min(rank)["node"].alias("first"))
    later = own.join(first, "component_id").where("node <> first").select("node")
    gone = durable(found.join(small(met), "component_id", "left_anti").where("not kept").select("node").unionByName(later))
    kept = single.join(small(gone.withColumnRenamed("node", "doc_id")), "doc_id", "left_anti").select(*columns)
    return kept.unionByName(texts.join(small(gone), "node", "left_anti").select("row.*").select(*columns))
