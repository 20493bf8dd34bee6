"""How far the sources of a language differ in their words, by products of one-hot level matrices.

A group is a (lang, source); a term's level in a group is how often it occurs there. The smoothed share of a term depends
on its level alone, so the distance of two groups, the sum over terms of the difference of their shares, needs only
their joint table: how many terms have level a in one and level b in the other. With an indicator column for each
(group, level) and a row for each term, the joint tables of all groups of a language are the blocks of X'X. Terms are
dealt into blocks by the power of two of their count and a hash, so that a block has few different levels; groups are
taken in blocks as well. A task holds one block of terms for two blocks of groups and multiplies panels of bounded
width; entries are numbers of terms of one block, exact in single precision. Spark adds up the blocks and prices them.

All arithmetic is in integers: p = 1 + floor(UNIT * (count + PRIOR) / (N + PRIOR * V)).
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window, functions as F

from alertloom.llm import texts as T
from alertloom.session import durable

LEAST_DOCS = 30
TOP_TERMS = 50
UNIT, PRIOR = 1_000_000_000, 5
TERMS = 2048  # terms of a block, about
GROUPS = 32  # groups of a block
PANEL = 4096  # columns that are multiplied at once
CHUNK = 4 << 20
CELLS = 8  # blocks of a task

#: Bytes of terms: ASCII letters and all bytes of other characters.
_LETTER = np.zeros(256, bool)
_LETTER[[*range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True


def _occurrences(chunk: list[bytes], group: np.ndarray) -> tuple[np.ndarray, pa.Array, np.ndarray, np.ndarray]:
    """(group, term, occurrences, documents) of a chunk of texts, whose groups are given as numbers."""
    buffer, bounds = T.laid_out(chunk)
    inside = _LETTER[buffer]
    edges = np.flatnonzero(np.diff(inside.view(np.int8), prepend=np.int8(0), append=np.int8(0)))
    start, end = edges[0::2], edges[1::2]
    offsets = np.concatenate([[0], np.cumsum(end - start)]).astype(np.int32)
    data = T.LOWER[buffer[inside]]
    terms = pa.Array.from_buffers(pa.binary(), len(start), [None, pa.py_buffer(offsets), pa.py_buffer(data)])
    coded = terms.dictionary_encode()
    code, n = np.asarray(coded.indices).astype(np.int64), max(1, len(coded.dictionary))
    text = np.searchsorted(bounds, start, side="right") - 1
    of_text, times = np.unique(text * n + code, return_counts=True)
    key = group[of_text // n] * n + of_text % n
    order = np.argsort(key, kind="stable")
    key, first = np.unique(key[order], return_index=True)
    total = np.add.reduceat(times[order], first) if len(first) else times
    return key // n, coded.dictionary.take(pa.array(key % n)), total, np.diff([*first, len(order)])


def term_counts(docs: DataFrame) -> DataFrame:
    """(lang, source, term, n, docs): occurrences of each term in a group, and the documents that have it.

    Null texts, languages and sources count as empty ones. Counts are added up per chunk before anything is shuffled.
    """
    T.ship(docs.sparkSession)
    rows = _read(docs, "lang", "source", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lang, source = batch.column(0).dictionary_encode(), batch.column(1).dictionary_encode()
            many = max(1, len(source.dictionary))
            group = np.asarray(lang.indices).astype(np.int64) * many + np.asarray(source.indices)
            for lo, chunk in T.chunked(batch.column(2), CHUNK):
                own, term, n, having = _occurrences(chunk, group[lo : lo + len(chunk)])
                columns = [lang.dictionary.take(pa.array(own // many)), source.dictionary.take(pa.array(own % many))]
                columns += [term.cast(pa.string()), pa.array(n, pa.int64()), pa.array(having, pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, names=["lang", "source", "term", "n", "docs"])

    found = rows.mapInArrow(run, "lang string, source string, term string, n long, docs long")
    return found.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def _read(docs: DataFrame, *columns: str) -> DataFrame:
    return docs.select(*(F.coalesce(docs[c].cast("string"), F.lit("")).alias(c) for c in columns))


def _share(n: Column, total: Column, terms: Column) -> Column:
    """The smoothed share p of a term that occurs n times, in units of 1 / UNIT."""
    part = F.lit(UNIT).cast("decimal(38,0)") * (n + PRIOR).cast("decimal(28,0)")
    return 1 + F.call_function("div", part, (total + PRIOR * terms).cast("decimal(38,0)"))


class Vocabulary(NamedTuple):
    """Stored tables of the groups and the terms that are kept."""

    groups: DataFrame  # (lang, source, place, block, kept, total, p0): place from 0 in the language
    terms: DataFrame  # (lang, term, q, power, part): q the language's share, power and part the block of terms
    counts: DataFrame  # (lang, source, term, n, p)
    blocks: DataFrame  # (lang, power, part, size): blocks of terms; an empty one where a language keeps no term


def vocabulary(docs: DataFrame, least_docs: int = LEAST_DOCS) -> Vocabulary:
    """Terms in at least `least_docs` documents of their language, with exact counts and shares in every group."""
    counts = durable(term_counts(docs))
    kept = counts.groupBy("lang", "term").agg(F.sum("n").alias("total"), F.sum("docs").alias("docs")).where(F.col("docs") >= least_docs)
    power = F.floor(F.log2("total")).cast("int")
    kept = durable(kept.select("lang", "term", "total", power.alias("power")))
    own = durable(counts.select("lang", "source", "term", "n").join(kept.select("lang", "term"), ["lang", "term"]))
    langs = kept.groupBy("lang").agg(F.count("*").alias("kept"), F.sum("total").alias("whole"))
    sums = own.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    groups = _read(docs, "lang", "source").distinct().join(sums, ["lang", "source"], "left").join(langs, "lang", "left")
    groups = groups.select("lang", "source", *(F.coalesce(c, F.lit(0)).alias(c) for c in ("kept", "total")))
    place = (F.row_number().over(Window.partitionBy("lang").orderBy("source")) - 1).alias("place")
    groups = groups.select("*", place, F.when(F.col("kept") > 0, _share(F.lit(0), F.col("total"), F.col("kept"))).otherwise(0).alias("p0"))
    groups = durable(groups.withColumn("block", F.floor(F.col("place") / GROUPS).cast("int")))
    sizes = kept.groupBy("lang", "power").agg(F.ceil(F.count("*") / TERMS).cast("int").alias("parts"))
    sizes = durable(sizes.unionByName(groups.where("kept = 0").select("lang", F.lit(-1).alias("power"), F.lit(1).alias("parts")).distinct()))
    part = F.pmod(F.xxhash64("term", F.lit(13)), F.col("parts")).cast("int").alias("part")
    terms = kept.join(langs, "lang").join(sizes, ["lang", "power"])
    terms = terms.select("lang", "term", _share(F.col("total"), F.col("whole"), F.col("kept")).alias("q"), "power", part)
    terms = durable(terms)
    blocks = sizes.select("lang", "power", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
    blocks = blocks.join(terms.groupBy("lang", "power", "part").agg(F.count("*").alias("size")), ["lang", "power", "part"], "left").fillna(0, "size")
    p = _share(F.col("n"), F.col("total"), F.col("kept")).alias("p")
    own = own.join(groups.select("lang", "source", "kept", "total"), ["lang", "source"]).select("lang", "source", "term", "n", p)
    return Vocabulary(groups, terms, own, durable(blocks))


class _Levels(NamedTuple):
    """A group's levels in a block of terms, from 0 up, their shares, and each term's level as a column number."""

    level: np.ndarray
    share: np.ndarray
    column: np.ndarray

    def one_hot(self) -> np.ndarray:
        out = np.zeros((len(self.column), len(self.level)), np.float32)
        out[np.arange(len(self.column)), self.column] = 1
        return out


def _levels(place: np.ndarray, term: np.ndarray, n: np.ndarray, p: np.ndarray, terms: int) -> dict[int, _Levels]:
    """The levels of each group; its row without a term (-1) gives level 0."""
    out = {}
    order = np.argsort(place, kind="stable")
    cuts = [0, *(np.flatnonzero(np.diff(place[order])) + 1).tolist(), len(order)]
    for lo, hi in itertools.pairwise(cuts):
        at = order[lo:hi]
        level, first, code = np.unique(n[at], return_index=True, return_inverse=True)
        column = np.zeros(terms, np.int64)
        real = term[at] >= 0
        column[term[at][real]] = code[real]
        out[int(place[at[0]])] = _Levels(level, p[at][first], column)
    return out


def _panels(places: list[int], of: dict[int, _Levels]) -> list[list[int]]:
    """Consecutive groups with at most PANEL levels in all, or one with more."""
    out: list[list[int]] = []
    width = 0
    for x in places:
        if not out or width + len(of[x].level) > PANEL:
            out.append([])
            width = 0
        out[-1].append(x)
        width += len(of[x].level)
    return out


def _products(table: pa.Table) -> Iterator[pa.RecordBatch]:
    """Joint tables of one block of terms: every two groups, one of each block of groups, the first place smaller."""
    lang, low, high = (table[c][0] for c in ("lang", "low", "high"))
    coded = table["term"].combine_chunks().dictionary_encode()
    code = coded.indices.fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)
    place, n, p, block = (table[c].to_numpy() for c in ("place", "n", "p", "block"))
    # Terms of the block that none of these groups has are rows of level 0 everywhere.
    of = _levels(place, code, n, p, pc.max(table["size"]).as_py())
    left, right = (np.unique(place[block == b.as_py()]).tolist() for b in (low, high))
    for panel in _panels(right, of):
        owner = np.repeat(panel, [len(of[x].level) for x in panel])
        levels, shares = (np.concatenate([of[x][k] for x in panel]) for k in (0, 1))
        matrix = np.concatenate([of[x].one_hot() for x in panel], axis=1)
        for x in left:
            begin = int(np.searchsorted(owner, x, side="right"))  # groups after x
            if begin == len(owner):
                continue
            own = of[x]
            joint = own.one_hot().T @ matrix[:, begin:]
            i, j = np.nonzero((joint > 0) | ((own.level[:, None] == 0) & (levels[begin:] == 0)))
            k = j + begin
            columns = [pa.repeat(lang, len(i)), pa.repeat(pa.scalar(x, pa.int32()), len(i)), pa.array(owner[k], pa.int32())]
            columns += [pa.array(v.astype(np.int64)) for v in (own.level[i], own.share[i], levels[k], shares[k], joint[i, j])]
            yield pa.RecordBatch.from_arrays(columns, names=["lang", "one", "two", "n_one", "p_one", "n_two", "p_two", "terms"])


def joint_tables(known: Vocabulary) -> DataFrame:
    """(lang, one, two, n_one, p_one, n_two, p_two, terms): parts of the joint tables of every two groups of a language.

    one < two are places of groups. Of each block of terms comes how many have level n_one in the first group and n_two
    in the second; add `terms` up for whole tables. The entry of level 0 in both is always there, with 0 terms if need be.
    """
    T.ship(known.groups.sparkSession)
    groups = known.groups.select("lang", "source", "place", "block", "p0")
    term = F.lit(None).cast("string").alias("term")
    empty = groups.join(known.blocks, "lang").select("lang", "power", "part", "place", "block", term, F.lit(0).cast("long").alias("n"), F.col("p0").alias("p"), "size")
    full = known.counts.join(known.terms.drop("q"), ["lang", "term"]).join(groups, ["lang", "source"])
    rows = full.select("lang", "power", "part", "place", "block", "term", "n", "p", F.lit(0).cast("long").alias("size")).unionByName(empty)
    most = groups.groupBy("lang").agg(F.max("block").alias("most"))
    rows = rows.join(most, "lang").withColumn("with", F.explode(F.sequence(F.lit(0), F.col("most")))).drop("most")
    rows = rows.withColumns({"low": F.least("block", "with"), "high": F.greatest("block", "with")}).drop("with")
    cell = ["lang", "power", "part", "low", "high"]
    cells = groups.groupBy("lang").agg(F.countDistinct("block").alias("b")).join(known.blocks, "lang")
    cells = cells.agg(F.sum(F.expr("b * (b + 1) div 2"))).first()[0] or 1
    # As many tasks as the work asks for, not as the bytes do.
    spread = rows.repartition(-(-cells // CELLS), *cell)
    schema = "lang string, one int, two int, n_one long, p_one long, n_two long, p_two long, terms long"

    def multiply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _products(pa.Table.from_batches(batches))

    return spread.groupBy(*cell).applyInArrow(multiply, schema)


def audit(docs: DataFrame, least_docs: int = LEAST_DOCS, top_terms: int = TOP_TERMS) -> DataFrame:
    """(lang, source, part, item, value, rank): how each group differs from the other sources and from its language.

    Part `pair`: item is another source of the language, value the sum over all kept terms of the difference of the
    shares (0 where the language keeps no term). Part `term`: item is a term of the group whose share is above the
    language's, value the difference; the first `top_terms` only. Ranks go by value downwards, then by item. Null texts,
    languages and sources count as empty ones, repeated rows as often as they come; an empty table gives no rows.
    Other columns of docs are ignored.
    """
    known = vocabulary(docs, least_docs)
    price = F.sum(F.col("terms") * F.abs(F.col("p_one") - F.col("p_two"))).alias("value")
    priced = durable(joint_tables(known).groupBy("lang", "one", "two").agg(price))
    both = priced.unionByName(priced.select("lang", F.col("two").alias("one"), F.col("one").alias("two"), "value"))
    names = known.groups.select("lang", F.col("place").alias("one"), "source")
    others = names.select("lang", F.col("one").alias("two"), F.col("source").alias("item"))
    pair = both.join(names, ["lang", "one"]).join(others, ["lang", "two"]).select("lang", "source", F.lit("pair").alias("part"), "item", "value")
    above = known.counts.join(known.terms, ["lang", "term"]).where("n > 0 and p > q")
    term = above.select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), (F.col("p") - F.col("q")).alias("value"))
    rank = F.row_number().over(Window.partitionBy("lang", "source", "part").orderBy(F.desc("value"), "item")).alias("rank")
    return pair.select("*", rank).unionByName(term.select("*", rank).where(F.col("rank") <= top_terms))


ORACLE_SQL = r"""
WITH docs AS (
  SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text
  FROM documents
), groups AS (
  SELECT DISTINCT lang, source FROM docs
), words AS (
  SELECT r, lang, source, unnest(regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM docs
), kept AS (
  SELECT lang, term, count(*)::HUGEINT AS total FROM words GROUP BY lang, term HAVING count(DISTINCT r) >= 30
), langs AS (
  SELECT lang, count(*)::HUGEINT AS v, sum(total)::HUGEINT AS whole FROM kept GROUP BY lang
), counted AS (
  SELECT lang, source, term, count(*)::HUGEINT AS n FROM words SEMI JOIN kept USING (lang, term) GROUP BY lang, source, term
), sums AS (
  SELECT lang, source, sum(n)::HUGEINT AS total FROM counted GROUP BY lang, source
), shares AS (
  SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n,
    1 + (1000000000::HUGEINT * (coalesce(c.n, 0) + 5)) // (coalesce(s.total, 0) + 5 * l.v) AS p,
    1 + (1000000000::HUGEINT * (k.total + 5)) // (l.whole + 5 * l.v) AS q
  FROM groups g JOIN kept k ON g.lang = k.lang JOIN langs l ON g.lang = l.lang
    LEFT JOIN counted c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term
    LEFT JOIN sums s ON s.lang = g.lang AND s.source = g.source
), pairs AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, sum(abs(a.p - b.p)) AS value
  FROM shares a JOIN shares b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY a.lang, a.source, b.source
  UNION ALL
  SELECT a.lang, a.source, 'pair', b.source, 0 FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source
  WHERE a.lang NOT IN (SELECT lang FROM langs)
), ranked AS (
  SELECT lang, source, part, item, CAST(value AS BIGINT) AS value,
    CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INTEGER) AS rank
  FROM (SELECT * FROM pairs UNION ALL SELECT lang, source, 'term', term, p - q FROM shares WHERE n > 0 AND p > q)
)
SELECT lang, source, part, item, value, rank FROM ranked WHERE part = 'pair' OR rank <= 50
"""
