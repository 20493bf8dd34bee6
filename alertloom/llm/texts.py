"""Words, hashes and Arrow plumbing shared by the text operators.

Everything here works on the UTF-8 bytes of many texts at once: a chunk of texts is laid out in one buffer, each
text followed by a line feed, and words, hashes and counts come from array operations over that buffer. Chunks hold
about CHUNK_BYTES, so memory follows the chunk (or the longest single text), never the partition.
"""

from __future__ import annotations

import ctypes
import tempfile
import zipfile
from collections.abc import Callable, Iterator
from pathlib import Path
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F

CHUNK_BYTES = 1 << 20

#: Bytes between words: space, and tab to carriage return.
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True

#: A-Z to a-z, all other bytes as they are.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

_STEPS = np.random.default_rng(20240101)
_POWERS = _STEPS.integers(0, 2**63, 1 << 16, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ship(spark: SparkSession) -> None:
    """Give the executors this package, once for each Spark context."""
    sc = spark.sparkContext
    # Batches to Python are bounded in rows and bytes; texts stay whole.
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2000")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", "8m")
    if getattr(sc, "_alertloom_shipped", False):
        return
    package = Path(__file__).resolve().parent.parent
    archive = Path(tempfile.mkdtemp(prefix="alertloom-code-")) / "alertloom_code.zip"
    with zipfile.ZipFile(archive, "w") as z:
        for path in sorted(package.rglob("*.py")):
            z.write(path, path.relative_to(package.parent))
    sc.addPyFile(str(archive))
    sc._alertloom_shipped = True


def mix64(x: np.ndarray) -> np.ndarray:
    """Scramble 64-bit values (the finalizer of splitmix64)."""
    x = x + np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Words(NamedTuple):
    """Words of a chunk, in order: bounds in the buffer, the text each belongs to, and each text's first word."""

    start: np.ndarray
    end: np.ndarray
    text: np.ndarray
    first: np.ndarray  # one more than there are texts


def laid_out(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(buffer, bounds): text i is buffer[bounds[i]:bounds[i + 1] - 1], then a line feed."""
    buffer = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)
    bounds = np.zeros(len(texts) + 1, np.int64)
    np.cumsum([len(t) + 1 for t in texts], out=bounds[1:])
    return buffer, bounds


def words(buffer: np.ndarray, bounds: np.ndarray) -> Words:
    """Maximal runs of bytes that are not white space."""
    gap = SPACE[buffer]
    edges = np.flatnonzero(np.diff(gap.view(np.int8), prepend=np.int8(1)))
    start, end = edges[0::2], edges[1::2]
    first = np.searchsorted(start, bounds)
    return Words(start, end, np.repeat(np.arange(len(bounds) - 1), np.diff(first)), first)


def run_hashes(buffer: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each buffer[start:end]; runs are in order and do not overlap."""
    if not len(start):
        return np.zeros(0, np.uint64)
    size = end - start
    owner = np.repeat(start, size)
    begin = np.cumsum(size) - size
    at = np.arange(len(owner)) - np.repeat(begin, size)
    values = _POWERS[at & 0xFFFF] * (buffer[owner + at].astype(np.uint64) + np.uint64(1))
    return mix64(np.add.reduceat(values, begin) + size.astype(np.uint64))


def per_text(values: np.ndarray, first: np.ndarray, ufunc=np.add, empty=0) -> np.ndarray:
    """Reduce values over each text's range first[i]:first[i + 1]; `empty` where it has none."""
    out = np.full(len(first) - 1, empty, values.dtype)
    full = np.flatnonzero(first[1:] > first[:-1])
    if len(full):
        out[full] = ufunc.reduceat(values, first[:-1][full])
    return out


def release_memory() -> None:
    """Give what this worker's Arrow pool and C library hold unused back to the system; workers are reused by later stages."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of the GNU C library alone
    if trim:
        trim(0)


def released(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """run, with its worker's unused memory given back after each task."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            release_memory()

    return task


def text_bytes(column: pa.Array) -> pa.Array:
    """The column's UTF-8 bytes, with null as the empty text."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.cast(pa.large_string()).fill_null("").cast(pa.large_binary())


def chunked(column: pa.Array, most: int = CHUNK_BYTES) -> Iterator[tuple[int, list[bytes]]]:
    """(first row, texts) of consecutive rows with about `most` bytes, or one longer text."""
    data = text_bytes(column)
    sizes = np.diff(np.frombuffer(data.buffers()[1], np.int64)[data.offset : data.offset + len(data) + 1]) if len(data) else []
    lo = held = 0
    for i, size in enumerate(sizes):
        if held and held + size > most:
            yield lo, data[lo:i].to_pylist()
            lo, held = i, 0
        held += int(size) + 1
    if held:
        yield lo, data[lo:].to_pylist()


def over_texts(
    df: DataFrame, text: str, fn: Callable[[list[bytes]], dict[str, pa.Array]], schema: str, keep: list[str] | None = None
) -> DataFrame:
    """Columns `keep` of df (all but the text if not given), and for each row the columns that fn makes from its text.

    fn gets a chunk of texts (bytes; null is empty) and returns a column for each name of `schema`, a row for each text.
    """
    ship(df.sparkSession)
    keep = [c for c in df.columns if c != text] if keep is None else keep
    sent = [df[c].alias(f"_k{i}") for i, c in enumerate(keep)]
    at = keep.index(text) if text in keep else len(keep)
    source = df.select(*sent, *([df[text].cast("string").alias("_text")] if at == len(keep) else []))
    names = [f"_k{i}" for i in range(len(keep))]
    kept = ", ".join(f"_k{i} {source.schema[i].dataType.simpleString()}" for i in range(len(keep)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, texts in chunked(batch.column(at)):
                made = fn(texts)
                part = batch.slice(lo, len(texts))
                yield pa.RecordBatch.from_arrays([*part.columns[: len(keep)], *made.values()], names=[*names, *made])

    out = source.mapInArrow(released(run), f"{kept}, {schema}" if kept else schema)
    made = out.columns[len(keep) :]
    return out.select(*[out[f"_k{i}"].alias(c) for i, c in enumerate(keep)], *made)


#: Tables of ids up to this size (a few MB) are broadcast, larger ones are shuffled.
SMALL_ROWS = 400_000


def small(rows: DataFrame) -> DataFrame:
    """A stored table of ids, marked for broadcast if it has at most SMALL_ROWS rows."""
    return F.broadcast(rows) if rows.count() <= SMALL_ROWS else rows


def within(rows: DataFrame, key: str, size: str, most: int) -> DataFrame:
    """Of a stored sample, with one row for each key, the first rows by a hash of it whose sizes sum up to `most`.

    Rows of more than an eighth of that are left out, so that one of them does not stand for the sample.

    What they are summed from is (key, size) alone, as many rows as the sample's own bound in documents allows.
    """
    upto = F.sum(F.coalesce(size, F.lit(0)).cast("long")).over(W.orderBy(F.xxhash64(key), key))
    sizes = rows.where(F.coalesce(size, F.lit(0)) <= most // 8).select(key, size).withColumn("_upto", upto)
    return rows.join(sizes.where(F.col("_upto") <= most).select(key), key, "left_semi")


def learned_rows(labels: DataFrame, label: str) -> DataFrame:
    """(doc_id, y) with one 0/1 label per document; null ids and labels are left out, conflicting ones count as 1."""
    known = labels.where(F.col("doc_id").isNotNull() & F.col(label).isin(0, 1))
    return known.groupBy("doc_id").agg(F.max(F.col(label).cast("int")).alias("y"))


def fold(doc_id: str | object, k: int):
    """crc32 of the id as text, modulo k; null ids fall into no fold."""
    column = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.crc32(column.cast("string").cast("binary")) % k
