"""Fill-in-middle transformation as a pipeline of pyarrow.compute kernels.

A text is cut into units: runs of ASCII letters, and every other code point by itself. Two of its n + 1 unit bounds,
drawn from the document's id, part it into prefix, middle and suffix, which are put in another order between markers:

    psm    <P>prefix<S>suffix<M>middle
    spm    <S>suffix<P>prefix<M>middle
    plain  the text as it is

No step looks at one text by itself. For a chunk of texts: mark every unit's begin with a byte that UTF-8 never has and
split there into list arrays; flatten them with their parents' indices; a unit's ordinal is its place less its parent's
offset; compare it with the parent's two bounds for its role; filter by role, rebuild lists from the roles' sizes, join
their units, and join the pieces with the markers.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F

from alertloom.llm import texts as T

SEED = 1
PLAIN_FROM = 90  # of 100: the draw from which a text stays plain
SPM_BELOW = 20  # of 100: the draw below which a changed text takes the form spm
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
_MARKER = "<[PSM]>"

#: A unit in bytes: letters, one other ASCII character, or one character of several bytes.
_UNIT = rb"([A-Za-z]+|[\x00-\x7F]|[\xC0-\xFF][\x80-\xBF]*)"
_BREAK = b"\xff"


def draws(doc_id: Column, seed: int = SEED) -> list[Column]:
    """Four unsigned 32-bit numbers of an id: the first groups of 8 hex digits of sha256 of `seed:id`.

    A null id counts as the empty text.
    """
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(digest, 8 * i + 1, 8), 16, 10).cast("long") for i in range(4)]


def units(texts: pa.Array) -> pa.ListArray:
    """The units of each text (binary), as lists."""
    marked = pc.replace_substring_regex(texts, pattern=_UNIT, replacement=_BREAK + rb"\1")
    lists = pc.split_pattern(marked, pattern=_BREAK)
    # The break before the first unit leaves an empty entry at the head of every list.
    flat, parent = pc.list_flatten(lists), pc.list_parent_indices(lists)
    kept = pc.not_equal(_ordinals(lists.offsets, parent), 0)
    sizes = pc.subtract(pc.list_value_length(lists), 1)
    return pa.ListArray.from_arrays(_offsets(sizes), pc.filter(flat, kept))


def _ordinals(offsets: pa.Array, parent: pa.Array) -> pa.Array:
    at = pa.array(np.arange(len(parent), dtype=np.int64))
    return pc.subtract(at, pc.take(pc.cast(offsets, pa.int64()), parent))


def _offsets(sizes: pa.Array) -> pa.Array:
    return pa.concat_arrays([pa.array([0], pa.int32()), pc.cumulative_sum(pc.cast(sizes, pa.int32()))])


def _modulo(x: pa.Array, n: pa.Array) -> pa.Array:
    return pc.subtract(x, pc.multiply(pc.divide(x, n), n))


def _joined(flat: pa.Array, role: pa.Array, sizes: pa.Array) -> pa.Array:
    lists = pa.ListArray.from_arrays(_offsets(sizes), pc.filter(flat, role))
    return pc.cast(pc.binary_join(lists, b""), pa.large_string())


def parted(texts: pa.Array, one: pa.Array, two: pa.Array) -> tuple[pa.Array, pa.Array, pa.Array, pa.Array]:
    """(n, prefix, middle, suffix) of texts (binary) and two draws of each."""
    lists = units(texts)
    flat, parent = pc.list_flatten(lists), pc.list_parent_indices(lists)
    n = pc.cast(pc.list_value_length(lists), pa.int64())
    bounds = pc.add(n, 1)
    a, b = _modulo(one, bounds), _modulo(two, bounds)
    first, last = pc.min_element_wise(a, b), pc.max_element_wise(a, b)
    ordinal = _ordinals(lists.offsets, parent)
    before, after = pc.less(ordinal, pc.take(first, parent)), pc.greater_equal(ordinal, pc.take(last, parent))
    prefix = _joined(flat, before, first)
    middle = _joined(flat, pc.invert(pc.or_(before, after)), pc.subtract(last, first))
    suffix = _joined(flat, after, pc.subtract(n, last))
    return n, prefix, middle, suffix


def transform(texts: list[bytes], h: list[pa.Array]) -> dict[str, pa.Array]:
    """n, form, prefix_chars, middle_chars and output of a chunk of texts with their four draws."""
    raw = pa.array(texts, pa.binary())
    n, prefix, middle, suffix = parted(raw, h[0], h[1])
    whole = pc.cast(raw, pa.large_string())
    hundred = pa.scalar(100, pa.int64())
    plain = pc.or_(pc.equal(pc.binary_length(raw), 0), pc.match_substring_regex(whole, pattern=_MARKER))
    plain = pc.or_(plain, pc.greater_equal(_modulo(h[2], hundred), PLAIN_FROM))
    spm = pc.less(_modulo(h[3], hundred), SPM_BELOW)
    p, s, m = (pa.scalar(x, pa.large_string()) for x in (PREFIX, SUFFIX, MIDDLE))
    end = pa.scalar("", pa.large_string())
    as_psm = pc.binary_join_element_wise(p, prefix, s, suffix, m, middle, end)
    as_spm = pc.binary_join_element_wise(s, suffix, p, prefix, m, middle, end)
    output = pc.if_else(plain, whole, pc.if_else(spm, as_spm, as_psm))
    none = pa.scalar(None, pa.int64())
    return {
        "n": n,
        "form": pc.if_else(plain, "plain", pc.if_else(spm, "spm", "psm")),
        "prefix_chars": pc.if_else(plain, none, pc.cast(pc.utf8_length(prefix), pa.int64())),
        "middle_chars": pc.if_else(plain, none, pc.cast(pc.utf8_length(middle), pa.int64())),
        "output": pc.cast(output, pa.string()),
    }


def rebuild(output: pa.Array, form: pa.Array) -> pa.Array:
    """The texts that these outputs were made of."""
    plain = pc.equal(form, "plain")
    # Three markers, each once: the texts themselves have none, and no marker can begin inside one and end in another.
    marked = pc.if_else(plain, f"{PREFIX}{SUFFIX}{MIDDLE}", output)
    pieces = pc.split_pattern_regex(marked, pattern=_MARKER)
    one, two, middle = (pc.list_element(pieces, i) for i in (1, 2, 3))
    spm = pc.equal(form, "spm")
    prefix, suffix = pc.if_else(spm, two, one), pc.if_else(spm, one, two)
    return pc.if_else(plain, output, pc.binary_join_element_wise(prefix, middle, suffix, ""))


def transformed(docs: DataFrame, seed: int = SEED) -> DataFrame:
    """(doc_id, n, form, prefix_chars, middle_chars, output), a row for each row of docs (doc_id, text).

    n counts the units; the chars are code points, null for the form plain. Null texts count as empty and stay plain, as
    do texts that hold a marker. Null ids draw as the empty text does; repeated rows get equal results; an empty table
    gives no rows. Texts are whole, whatever their length; a task holds about T.CHUNK_BYTES of them or one longer text.
    Other columns of docs are ignored.
    """
    T.ship(docs.sparkSession)
    rows = docs.select(
        docs["doc_id"].cast("long").alias("doc_id"), docs["text"].cast("string").alias("text"), *(d.alias(f"h{i}") for i, d in enumerate(draws(docs["doc_id"], seed)))
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, texts in T.chunked(batch.column(1)):
                part = batch.slice(lo, len(texts))
                made = transform(texts, part.columns[2:])
                yield pa.RecordBatch.from_arrays([part.column(0), *made.values()], names=["doc_id", *made])

    return rows.mapInArrow(run, "doc_id long, n long, form string, prefix_chars long, middle_chars long, output string")


def restored(rows: DataFrame) -> DataFrame:
    """Rows with columns `output` and `form`, and the column `restored` (in place of one of that name): the exact text."""
    T.ship(rows.sparkSession)
    kept = [c for c in rows.columns if c != "restored"]
    fields = [f"_c{i} {rows.schema[c].dataType.simpleString()}" for i, c in enumerate(kept)]
    output, form = kept.index("output"), kept.index("form")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, texts in T.chunked(batch.column(output)):
                part = batch.slice(lo, len(texts))
                text = rebuild(part.column(output), part.column(form))
                yield pa.RecordBatch.from_arrays([*part.columns, text], names=[*(f"_c{i}" for i in range(len(kept))), "restored"])

    found = rows.select(*[rows[c].alias(f"_c{i}") for i, c in enumerate(kept)]).mapInArrow(run, ", ".join([*fields, "restored string"]))
    return found.select(*[found[f"_c{i}"].alias(c) for i, c in enumerate(kept)], "restored")


ORACLE_SQL = """
WITH cut AS (
  SELECT doc_id, coalesce(text, '') AS text, sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS digest,
    regexp_extract_all(coalesce(text, ''), '[A-Za-z]+|[^A-Za-z]') AS u
  FROM documents
), drawn AS (
  SELECT *, CAST(len(u) AS BIGINT) AS n, CAST('0x' || substr(digest, 1, 8) AS BIGINT) AS h1, CAST('0x' || substr(digest, 9, 8) AS BIGINT) AS h2,
    CAST('0x' || substr(digest, 17, 8) AS BIGINT) AS h3, CAST('0x' || substr(digest, 25, 8) AS BIGINT) AS h4
  FROM cut
), bound AS (
  SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
    CASE WHEN text = '' OR regexp_matches(text, '<[PSM]>') OR h3 % 100 >= 90 THEN 'plain'
         WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form
  FROM drawn
), pieces AS (
  SELECT *, array_to_string(list_slice(u, 1, a), '') AS prefix, array_to_string(list_slice(u, a + 1, b), '') AS middle,
    array_to_string(list_slice(u, b + 1, n), '') AS suffix
  FROM bound
), made AS (
  SELECT *, CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle
    ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END AS output
  FROM pieces
)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN CAST(length(prefix) AS BIGINT) END AS prefix_chars,
  CASE WHEN form <> 'plain' THEN CAST(length(middle) AS BIGINT) END AS middle_chars,
  sha256(output) AS output_sha256, sha256(text) AS restored_sha256
FROM made
"""
