"""Quality classifier: regularised quadratic discriminant over document statistics.

Each text becomes a vector of transformed statistics (logs of sizes, logits of shares). Each class - label 0, label 1 -
is a Gaussian with its own mean and a shrinkage covariance: the class's own, blended with the pooled one and with its
diagonal. A document's score is the logistic of the difference of the classes' log densities, from Mahalanobis
distances by the classes' Cholesky factors, which are made once and sent along, plus the log ratio of the priors.

Fitting reads the statistics of all labelled rows: sums and sums of products are added up by Spark, and the driver gets
one number for each entry.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from alertloom.llm import texts as T

POOLED = 0.1  # weight of the pooled covariance in a class's
DIAGONAL = 0.05  # weight of the diagonal
CLIP = 8.0  # standard deviations of label 1 beyond which a statistic counts no further
FEATURES = [
    "log_bytes", "log_words", "word_length", "upper", "digits", "symbols", "bangs", "stops", "commas", "bars", "high",
    "lines", "capital_words", "distinct_words", "top_word", "repeat_triples", "ends", "single",
]

_CLASS = np.zeros((256, 9), np.float32)
_CLASS[65:91, 0] = 1
_CLASS[48:58, 1] = 1
_CLASS[list(b"#*$%&<>@^~=_{}[]"), 2] = 1
_CLASS[list(b"!?"), 3] = 1
_CLASS[list(b"."), 4] = 1
_CLASS[list(b","), 5] = 1
_CLASS[list(b"|"), 6] = 1
_CLASS[128:, 7] = 1
_CLASS[list(b"\n"), 8] = 1
_KIND = np.where(_CLASS.any(axis=1), _CLASS.argmax(axis=1), 9).astype(np.int64)


def _share(part: np.ndarray, whole: np.ndarray) -> np.ndarray:
    """Logit of a share, smoothed by half a case."""
    return np.log((part + 0.5) / (np.maximum(whole - part, 0) + 0.5))


def statistics(chunk: list[bytes]) -> np.ndarray:
    """A row of FEATURES for each text; texts without words get those of counts of zero."""
    buffer, bounds = T.laid_out(chunk)
    n = len(chunk)
    w = T.words(buffer, bounds)
    size = np.diff(bounds) - 1
    owner = np.repeat(np.arange(n), np.diff(bounds))
    kinds = np.bincount(owner * 10 + _KIND[buffer], minlength=10 * n).reshape(n, 10).astype(np.float64)
    kinds[:, 8] -= 1  # the layout's own line feed
    words = np.diff(w.first).astype(np.float64)
    inside = np.bincount(w.text, w.end - w.start, n)
    h = T.run_hashes(buffer, w.start, w.end)
    capital = np.bincount(w.text, (buffer[w.start] >= 65) & (buffer[w.start] <= 90), n) if len(h) else np.zeros(n)
    last = buffer[w.end - 1] if len(h) else np.zeros(0, np.uint8)
    ends = np.bincount(w.text, ~(((last >= 97) & (last <= 122)) | ((last >= 65) & (last <= 90)) | (last >= 128)), n)
    single = np.bincount(w.text, (w.end - w.start) == 1, n)
    distinct, top, triples = np.zeros(n), np.zeros(n), np.zeros(n)
    for i in range(n):
        own = h[w.first[i] : w.first[i + 1]]
        if len(own):
            _, times = np.unique(own, return_counts=True)
            distinct[i], top[i] = len(times), times.max()
        if len(own) > 2:
            three = own[:-2] * np.uint64(3) + own[1:-1] * np.uint64(5) + own[2:] * np.uint64(7)
            triples[i] = len(three) - len(np.unique(three))
    columns = [
        np.log1p(size), np.log1p(words), np.log1p(inside / np.maximum(words, 1)), _share(kinds[:, 0], size), _share(kinds[:, 1], size),
        _share(kinds[:, 2], size), _share(kinds[:, 3], size), _share(kinds[:, 4], size), _share(kinds[:, 5], size), _share(kinds[:, 6], size),
        _share(kinds[:, 7], size), _share(kinds[:, 8], size), _share(capital, words), _share(distinct, words), _share(top, words),
        _share(triples, words), _share(ends, words), _share(single, words),
    ]
    return np.stack(columns, axis=1) if n else np.zeros((0, len(FEATURES)))


@dataclass
class Model:
    center: np.ndarray
    spread: np.ndarray
    means: np.ndarray  # by label
    factors: list[np.ndarray]  # inverse Cholesky factors, by label
    logs: np.ndarray  # log priors less half the log determinants

    def scores(self, x: np.ndarray) -> np.ndarray:
        if not self.factors:
            return np.full(len(x), float(self.logs[1]))
        z = np.clip((x - self.center) / self.spread, -CLIP, CLIP)
        logs = [self.logs[c] - 0.5 * (((z - self.means[c]) @ self.factors[c].T) ** 2).sum(axis=1) for c in (0, 1)]
        return 1 / (1 + np.exp(np.clip(logs[0] - logs[1], -500, 500)))


def _sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each label, a count, sums and sums of products of a task's rows of z (with a one in front)."""
    total = None
    for batch in batches:
        y = batch.column(0).to_numpy()
        x = np.asarray(batch.column(1).flatten()).reshape(len(y), -1)
        z = np.concatenate([np.ones((len(y), 1)), x], axis=1)
        own = np.stack([z[y == c].T @ z[y == c] for c in (0, 1)])
        total = own if total is None else total + own
    if total is not None:
        flat = total.ravel()
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(flat), dtype=np.int32)), pa.array(flat)], names=["entry", "value"])


def _moments(rows: DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(count, mean, covariance) by label of rows (y, x)."""
    d = len(FEATURES) + 1
    got = rows.select("y", "x").mapInArrow(T.released(_sums), "entry int, value double").groupBy("entry").agg(F.sum("value").alias("value")).collect()
    total = np.zeros(2 * d * d)
    for r in got:
        total[r["entry"]] = r["value"]
    total = total.reshape(2, d, d)
    n = total[:, 0, 0]
    safe = np.maximum(n, 1)
    mean = total[:, 0, 1:] / safe[:, None]
    cov = np.stack([total[c, 1:, 1:] / safe[c] - np.outer(mean[c], mean[c]) for c in (0, 1)])
    return n, mean, cov


def with_statistics(docs: DataFrame) -> DataFrame:
    """docs with `x`, an array<double> of FEATURES, in place of the text."""

    def run(chunk: list[bytes]) -> dict[str, pa.Array]:
        x = statistics(chunk)
        offsets = pa.array(np.arange(0, x.size + 1, len(FEATURES), dtype=np.int32))
        return {"x": pa.ListArray.from_arrays(offsets, pa.array(x.ravel()))}

    return T.over_texts(docs, "text", run, "x array<double>")


def fit(rows: DataFrame) -> Model:
    """A model of rows (y, x); with rows of one label only, that label's score is 1 or 0 for all, with none 0.5."""
    n, mean, cov = _moments(rows)
    d = len(FEATURES)
    if not n.all():
        prior = 0.5 if not n.any() else float(n[1] > 0)
        return Model(np.zeros(d), np.ones(d), mean, [], np.array([1 - prior, prior]))
    # In units of label 1, clipped: far outliers must not widen a class without end.
    center, spread = mean[1], np.sqrt(np.maximum(np.diagonal(cov[1]), 1e-4))

    def clip(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.asarray(batch.column(1).flatten()).reshape(batch.num_rows, d)
            z = np.clip((x - center) / spread, -CLIP, CLIP)
            offsets = pa.array(np.arange(0, z.size + 1, d, dtype=np.int32))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(offsets, pa.array(z.ravel()))], names=["y", "x"])

    n, mean, cov = _moments(rows.select("y", "x").mapInArrow(T.released(clip), "y int, x array<double>"))
    pooled = (n[0] * cov[0] + n[1] * cov[1]) / n.sum()
    factors, logs = [], np.zeros(2)
    for c in (0, 1):
        blend = (1 - POOLED) * cov[c] + POOLED * pooled
        blend = (1 - DIAGONAL) * blend + DIAGONAL * np.diag(np.diagonal(blend)) + 1e-3 * np.eye(d)
        lower = np.linalg.cholesky(blend)
        factors.append(np.linalg.inv(lower))
        logs[c] = np.log(n[c] / n.sum()) - np.log(np.diagonal(lower)).sum()
    return Model(center, spread, mean, factors, logs)


def scored(rows: DataFrame, model: Model) -> DataFrame:
    """rows (..., x) with quality_score (0 to 1) in place of x."""
    kept = [c for c in rows.columns if c != "x"]
    source = rows.select(*[rows[c].alias(f"k{i}") for i, c in enumerate(kept)], rows["x"])
    schema = ", ".join([*(f"k{i} {source.schema[i].dataType.simpleString()}" for i in range(len(kept))), "quality_score double"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.asarray(batch.column(len(kept)).flatten()).reshape(batch.num_rows, len(FEATURES))
            names = [*(f"k{i}" for i in range(len(kept))), "quality_score"]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(kept)], pa.array(model.scores(x))], names=names)

    out = source.mapInArrow(T.released(run), schema)
    return out.select(*[out[f"k{i}"].alias(c) for i, c in enumerate(kept)], "quality_score")


def scored_texts(docs: DataFrame, model: Model) -> DataFrame:
    """docs with quality_score, in one pass over the texts; an earlier column of that name is replaced."""
    docs = docs.drop("quality_score")
    run = lambda chunk: {"quality_score": pa.array(model.scores(statistics(chunk)))}
    return T.over_texts(docs, "text", run, "quality_score double", docs.columns)


def classified(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, quality_score) for each row of docs (doc_id, text), by a model of its rows with labels (doc_id, y).

    Null and empty texts are scored from counts of zero; null ids are scored, never learned; repeated rows get equal
    scores. Other columns are ignored; an empty table gives no rows.
    """
    from alertloom.session import durable

    rows = durable(with_statistics(docs.select(docs["doc_id"], docs["text"])))
    return scored(rows, fit(rows.join(labels, "doc_id")))
