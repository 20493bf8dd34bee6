"""Quality rules: plain counts with fixed limits, then a hashed n-gram model with a fixed threshold.

Counts per text (words are runs of bytes other than space and tab to carriage return): words, their code points,
characters of `[#*$%&|<>]`, lines with a word that equal an earlier line, and words in three-word windows that occur
twice or more. A text fails the base rules with too few words or too many repeated ones.

The model is a logistic regression over the relative frequencies of hashed words, word pairs and byte four-grams,
trained on documents with quality labels and calibrated by Platt's sigmoid on a fifth of them that training leaves
out. It scores Arrow batches; a text is kept at a calibrated probability of KEEP or more. Training reads at most
SAMPLE documents of each label, the first by a hash of the id and one row of each id; the driver gets their hashed
counts, of at most SAMPLE_COUNTS buckets together.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from alertloom.llm import texts as T
from alertloom.llm.toxicity import sample
from alertloom.session import durable

SAMPLE = 1500
SAMPLE_COUNTS = 32 << 20  # 8 bytes each
LEAST_WORDS = 50
MOST_REPEATED = 50  # percent of the words
KEEP = 0.5
BUCKETS = 1 << 15  # of each of the three kinds of n-gram
KINDS = 3
EPOCHS, RATE, L2 = 120, 0.05, 1e-4

_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True


def counts(chunk: list[bytes]) -> dict[str, np.ndarray]:
    """n_words, word_chars, n_symbols, n_dup_lines and n_repeat_words of each text."""
    buffer, bounds = T.laid_out(chunk)
    w = T.words(buffer, bounds)
    n = len(chunk)
    starts = np.concatenate([[0], np.cumsum((buffer & 0xC0) != 0x80)])  # code points before each byte
    chars = np.bincount(w.text, starts[w.end] - starts[w.start], n).astype(np.int64)
    symbols = np.concatenate([[0], np.cumsum(_SYMBOL[buffer])])
    h = T.run_hashes(buffer, w.start, w.end)
    repeated, lines = np.zeros(n, np.int64), np.zeros(n, np.int64)
    for i, text in enumerate(chunk):
        own = h[w.first[i] : w.first[i + 1]]
        if len(own) > 3:
            three = T.mix64(own[:-2] + T.mix64(own[1:-1] + T.mix64(own[2:])))
            order = np.argsort(three, kind="stable")
            ranked = three[order]
            same = ranked[1:] == ranked[:-1]
            if same.any():
                twice = np.zeros(len(three), bool)
                twice[order[1:][same]] = True
                twice[order[:-1][same]] = True
                inside = np.zeros(len(own), bool)
                for j in range(3):
                    inside[j : len(own) - 2 + j] |= twice
                repeated[i] = inside.sum()
        if b"\n" in text:
            full = [x for x in text.split(b"\n") if x.strip(b" \t\n\v\f\r")]
            lines[i] = len(full) - len(set(full))
    return {
        "n_words": np.diff(w.first).astype(np.int64),
        "word_chars": chars,
        "n_symbols": (symbols[bounds[1:]] - symbols[bounds[:-1]]).astype(np.int64),
        "n_dup_lines": lines,
        "n_repeat_words": repeated,
    }


def features(chunk: list[bytes]) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each kind of n-gram, (buckets, first): text i's are buckets[first[i]:first[i + 1]]."""
    buffer, bounds = T.laid_out(chunk)
    w = T.words(buffer, bounds)
    h = T.run_hashes(buffer, w.start, w.end)
    one = (h % np.uint64(BUCKETS)).astype(np.int32)
    if len(h) > 1:
        inside = w.text[1:] == w.text[:-1]
        two = (T.mix64(h[:-1] * np.uint64(3) + h[1:])[inside] % np.uint64(BUCKETS)).astype(np.int32)
    else:
        two = np.zeros(0, np.int32)
    pairs = np.maximum(np.diff(w.first) - 1, 0)
    wide = buffer.astype(np.uint32)
    four = (wide[:-3] << 24 | wide[1:-2] << 16 | wide[2:-1] << 8 | wide[3:]) if len(wide) > 3 else np.zeros(0, np.uint32)
    chars = ((four * np.uint32(2654435761)) >> np.uint32(17)).astype(np.int32)  # the upper 15 bits
    size = np.maximum(np.diff(bounds) - 4, 0)  # without the layout's line feed
    inside = np.zeros(len(four) + 1, np.int32)
    begin = bounds[:-1][size > 0]
    np.add.at(inside, begin, 1)
    np.add.at(inside, begin + size[size > 0], -1)
    chars = chars[np.cumsum(inside[:-1]) > 0]
    ends = lambda k: np.concatenate([[0], np.cumsum(k)])
    return [(one, w.first), (two, ends(pairs)), (chars, ends(size))]


@dataclass
class Model:
    weights: np.ndarray  # (KINDS, BUCKETS)
    bias: float
    slope: float  # calibration: p = logistic(slope * z + shift)
    shift: float

    def probabilities(self, chunk: list[bytes]) -> np.ndarray:
        z = np.full(len(chunk), self.bias)
        for kind, (buckets, first) in enumerate(features(chunk)):
            total = T.per_text(self.weights[kind][buckets], first).astype(np.float64)
            z += total / np.maximum(np.diff(first), 1)
        return 1 / (1 + np.exp(-np.clip(self.slope * z + self.shift, -500, 500)))


def _counted(chunk: list[bytes]) -> dict[str, pa.Array]:
    keys, shares, sizes = [], [], np.zeros(len(chunk), np.int64)
    found = features(chunk)
    for i in range(len(chunk)):
        for kind, (buckets, first) in enumerate(found):
            own, times = np.unique(buckets[first[i] : first[i + 1]], return_counts=True)
            keys.append(own + kind * BUCKETS)
            shares.append((times / max(1, times.sum())).astype(np.float32))
            sizes[i] += len(own)
    offsets = pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32))
    flat = lambda parts, kind: pa.array(np.concatenate(parts).astype(kind) if parts else np.zeros(0, kind))
    return {
        "keys": pa.ListArray.from_arrays(offsets, flat(keys, np.int32)),
        "shares": pa.ListArray.from_arrays(offsets, flat(shares, np.float32)),
    }


def _logistic(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -500, 500)))


def fit_counts(keys: np.ndarray, shares: np.ndarray, first: np.ndarray, y: np.ndarray, prior: float) -> Model:
    """A model of sparse rows; prior is the share of label 1 among all that are labelled."""
    kept = np.arange(len(y)) % 5 != 4  # the rest calibrates
    row = np.repeat(np.arange(len(y)), np.diff(first))
    # Frequencies are small numbers: in units of each bucket's root mean square, all weights move alike.
    scale = np.sqrt(np.bincount(keys, shares.astype(np.float64) ** 2, KINDS * BUCKETS) / max(len(y), 1))
    unit = np.where(scale > 0, 1 / np.maximum(scale, 1e-6), 0.0)
    x = (shares * unit[keys]).astype(np.float32)
    rows = np.maximum(np.bincount(keys, minlength=KINDS * BUCKETS), 1)
    few = np.sqrt(np.minimum(rows / max(len(y), 1), 1.0))  # buckets of few texts get smaller steps
    balance = np.where(y == 1, 0.5 / max((y == 1).sum(), 1), 0.5 / max((y == 0).sum(), 1)) * kept
    w, b = np.zeros(KINDS * BUCKETS), 0.0
    m, v = np.zeros_like(w), np.zeros_like(w)
    norm = max(1e-6, float(np.sqrt(np.bincount(row, x.astype(np.float64) ** 2, len(y))).mean()))
    x = x / np.float32(norm)
    for step in range(1, EPOCHS + 1):
        z = np.bincount(row, x * w[keys], len(y)) + b
        g = (_logistic(z) - y) * balance
        grad = np.bincount(keys, x * g[row], len(w)) + L2 * w
        m, v = 0.9 * m + 0.1 * grad, 0.99 * v + 0.01 * grad**2
        w -= RATE * few * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-10)
        b -= RATE * g.sum()
    z = np.bincount(row, x * w[keys], len(y)) + b
    slope, shift = _platt(z[~kept], y[~kept], prior)
    return Model((w * unit / norm).reshape(KINDS, BUCKETS).astype(np.float32), float(b), slope, shift)


def _platt(z: np.ndarray, y: np.ndarray, prior: float) -> tuple[float, float]:
    """Newton's method for p = logistic(slope * z + shift), with Platt's smoothed targets and the labels' true shares."""
    n1, n0 = float((y == 1).sum()), float((y == 0).sum())
    if not n1 or not n0:
        return 1.0, 0.0
    target = np.where(y == 1, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    share = np.where(y == 1, prior / n1, (1 - prior) / n0) * len(y)
    a, c = 1.0, 0.0
    for _ in range(50):
        p = _logistic(a * z + c)
        g, s = (p - target) * share, p * (1 - p) * share + 1e-9
        ga, gc = (g * z).sum() + 1e-3 * (a - 1), g.sum()
        haa, hac, hcc = (s * z * z).sum() + 1e-3, (s * z).sum(), s.sum() + 1e-6
        det = haa * hcc - hac**2
        da, dc = (hcc * ga - hac * gc) / det, (haa * gc - hac * ga) / det
        a, c = a - np.clip(da, -1, 1), c - np.clip(dc, -2, 2)
    return float(max(a, 1e-3)), float(c)


def fit(docs: DataFrame, labels: DataFrame, most: int = SAMPLE) -> Model:
    """A model of docs (doc_id, text) by labels (doc_id, y); without both labels, it keeps every text."""
    rows, held = sample(docs.select(docs["doc_id"], docs["text"]), labels, most)
    counted = T.over_texts(rows, "text", _counted, "keys array<int>, shares array<float>", ["doc_id", "y"])
    counted = durable(counted.withColumn("_items", F.size("keys")))
    got = T.within(counted, "doc_id", "_items", SAMPLE_COUNTS).toArrow()
    got = got.take(pa.array(np.argsort(got["doc_id"].to_numpy(), kind="stable"))).combine_chunks()
    y = got["y"].to_numpy().astype(np.int64)
    if len(np.unique(y)) < 2:
        return Model(np.zeros((KINDS, BUCKETS), np.float32), 0.0, 1.0, 0.0)
    first = np.concatenate([[0], np.cumsum(np.asarray(pc.list_value_length(got["keys"])).astype(np.int64))])
    flat = lambda name: np.asarray(pa.chunked_array(got[name]).combine_chunks().flatten())
    return fit_counts(flat("keys"), flat("shares"), first, y, held[1] / (held[0] + held[1]))


def judged(docs: DataFrame, model: Model) -> DataFrame:
    """docs with the five counts, base_failed, probability and kept.

    Null and empty texts have counts of 0 and fail the base rules. Columns of docs stay, but for those of these names,
    which are replaced; repeated rows get equal results.
    """

    def run(chunk: list[bytes]) -> dict[str, pa.Array]:
        c = counts(chunk)
        p = model.probabilities(chunk)
        failed = (c["n_words"] < LEAST_WORDS) | (100 * c["n_repeat_words"] > MOST_REPEATED * c["n_words"])
        made = {name: pa.array(values) for name, values in c.items()}
        return made | {"base_failed": pa.array(failed), "probability": pa.array(p), "kept": pa.array(~failed & (p >= KEEP))}

    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    docs = docs.drop(*names, "base_failed", "probability", "kept")
    schema = ", ".join([*(f"{n} long" for n in names), "base_failed boolean, probability double, kept boolean"])
    return T.over_texts(docs, "text", run, schema, docs.columns)
