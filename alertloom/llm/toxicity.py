"""Toxicity by multiple-instance learning.

A document is a bag of sentences. A sentence's score is a logistic function of the hashed words in it; a document is
toxic unless every sentence is clean, so its score is the noisy-or 1 - prod(1 - p(sentence)). Weights are fitted on
document labels only, and the same sentence scores then say where the offence is.

Sentences end at `.`, `!`, `?` or a line feed; words are runs of ASCII letters, digits and non-ASCII bytes, A-Z
lower-cased. Fitting reads a sample of at most SAMPLE documents of each label, the first by a hash of the id; its
driver sees counts by hashed word, and of the documents only their telling words, of at most SAMPLE_ITEMS words and
sentences together. Of several rows of one id the sample has one.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from alertloom.llm import texts as T
from alertloom.session import durable

SAMPLE = 4000
SAMPLE_ITEMS = 64 << 20  # 4 bytes each
BUCKETS = 1 << 18
EPOCHS, RATE = 200, 0.1
L1 = 0.3  # a bucket gets a weight only if it would explain more than so many toxic documents

_WORD = np.zeros(256, bool)
_WORD[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True
_STOP = np.zeros(256, bool)
_STOP[list(b".!?\n")] = True


@dataclass
class Model:
    weights: np.ndarray  # float32, by bucket
    bias: float


def bags(chunk: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(buckets, first word of each sentence, first sentence of each text, and the sentences' byte bounds)."""
    buffer, bounds = T.laid_out(chunk)
    buffer = T.LOWER[buffer]
    edges = np.flatnonzero(np.diff(_WORD[buffer].view(np.int8), prepend=np.int8(0)))
    start, end = edges[0::2], edges[1::2]
    buckets = (T.run_hashes(buffer, start, end) % np.uint64(BUCKETS)).astype(np.int32)
    stops = np.concatenate([[0], np.flatnonzero(_STOP[buffer]) + 1])  # every text ends with a stop
    words_in = np.searchsorted(start, stops)
    real = np.flatnonzero(np.diff(words_in))  # sentences with a word
    first_word = np.concatenate([words_in[real], [len(start)]])
    first_sentence = np.searchsorted(stops[real], bounds) if len(real) else np.zeros(len(bounds), np.int64)
    return buckets, first_word, first_sentence, stops[real], stops[real + 1]


def sentence_scores(model: Model, buckets: np.ndarray, first_word: np.ndarray) -> np.ndarray:
    z = T.per_text(model.weights[buckets].astype(np.float64), first_word) + model.bias
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def noisy_or(p: np.ndarray, first: np.ndarray) -> np.ndarray:
    """1 - prod(1 - p) over each text's sentences; 0 for a text without any."""
    return -np.expm1(T.per_text(np.log1p(-np.minimum(p, 1 - 1e-12)), first))


def telling(held: np.ndarray, hits: np.ndarray, n: int, k: int) -> np.ndarray:
    """Buckets that toxic documents hold more often than chance explains (G-test, corrected for the number tried).

    held and hits count the documents, and the toxic ones, with each bucket; n and k count all of them.
    """
    g = np.zeros(len(held))
    for seen, total in ((hits, held * k / n), (held - hits, held * (n - k) / n), (k - hits, (n - held) * k / n), (n - k - held + hits, (n - held) * (n - k) / n)):
        with np.errstate(divide="ignore", invalid="ignore"):
            g += 2 * np.where(seen > 0, seen * np.log(seen / total), 0.0)
    return (hits * n > held * k) & (g > 2 * np.log(max(2, (held > 0).sum())) + 3)


def fit_bags(words, first_word, first_sentence, y, weight, n: int) -> tuple[np.ndarray, float]:
    """Proximal Adam on the noisy-or likelihood over n words; weight is each document's share in the loss."""
    sentences = np.diff(first_word)
    owner = np.repeat(np.arange(len(y)), np.diff(first_sentence))
    l1 = L1 * weight[y == 1].mean()
    w, b = np.zeros(n), -4.0
    m, v, mb, vb = np.zeros(n), np.zeros(n), 0.0, 0.0
    for step in range(1, EPOCHS + 1):
        z = T.per_text(w[words], first_word) + b
        p = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
        doc = np.clip(noisy_or(p, first_sentence), 1e-9, 1 - 1e-12)
        pull = np.where(y == 1, -(1 - doc) / doc, 1.0) * weight
        g = pull[owner] * p
        grad, gb = np.bincount(words, np.repeat(g, sentences), n), g.sum()
        m, v = 0.9 * m + 0.1 * grad, 0.99 * v + 0.01 * grad**2
        mb, vb = 0.9 * mb + 0.1 * gb, 0.99 * vb + 0.01 * gb**2
        a, c = 1 - 0.9**step, 1 - 0.99**step
        scale = RATE / (np.sqrt(v / c) + 1e-8)
        w = w - scale * m / a
        w = np.sign(w) * np.maximum(np.abs(w) - scale * l1, 0)
        b -= RATE * (mb / a) / (np.sqrt(vb / c) + 1e-8)
    return w, float(b)


def _distinct(chunk: list[bytes]) -> dict[str, pa.Array]:
    """The buckets of each text, once each."""
    buckets, first_word, first_sentence, _, _ = bags(chunk)
    per_doc = first_word[first_sentence]
    own = [np.unique(buckets[a:b]) for a, b in zip(per_doc[:-1], per_doc[1:], strict=True)]
    offsets = pa.array(np.concatenate([[0], np.cumsum([len(x) for x in own])]).astype(np.int32))
    return {"bucket": pa.ListArray.from_arrays(offsets, pa.array(np.concatenate(own)))}


def _counted(code: np.ndarray):
    """Of each text, how many telling words its sentences have, and those words by their code (-1: not telling)."""

    def run(chunk: list[bytes]) -> dict[str, pa.Array]:
        buckets, first_word, first_sentence, _, _ = bags(chunk)
        known = code[buckets] >= 0
        words = code[buckets[known]]
        first_word = np.concatenate([[0], np.cumsum(known)])[first_word]
        per_doc = first_word[first_sentence]
        return {
            "words": pa.ListArray.from_arrays(pa.array(per_doc.astype(np.int32)), pa.array(words)),
            "sizes": pa.ListArray.from_arrays(pa.array(first_sentence.astype(np.int32)), pa.array(np.diff(first_word).astype(np.int32))),
        }

    return run


def sample(docs: DataFrame, labelled: DataFrame, most: int) -> tuple[DataFrame, dict[int, int]]:
    """(doc_id, y, text of at most `most` documents of each label of labelled (doc_id, y), how many each label has).

    Of an id with several rows, the first text in order.
    """
    counts = {r["y"]: r["n"] for r in labelled.groupBy("y").agg(F.count("*").alias("n")).collect()}
    picked = [labelled.where(F.col("y") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most) for y in (0, 1)]
    rows = docs.select("doc_id", "text").join(F.broadcast(picked[0].unionByName(picked[1])), "doc_id")  # at most 2 * most narrow rows
    return rows.groupBy("doc_id", "y").agg(F.min("text").alias("text")), counts


def fit(docs: DataFrame, labels: DataFrame, most: int = SAMPLE) -> Model:
    """A model from the documents whose id is in labels (doc_id, y); every text is clean to it if there are none."""
    rows, counts = sample(docs.select(docs["doc_id"], docs["text"]), labels, most)
    rows = durable(rows)  # read twice: what tells is counted first, and only that is gathered
    spread = T.over_texts(rows, "text", _distinct, "bucket array<int>", ["y"]).select("y", F.explode("bucket").alias("bucket"))
    seen = spread.groupBy("bucket").agg(F.count("*").alias("held"), F.sum("y").alias("hits")).toArrow()
    held, hits = np.zeros(BUCKETS, np.int64), np.zeros(BUCKETS, np.int64)
    held[seen["bucket"].to_numpy()], hits[seen["bucket"].to_numpy()] = seen["held"].to_numpy(), seen["hits"].to_numpy()
    of = {r["y"]: r["n"] for r in rows.groupBy("y").agg(F.count("*").alias("n")).collect()}
    if not of.get(1):  # none of them is in docs
        return Model(np.zeros(BUCKETS, np.float32), -30.0)
    known = telling(held, hits, sum(of.values()), of[1])
    code = np.where(known, np.cumsum(known) - 1, -1).astype(np.int32)
    counted = T.over_texts(rows, "text", _counted(code), "words array<int>, sizes array<int>", ["doc_id", "y"])
    counted = durable(counted.withColumn("_items", F.size("words") + F.size("sizes")))
    got = T.within(counted, "doc_id", "_items", SAMPLE_ITEMS).toArrow()
    got = got.take(pa.array(np.argsort(got["doc_id"].to_numpy(), kind="stable"))).combine_chunks()
    y = got["y"].to_numpy().astype(np.int64)
    if not (y == 1).any():
        return Model(np.zeros(BUCKETS, np.float32), -30.0)
    of = {c: int((y == c).sum()) for c in (0, 1)}
    flat = lambda name: np.asarray(pa.chunked_array(got[name]).combine_chunks().flatten())
    first_word = np.concatenate([[0], np.cumsum(flat("sizes"))])
    first_sentence = np.concatenate([[0], np.cumsum(np.asarray(pc.list_value_length(got["sizes"])).astype(np.int64))])
    share = np.array([counts.get(c, 0) / max(of.get(c, 0), 1) for c in (0, 1)])
    weight = share[y] / share[y].sum()
    found, bias = fit_bags(flat("words"), first_word, first_sentence, y, weight, int(known.sum()))
    weights = np.zeros(BUCKETS, np.float32)
    weights[known] = found
    return Model(weights, bias)


def scored(docs: DataFrame, model: Model, at: float = 0.5) -> DataFrame:
    """docs with `toxic_score` and `offences`: the sentences that score `at` or more, in order.

    An offence is (start, length, score) in characters of the text. Null and empty texts, and those without a word,
    score 0. Columns of docs stay as they are, but for earlier ones of the two names, which are replaced.
    """

    def run(chunk: list[bytes]) -> dict[str, pa.Array]:
        buckets, first_word, first_sentence, begin, stop = bags(chunk)
        p = sentence_scores(model, buckets, first_word)
        score = noisy_or(p, first_sentence)
        _, bounds = T.laid_out(chunk)
        found: list[list[dict]] = [[] for _ in chunk]
        for s in np.flatnonzero(p >= at):
            i = int(np.searchsorted(first_sentence, s, "right")) - 1
            lo, hi = int(begin[s] - bounds[i]), int(min(stop[s] - bounds[i], len(chunk[i])))
            text = chunk[i]
            found[i].append({"start": len(text[:lo].decode()), "length": len(text[lo:hi].decode()), "score": float(p[s])})
        kind = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("score", pa.float64())]))
        return {"toxic_score": pa.array(np.clip(score, 0.0, 1.0)), "offences": pa.array(found, kind)}

    docs = docs.drop("toxic_score", "offences")
    return T.over_texts(
        docs,
        "text",
        run,
        "toxic_score double, offences array<struct<start:bigint,length:bigint,score:double>>",
        docs.columns,
    )
