"""Small tables and plain-Python versions to compare with."""

from __future__ import annotations

import random

import numpy as np

SECOND = 1_000_000
ALERT_SCHEMA = "alert_id long, ts_us long, service string, severity string, message string, vec_id long"


def alert_rows(seed: int, n: int = 120, vectors: int = 6, span: int = 4000, hot: float = 0.34):
    """Random alerts; a third share one vector and one second. Times include ties and exact windows."""
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        crowded = rng.random() < hot
        at = 1000 if crowded else rng.randrange(0, span, 10)
        rows.append(
            (
                i,
                (at - span // 2) * SECOND,
                f"svc{rng.randrange(3)}-{rng.randrange(2)}",
                rng.choice(["FATAL", "ERROR", "WARN"]),
                f"message {i}",
                0 if crowded else rng.randrange(vectors),
            )
        )
    return rows


def vector_rows(seed: int, vectors: int = 6, dims: int = 4):
    """The last vector is zero; another is missing altogether."""
    rng = np.random.default_rng(seed)
    rows = [(v, [float(x) for x in rng.normal(size=dims)]) for v in range(vectors - 2)]
    return [*rows, (vectors - 1, [0.0] * dims)]


def alerts_df(spark, rows):
    from alertloom.functions.time import from_micros
    from pyspark.sql import functions as F

    df = spark.createDataFrame(rows, ALERT_SCHEMA)
    return df.withColumns(
        {
            "ts": from_micros(F.col("ts_us")),
            "source": F.lit("aiops"),
            "cleaned_message": F.col("message"),
        }
    )


def vectors_df(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<double>")


def similarity(vectors):
    units = {}
    for v, x in vectors:
        norm = np.linalg.norm(x)
        if norm:
            units[v] = np.array(x) / norm

    def sim(a, b):
        if a not in units or b not in units:
            return None
        return 1.0 if a == b else float(units[a] @ units[b])

    return sim


def brute_edges(rows, vectors, window_sec, threshold, cross=None):
    sim = similarity(vectors)
    ordered = sorted(rows, key=lambda r: (r[1], r[0]))
    edges = []
    for i, a in enumerate(ordered):
        for b in ordered[i + 1 :]:
            if b[1] - a[1] > window_sec * SECOND:
                break
            s = sim(a[5], b[5])
            if s is None:
                continue
            same = a[2].rsplit("-", 1)[0] == b[2].rsplit("-", 1)[0]
            if s >= (threshold if cross is None or same else cross):
                edges.append((a[0], b[0], s, b[5]))
    return edges


def union_find(nodes, edges):
    parent = {n: n for n in nodes}

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in edges:
        ra, rb = find(a), find(b)
        if ra != rb:
            parent[max(ra, rb)] = min(ra, rb)
    return {n: find(n) for n in nodes}
