"""Which alerts belong together: close in time and similar in meaning.

Two alerts link when they are at most `window` apart and the cosine of their
vectors reaches a threshold. The pairs themselves grow with the square of a busy
minute, so they are never written out:

* Alerts carry a vector id, and alerts with the same template share it. Two of
  them in the same time bucket (width = window) always link, so one *cell* per
  (vector, bucket) stands for all of them. Cells come out of a map-side combined
  aggregation; a hot key costs one row per task.
* Cells of a vector that follow each other within the window chain into *runs*.
  A vector has at most (time range / window) cells, however many rows it has.
* Alerts a window or less apart lie in one bucket or in neighbouring ones. So each
  bucket's cells are compared with each other and with those of the next bucket,
  and with nothing else: vectors that are never active near each other never meet.
  A bucket is cut into blocks of at most about BLOCK cells, and a task has one pair of blocks.
* For components, a pair of blocks gives a spanning forest of its links, at most one
  edge a cell. Cells known to be connected are not compared any more, so that the work
  follows the cells, not their square, where components are few and dense.
  For the graph itself, it gives the similar vectors of each cell.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from alertloom.functions.text import base_service
from alertloom.functions.time import bucket, long_lit
from alertloom.functions.vectors import linkable
from alertloom.operators.ordering import running_sum
from alertloom.session import durable

# Cells of up to 64 numbers in a block, fewer of longer vectors; bounds the memory of a task, not the result.
BLOCK = 131072
# Similarities that a task has at once.
TILE = 1 << 21
# Most alerts that a cell takes along when it is compared.
CROWD = 256


def window_micros(window_sec: float) -> int:
    return int(round(window_sec * 1_000_000))


def with_bucket(alerts: DataFrame, window_us: Column) -> DataFrame:
    return alerts.withColumn("bucket", bucket(F.col("ts_us"), window_us))


def cells(alerts: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One row per key and bucket. Needs `ts_us`, `alert_id`, `window_us` and the key columns."""
    return (
        with_bucket(alerts, F.col("window_us"))
        .groupBy(*keys, "bucket")
        .agg(
            F.min("alert_id").alias("first_id"),
            F.min("ts_us").alias("first_us"),
            F.max("ts_us").alias("last_us"),
            F.count("*").alias("n"),
            F.first("window_us").alias("window_us"),
        )
    )


def runs(cells_: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Add `run`, the first bucket of the chain that the cell is part of."""
    along = W.partitionBy(*keys).orderBy("bucket")
    gap = F.col("first_us") - F.lag("last_us").over(along)
    start = F.when(gap.isNull() | (gap > F.col("window_us")), F.col("bucket"))
    return cells_.withColumn("_start", start).withColumn(
        "run", F.max("_start").over(along.rowsBetween(W.unboundedPreceding, 0))
    ).drop("_start")


def _seated(cells_: DataFrame, vectors: DataFrame, by: Sequence[str], both: bool = False) -> DataFrame:
    """Cells with their vectors, once for each pair of blocks (i, j) of a bucket, `anchor`, that they take part in.

    Block i holds cells of the bucket itself, block j such ones or, as `ahead`, cells of the next bucket. Cells of the
    bucket meet in one of (i, j) and (j, i), or in `both`.
    """
    group = [*by, "window_us", "anchor"]
    roles = F.array(
        F.struct(F.col("bucket").alias("anchor"), F.lit(0).alias("ahead")),
        F.struct((F.col("bucket") - 1).alias("anchor"), F.lit(1).alias("ahead")),
    )
    placed = cells_.select("*", F.inline(roles))
    # A bucket without cells of its own has no left side.
    counted = placed.groupBy(*group).agg(F.count("*").alias("_cells"), F.min("ahead").alias("_left")).where("_left = 0")
    wide = F.greatest(F.lit(1.0), vectors.agg(F.max(F.size("embedding"))).scalar() / 64)
    blocks = counted.withColumn("blocks", F.ceil(F.col("_cells") * wide / BLOCK)).drop("_cells")
    spread = (
        placed.join(blocks.drop("_left"), group)
        .join(vectors, "vec_id")
        .withColumn("block", F.pmod(F.xxhash64("vec_id"), F.col("blocks")))
        .withColumn("k", F.explode(F.sequence(long_lit(0), F.col("blocks") - 1)))
    )
    as_left = F.struct(F.col("block").alias("i"), F.col("k").alias("j"))
    as_right = F.struct(F.col("k").alias("i"), F.col("block").alias("j"))
    seats = (
        F.when(F.col("ahead") == 1, F.array(as_right))
        .when(F.col("k") != F.col("block") if both else F.col("k") < F.col("block"), F.array(as_left, as_right))
        .otherwise(F.array(as_left))
    )
    return spread.select("*", F.inline(seats))


def _by_cell(function, keys: Sequence[str], names: Sequence[str]):
    """Run function on the rows of each key, for rows that come sorted by the keys; its rows get the columns `names`.

    The function gets a dictionary of arrays and yields lists of arrays. Small groups cost little this way, and a
    task holds one batch and the group that goes on from it.
    """
    # Nothing of this package is named inside, so executors need not have it installed.
    keys, names, most = list(keys), list(names), TILE // 8

    def run(batches):
        def handled(columns: dict, cuts: list[int]) -> Iterator[pa.RecordBatch]:
            made, n = [[] for _ in [*keys, *names]], 0

            def batch() -> pa.RecordBatch:
                whole = [np.concatenate(v) for v in made]
                arrays = [pa.array(v.tolist() if v.dtype == object else v) for v in whole]
                return pa.RecordBatch.from_arrays(arrays, names=[*keys, *names])

            for x, y in zip(cuts, cuts[1:]):
                for found in function({c: v[x:y] for c, v in columns.items()}):
                    for at, k in enumerate(keys):
                        made[at].append(np.repeat(columns[k][x : x + 1], len(found[0])))
                    for at, values in enumerate(found):
                        made[len(keys) + at].append(values)
                    n += len(found[0])
                    if n > most:
                        yield batch()
                        made, n = [[] for _ in made], 0
            if n:
                yield batch()

        # The group that goes on is kept in parts and put together once.
        held = []
        for batch in batches:
            frame = batch.to_pandas()
            if not len(frame):
                continue
            change = np.zeros(len(frame), bool)
            for c in [*keys, "window_us", "anchor", "i", "j"]:
                values = frame[c].to_numpy()
                change[1:] |= values[1:] != values[:-1]
                if held:
                    change[0] |= values[0] != held[-1][c].iloc[-1]
            cuts = np.flatnonzero(change).tolist()
            if cuts:
                whole = pd.concat([*held, frame.iloc[: cuts[-1]]], ignore_index=True)
                before = sum(len(h) for h in held)
                starts = [c + before for c in cuts]
                yield from handled({c: whole[c].to_numpy() for c in whole.columns}, [0, *[c for c in starts if c > 0]])
                held = []
            held.append(frame.iloc[cuts[-1] if cuts else 0 :])
        if held:
            whole = pd.concat(held, ignore_index=True)
            yield from handled({c: whole[c].to_numpy() for c in whole.columns}, [0, len(whole)])

    return run


def _compare(
    cells_: DataFrame, vectors: DataFrame, by: Sequence[str], function, names: Sequence[str], schema: str, both: bool = False
) -> DataFrame:
    cell = [*by, "window_us", "anchor", "i", "j"]
    seated = _seated(cells_, vectors, by, both).repartition(*cell).sortWithinPartitions(*cell)
    return seated.mapInArrow(_by_cell(function, by, names), schema)


def _units():
    def units(vectors: np.ndarray) -> np.ndarray:
        matrix = np.stack(vectors).astype(np.float64)
        return matrix / np.linalg.norm(matrix, axis=1, keepdims=True)

    return units


def _similar():
    def similar(short: np.ndarray, shorts: np.ndarray, exact, least: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Places (r, c) of unit vectors, by r and c, whose cosine is `least` or more, and the cosine.

        Products of `short` and `shorts`, of 32 bits, leave the pairs that may be meant; exact(r, c) has their vectors.
        """
        # A product of n parts is off by less than (n + 4) * 2^-24 for unit vectors.
        meant = short @ shorts.T >= np.float32(least - (short.shape[1] + 8) * 2.0**-23)
        r = np.repeat(np.arange(len(short)), np.count_nonzero(meant, axis=1))
        c = np.flatnonzero(meant) - r * len(shorts)
        sims = np.empty(len(r))
        # Few at a time, so that the vectors stay in the processor's cache.
        for x in range(0, len(r), 1 << 11):
            some = slice(x, x + (1 << 11))
            sims[some] = np.einsum("ij,ij->i", *exact(r[some], c[some]))
        sure = sims >= least
        return (r, c, sims) if sure.all() else (r[sure], c[sure], sims[sure])

    return similar


def _side_cells():
    def sides(rows: dict) -> tuple[np.ndarray, np.ndarray, bool]:
        """The cells of block i and of block j, which of them are left (of block i), and if the left ones meet each other."""
        i, j = rows["i"][0], rows["j"][0]
        own = rows["ahead"] == 0
        left = own & (rows["block"] == i)
        cells = np.flatnonzero(left | ((rows["block"] == j) & (~own | (i <= j))))
        return cells, left[cells], i == j

    return sides


def _forest_edges():
    sides, unit, similar, tile = _side_cells(), _units(), _similar(), TILE

    def joined(label: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """The labels when those of each edge (x, y) between labels are one."""
        while (x != y).any():
            apart = x != y
            x, y = x[apart], y[apart]
            low, root = np.minimum(x, y), np.arange(len(label))
            np.minimum.at(root, x, low)
            np.minimum.at(root, y, low)
            root = root[root]
            while (root[root] != root).any():
                root = root[root]
            label, x, y = root[label], root[x], root[y]
        return label

    def link(rows: dict) -> Iterator[list[np.ndarray]]:
        """Edges (a, b, level) that connect, at each level at once, what links of two blocks of that level or more connect.

        They make a forest, one star for each component of a level. Levels fall. At each, cells are taken a few at a
        time, out of the largest component that has some left, and compared with those cells only that are neither in
        that component nor taken before.
        """
        cells, left, inside = sides(rows)
        if not left.any() or (left.all() and not inside):
            return
        units, vec = unit(rows["embedding"][cells]), rows["vec_id"][cells]
        short = units.astype(np.float32)
        ahead, first, last, window = (rows["ahead"][cells] == 1), rows["first_us"][cells], rows["last_us"][cells], rows["window_us"][0]
        names, nodes = np.unique(rows["node"][cells], return_inverse=True)
        label = np.arange(len(names))
        levels = rows["min_sims"][0] if "min_sims" in rows else [rows["min_sim"][0]]
        levels = sorted(set(levels), reverse=True)

        def near(x: np.ndarray, y: np.ndarray) -> np.ndarray:
            """Which pairs of cells, of which one or both are left, are close enough in time."""
            later = np.where(ahead[x], first[x] - last[y], first[y] - last[x])
            return ~(ahead[x] | ahead[y]) | (later <= window)

        def connect(at: np.ndarray, level: float) -> tuple[np.ndarray, np.ndarray]:
            """Labels of the cells `at`, and for each the one that it has when cells like each other are one."""
            names, node = np.unique(label[nodes[at]], return_inverse=True)
            side, shorter = left[at], short[at]
            now, todo, step = np.arange(len(names)), np.ones(len(at), bool), 16
            while todo.any():
                of = now[node]
                waiting = np.flatnonzero(todo)
                size = np.bincount(of[waiting])
                large = int(size.argmax())
                one = size[large] >= 32
                pool = waiting[of[waiting] == large] if one else waiting
                lefts = side[pool]
                from_left = 2 * int(lefts.sum()) >= len(pool)
                pool = pool[lefts] if from_left else pool[~lefts]
                meets = todo & ((~side | inside) if from_left else side)
                if one:
                    meets &= of != large
                others, done, stale = np.flatnonzero(meets), 0, 0
                shorts = shorter[others]
                while done < len(pool) and len(others):
                    taken = pool[done : done + max(16, min(step, tile // len(others)))]
                    done += len(taken)
                    todo[taken] = False
                    exact = lambda r, c: (units.take(at[taken[r]], axis=0), units.take(at[others[c]], axis=0))
                    r, c, _ = similar(shorter[taken], shorts, exact, level)
                    x, y = taken[r], others[c]
                    found = np.flatnonzero((now[node[x]] != now[node[y]]) & near(at[x], at[y]))
                    x, y = x[found], y[found]
                    live = todo[others]
                    if one:
                        # What is found hangs on the component.
                        grown = np.zeros(len(names), bool)
                        grown[now[node[y]]] = True
                        now[grown[now]] = large
                        live = now[node[others]] != large
                        # Cells that many others link to at once are taken fewer at a time.
                        share, stale = 1 - live.mean() - stale, 1 - live.mean()
                        step = max(16, step // 2) if share > 0.5 else step * 2 if share < 0.2 else step
                    elif len(x):
                        now = joined(now, now[node[x]], now[node[y]])
                        if np.bincount(now[node[todo]], minlength=1).max() >= 32:
                            break
                    else:
                        step = step * 2
                    if not live.any() or live.mean() < 0.75:
                        others, shorts, stale = others[live], shorts[live], 0
                if not len(others):
                    todo[pool] = False
            return names, names[now]

        # A vector is exactly like itself, whatever its rounding.
        code = np.unique(vec, return_inverse=True)[1]
        mate = np.full(code.max() + 1, -1)
        mate[code[left]] = np.flatnonzero(left)
        y = np.flatnonzero(mate[code] >= 0)
        x = mate[code[y]]
        y, x = y[near(x, y)], x[near(x, y)]
        label = joined(label, label[nodes[x]], label[nodes[y]])
        heads = np.arange(len(names))
        every = np.arange(len(cells))
        steps = [(level, [every]) for level in levels]
        if "base_sim" in rows:
            base = pd.factorize(rows["base"][cells])[0]
            by_base = np.argsort(base, kind="stable")
            groups = np.split(by_base, np.flatnonzero(np.diff(base[by_base])) + 1)
            # Cells without a base have none in common.
            steps.append((rows["base_sim"][0], [g for g in groups if base[g[0]] >= 0]))
        for level, groups in steps:
            edges = [connect(at, level) for at in groups if left[at].any()]
            if edges:
                label = joined(label, *(np.concatenate(e) for e in zip(*edges)))
            # What was a component before hangs, by its smallest node, on the smallest of the component that it is in now.
            lowest = np.full(len(names), len(names))
            np.minimum.at(lowest, label, np.arange(len(names)))
            lowest = lowest[label[heads]]
            y, x = heads[lowest != heads], lowest[lowest != heads]
            if len(x):
                yield [names[x], names[y], np.full(len(x), float(level))]
            heads = heads[lowest == heads]

    return link


def cell_forest(cells_: DataFrame, vectors: DataFrame, by: Sequence[str]) -> DataFrame:
    """Edges (by..., a, b, sim) between the nodes of linked cells: of each pair of blocks, a spanning forest.

    `cells_`: by..., vec_id, bucket, first_us, last_us, window_us, node and the thresholds, `min_sims`, or one, `min_sim`.
    `sim` is the highest threshold that the link is known to reach: whatever links at one of them is connected by edges of it.
    """
    kinds = dict(cells_.dtypes)
    columns = ", ".join([*[f"{k} {kinds[k]}" for k in by], "a long", "b long", "sim double"])
    return _compare(cells_, vectors, by, _forest_edges(), ["a", "b", "sim"], columns)


def cell_links(cells_: DataFrame, vectors: DataFrame, by: Sequence[str]) -> DataFrame:
    """As cell_forest for one threshold, (by..., a, b). Cells with a `base` and a lower `base_sim` link at that inside a base."""
    return cell_forest(cells_, vectors, by).drop("sim")


def cell_pairs(cells_: DataFrame, vectors: DataFrame, threshold: float, by: Sequence[str] = ()) -> DataFrame:
    """(by..., vec_id, bucket, vec_b, sim): other vectors similar to a cell's, with a cell in its bucket or the next."""
    side_cells, unit, tile = _side_cells(), _units(), TILE

    def pairs(rows: dict) -> Iterator[list[np.ndarray]]:
        cells, left, inside = side_cells(rows)
        right = np.ones(len(cells), bool) if inside else ~left
        if not left.any() or not right.any():
            return
        units, vec, ahead = unit(rows["embedding"][cells]), rows["vec_id"][cells], rows["ahead"][cells] == 1
        mine, theirs = np.flatnonzero(left), np.flatnonzero(right)
        step = max(16, tile // len(theirs))
        for at in range(0, len(mine), step):
            some = mine[at : at + step]
            sims = units[some] @ units[theirs].T
            i, j = np.nonzero((sims >= threshold) & (vec[some][:, None] != vec[theirs][None, :]))
            a, b, sim = vec[some[i]], vec[theirs[j]], sims[i, j]
            # Inside a bucket both look for each other; one block against itself has each pair twice already.
            back = ~ahead[theirs[j]] & (not inside)
            x, y, sim = np.concatenate([a, b[back]]), np.concatenate([b, a[back]]), np.concatenate([sim, sim[back]])
            if len(x):
                yield [x, np.repeat(rows["anchor"][:1], len(x)), y, sim]

    kinds = dict(cells_.dtypes)
    vec = kinds["vec_id"]
    columns = ", ".join([*[f"{k} {kinds[k]}" for k in by], f"vec_id {vec}, bucket long, vec_b {vec}, sim double"])
    found = _compare(cells_, vectors, by, pairs, ["vec_id", "bucket", "vec_b", "sim"], columns)
    return found.groupBy(*by, "vec_id", "bucket", "vec_b").agg(F.max("sim").alias("sim"))


def _cell_spans(threshold: float, below: float | None, within: bool):
    """What the alerts of a cell link to in similar vectors of few alerts near by, as rows of `link_counts`."""
    unit, similar, tile = _units(), _similar(), TILE

    def spans(rows: dict) -> Iterator[list[np.ndarray]]:
        i, j = rows["i"][0], rows["j"][0]
        own, crowded, window = rows["ahead"] == 0, rows["crowded"].astype(bool), rows["window_us"][0]
        mine = np.flatnonzero(own & (rows["block"] == i) & ~crowded)
        seats = np.flatnonzero(rows["block"] == j)
        seats = seats[~np.isin(rows["vec_id"][seats], np.unique(rows["vec_id"][seats[crowded[seats]]]))]
        if not len(mine) or not len(seats):
            return
        # The alerts of a vector in both buckets, in order of time: a strip. A vector id may have several vectors, so
        # several seats: the most similar of them count, its cells do once.
        theirs = seats[np.lexsort((rows["ahead"][seats], rows["vec_id"][seats]))]
        new = np.ones(len(theirs), bool)
        new[1:] = (rows["vec_id"][theirs][1:] != rows["vec_id"][theirs][:-1]) | (rows["ahead"][theirs][1:] != rows["ahead"][theirs][:-1])
        theirs = theirs[new]
        vec, first = np.unique(rows["vec_id"][theirs], return_index=True)
        final = np.append(first[1:], len(theirs)) - 1
        kind = np.where(rows["ahead"][theirs[first]] == 1, 2, np.where(own[theirs[final]], 0, 1))
        # Strips of the bucket alone by their ends, those of both, those of the next one by their begins: what can lie
        # inside the windows of some alerts is one stretch of them.
        begins = np.array([t[0] for t in rows["times"][theirs[first]]], np.int64)
        ends = np.array([t[-1] for t in rows["times"][theirs[final]]], np.int64)
        order = np.lexsort((np.where(kind == 0, ends, np.where(kind == 2, begins, 0)), kind))
        place = np.argsort(order)
        ends, begins, n_ahead = ends[order][: (kind == 0).sum()], begins[order][len(order) - (kind == 2).sum() :], (kind == 2).sum()
        strip_of = place[np.searchsorted(vec, rows["vec_id"][theirs])]
        theirs, strip_of = theirs[sort := np.lexsort((rows["ahead"][theirs], strip_of))], strip_of[sort]
        column = place[np.searchsorted(vec, rows["vec_id"][seats])]
        seats, column = seats[sort := np.argsort(column, kind="stable")], column[sort]
        column_at = np.searchsorted(column, np.arange(len(vec) + 1))
        # Cells by their first alert.
        cells, cell = np.unique(rows["vec_id"][mine], return_index=True)
        opens = np.array([t[0] for t in rows["times"][mine[cell]]], np.int64)
        by_time = np.argsort(opens, kind="stable")
        line = np.argsort(by_time)[np.searchsorted(cells, rows["vec_id"][mine])]
        cell, opens = mine[cell[by_time]], opens[by_time]
        closes = np.array([t[-1] for t in rows["times"][cell]], np.int64)
        mine, line = mine[sort := np.argsort(line, kind="stable")], line[sort]
        same = np.searchsorted(vec, rows["vec_id"][cell])
        same = np.where(vec[np.minimum(same, len(vec) - 1)] == rows["vec_id"][cell], place[np.minimum(same, len(vec) - 1)], -1)
        vec = vec[order]

        count = np.array([len(t) for t in rows["times"]], np.int64)
        at = np.concatenate([np.asarray(t, np.int64) for t in [*rows["times"][cell], *rows["times"][theirs]]])
        ids = np.concatenate([np.asarray(x, np.int64) for x in [*rows["ids"][cell], *rows["ids"][theirs]]])
        order = np.lexsort((ids, at))
        new = np.ones(len(at), bool)
        new[1:] = (at[order][1:] != at[order][:-1]) | (ids[order][1:] != ids[order][:-1])
        rank = np.empty(len(at), np.int64)
        rank[order] = np.cumsum(new) - 1
        times = at[order][new]
        n = len(times) + 1
        split = int(count[cell].sum())
        # An alert that came twice asks once.
        asker = np.repeat(np.arange(len(cell)), count[cell])
        once = np.ones(split, bool)
        once[1:] = (asker[1:] != asker[:-1]) | (rank[1:split] != rank[: split - 1])
        asker, asked, since, asker_ids = asker[once], at[:split][once], rank[:split][once], ids[:split][once]
        until = np.searchsorted(times, asked + window, "right") - 1  # the last rank inside an alert's window
        begin = np.searchsorted(asker, np.arange(len(cell) + 1))
        counts = np.diff(begin)
        strip, strip_rank, strip_ids = np.repeat(strip_of, count[theirs]), rank[split:], ids[split:]
        keys = strip * n + strip_rank
        start = np.searchsorted(strip, np.arange(len(vec) + 1))
        long = np.diff(start) > 1
        left, right = unit(rows["embedding"][mine]), unit(rows["embedding"][seats])
        short, shorts = left.astype(np.float32), right.astype(np.float32)
        several = len(seats) > len(vec) or len(mine) > len(cell)

        x = 0
        while x < len(mine):
            s0 = np.searchsorted(ends, opens[line[x]], "left")
            y = min(len(mine), x + max(16, tile // int(len(column) - column_at[s0] or 1)))
            y = int(np.searchsorted(line, line[y - 1], "right"))
            s1 = len(vec) - n_ahead + np.searchsorted(begins, closes[line[x:y]].max() + window, "right")
            c0, c1 = column_at[s0], column_at[s1]
            r, c, sims = similar(short[x:y], shorts[c0:c1], lambda r, c: (left.take(x + r, axis=0), right.take(c0 + c, axis=0)), threshold)
            r, c = line.take(x + r), column.take(c0 + c)
            other = c != same.take(r)
            if not other.all():
                r, c, sims = r[other], c[other], sims[other]
            if several and len(r):
                sort = np.lexsort((sims, c, r))
                last = np.append((r[sort][1:] != r[sort][:-1]) | (c[sort][1:] != c[sort][:-1]), True)
                r, c, sims = r[sort[last]], c[sort[last]], sims[sort[last]]
            if within:
                # A vector is exactly like itself, whatever its rounding.
                self_ = np.arange(line[x], line[y - 1] + 1)
                self_ = self_[same[self_] >= 0]
                r, c, sims = np.concatenate([r, self_]), np.concatenate([c, same[self_]]), np.concatenate([sims, np.ones(len(self_))])
            if below is not None:
                less = sims < below
                r, c, sims = r[less], c[less], sims[less]
            x = y
            # Pairs of cells are opened a few at a time.
            size = counts.take(r)
            parts = np.searchsorted(np.cumsum(size), np.arange(0, int(size.sum()) + tile // 128, tile // 128), "left")
            for lo_pair, hi_pair in zip(parts, [*parts[1:], len(r)]):
                rr, cc, sim, many = r[lo_pair:hi_pair], c[lo_pair:hi_pair], sims[lo_pair:hi_pair], size[lo_pair:hi_pair]
                if not len(rr):
                    continue
                alert = begin.take(rr)
                if many.max() > 1:
                    pair = np.repeat(np.arange(len(rr)), many)
                    alert = alert[pair] + np.arange(len(pair)) - (np.cumsum(many) - many)[pair]
                    cc, sim = cc[pair], sim[pair]
                begun, ended, lo = since.take(alert), until.take(alert), start.take(cc)
                only, more = strip_rank.take(lo), np.flatnonzero(long.take(cc))
                hi = lo + (only <= ended)
                lo += only <= begun
                lo[more] = np.searchsorted(keys, cc[more] * n + begun[more], "right")
                hi[more] = np.searchsorted(keys, cc[more] * n + ended[more], "right")
                if not (hi > lo).all():
                    real = np.flatnonzero(hi > lo)
                    alert, cc, sim, lo, hi = alert.take(real), cc.take(real), sim.take(real), lo.take(real), hi.take(real)
                if len(lo):
                    yield [asker_ids.take(alert), vec.take(cc), sim, strip_ids.take(lo), strip_ids.take(hi - 1), hi - lo]

    return spans


def graph_links(
    alerts: DataFrame,
    units: DataFrame,
    window_us: int,
    threshold: float,
    by: Sequence[str] = (),
    below: float | None = None,
    within: bool = True,
) -> DataFrame:
    """The similarity graph in rows (by..., src, vec_b, sim, first_dst, last_dst, n_links), as `link_counts` has them.

    Cells bring their alerts along, so that the tasks that compare vectors give the rows themselves: neither similar
    pairs nor questions are ever stored. Cells of more than CROWD alerts bring none; what they take part in, similar
    vectors near them included, is counted by `link_counts`. Links of similarity `below` or more are left out.
    """
    keys = [*by, "vec_id"]
    timed = alerts.withColumn("window_us", long_lit(window_us))
    placed = with_bucket(timed.select(*keys, "window_us", "ts_us", "alert_id"), F.col("window_us"))
    # An id at two places is one source of links; only `link_counts` sees both.
    place = F.struct("ts_us", *keys)
    twice = durable(placed.groupBy("alert_id").agg(F.min(place).alias("_p"), F.max(place).alias("_q")).where("_p != _q").select("alert_id", F.lit(True).alias("_twice")))
    odd = F.col("bucket").isNull() | F.col("alert_id").isNull() | F.col("_twice").isNotNull()
    grouped = durable(
        placed.join(twice, "alert_id", "left")
        .groupBy(*keys, "bucket")
        .agg(F.first("window_us").alias("window_us"), (F.max(odd) | (F.count("*") > CROWD)).alias("crowded"))
    )
    crowd = grouped.where("crowded").select(*keys, "bucket")
    few = placed.where("bucket IS NOT NULL AND vec_id IS NOT NULL").join(crowd, [*keys, "bucket"], "left_anti").groupBy(*keys, "bucket").agg(
        F.array_sort(F.collect_list(F.struct("ts_us", "alert_id"))).alias("_l")
    )
    none = F.array().cast("array<bigint>")
    listed = few.select(*keys, "bucket", F.col("_l.ts_us").alias("times"), F.col("_l.alert_id").alias("ids"), long_lit(window_us).alias("window_us"), F.lit(False).alias("crowded"))
    marked = crowd.where("bucket IS NOT NULL").select("*", none.alias("times"), none.alias("ids"), long_lit(window_us).alias("window_us"), F.lit(True).alias("crowded"))
    kinds = dict(grouped.dtypes)
    vec = kinds["vec_id"]
    schema = ", ".join([*[f"{k} {kinds[k]}" for k in by], f"src long, vec_b {vec}, sim double, first_dst long, last_dst long, n_links long"])
    names = ["src", "vec_b", "sim", "first_dst", "last_dst", "n_links"]
    spans = _compare(listed.unionByName(marked), units, by, _cell_spans(threshold, below, within), names, schema, both=True)
    if crowd.isEmpty():
        return spans

    # Around crowded cells: all cells of their bucket and its neighbours, the pairs with a crowded side.
    buckets = crowd.where("bucket IS NOT NULL").select(*by, F.explode(F.array([F.col("bucket") + d for d in (-1, 0, 1)])).alias("bucket")).distinct()
    near = grouped.join(buckets, [*by, "bucket"], "left_semi")
    pairs = cell_pairs(near, units, threshold, by)
    pairs = pairs if below is None else pairs.where(F.col("sim") < below)
    crowds = crowd.select(*by, F.col("vec_id").alias("_v"), F.explode(F.array(F.col("bucket"), F.col("bucket") - 1)).alias("bucket"), (F.lit(1)).alias("_c")).distinct()
    mine = crowd.withColumn("_m", F.lit(1))
    touched = (
        pairs.join(mine, [*keys, "bucket"], "left")
        .join(crowds.withColumnRenamed("_v", "vec_b"), [*by, "vec_b", "bucket"], "left")
        .where("_c IS NOT NULL OR _m IS NOT NULL")
        .select(*keys, "bucket", "vec_b", "sim")
    )
    if within:
        usable = grouped.select(*keys, "bucket").join(units.select("vec_id"), "vec_id", "left_semi")
        mates = usable.join(crowds.withColumnRenamed("_v", "vec_id"), [*keys, "bucket"], "left_semi").unionByName(usable.where("bucket IS NULL"))
        touched = touched.unionByName(mates.select(*keys, "bucket", F.col("vec_id").alias("vec_b"), F.lit(1.0).alias("sim")))
    return spans.unionByName(link_counts(alerts, touched, window_us, by))


def link_counts(alerts: DataFrame, pairs: DataFrame, window_us: int, by: Sequence[str] = ()) -> DataFrame:
    """The similarity graph, losslessly packed.

    For an alert and a vector similar to its own (the same vector included), the
    later alerts it links to are consecutive among the alerts of that vector in
    (time, id) order. One row names the first and the last of them and their
    number: (by..., src, vec_b, sim, first_dst, last_dst, n_links). An alert looks for a
    vector only if `pairs` (by..., vec_id, bucket, vec_b, sim) has it for the alert's cell, so rows
    grow with alerts and the vectors active near them, not with the pairs; the sum of n_links is the
    number of edges. Positions come from a running count that splits hot vectors.
    """
    keys = [*by, "vec_b"]
    narrow = with_bucket(alerts.select(*by, "alert_id", "ts_us", "vec_id"), long_lit(window_us))
    on = [F.col(f"a.{c}") == F.col(f"p.{c}") for c in [*by, "vec_id"]] + [F.col("a.bucket").eqNullSafe(F.col("p.bucket"))]
    asked = narrow.alias("a").join(pairs.alias("p"), on).select(*[f"a.{c}" for c in [*by, "alert_id", "ts_us"]], "p.vec_b", "p.sim")
    targets = pairs.select(*by, F.col("vec_b").alias("vec_id")).distinct()
    points = narrow.join(targets, [*by, "vec_id"], "left_semi").select(*by, "alert_id", "ts_us", F.col("vec_id").alias("vec_b"), F.lit(0.0).alias("sim"))
    # kind: 0 = an alert of vec_b, 1 = "how many up to me", 2 = "how many up to the end of my window".
    here, ahead = F.col("ts_us"), F.col("ts_us") + window_us
    marks = F.array(
        F.struct(F.lit(1).alias("kind"), here.alias("at"), F.col("alert_id").alias("tie")),
        F.struct(F.lit(2).alias("kind"), ahead.alias("at"), long_lit(2**63 - 1).alias("tie")),
    )
    point = F.array(F.struct(F.lit(0).alias("kind"), here.alias("at"), F.col("alert_id").alias("tie")))
    marked = asked.select("alert_id", *keys, "sim", F.inline(marks)).unionByName(points.select("alert_id", *keys, "sim", F.inline(point)))
    counted = running_sum(marked, keys, ["at", "tie", "kind", "alert_id"], F.when(F.col("kind") == 0, 1).otherwise(0), "upto")
    spans = (
        counted.where("kind > 0")
        .groupBy(F.col("alert_id").alias("src"), *keys)
        .agg(
            F.max("sim").alias("sim"),
            F.max(F.when(F.col("kind") == 1, F.col("upto"))).alias("lo"),
            F.max(F.when(F.col("kind") == 2, F.col("upto"))).alias("hi"),
        )
        .where("hi > lo")
    )
    at = counted.where("kind = 0").select(*keys, F.col("upto").alias("pos"), F.col("alert_id").alias("dst"))
    first = at.select(*keys, (F.col("pos") - 1).alias("lo"), F.col("dst").alias("first_dst"))
    last = at.select(*keys, F.col("pos").alias("hi"), F.col("dst").alias("last_dst"))
    return (
        spans.join(first, [*keys, "lo"])
        .join(last, [*keys, "hi"])
        .select(*by, "src", "vec_b", "sim", "first_dst", "last_dst", (F.col("hi") - F.col("lo")).alias("n_links"))
    )


def similarity_edges(alerts: DataFrame, vectors: DataFrame, window_sec: float, threshold: float) -> DataFrame:
    """All edges of the windowed similarity join, packed by `graph_links`."""
    if not 0 < threshold <= 1:
        raise ValueError("threshold must be in (0, 1]")
    return graph_links(alerts, linkable(vectors), window_micros(window_sec), threshold)


def cross_service_edges(
    alerts: DataFrame, vectors: DataFrame, window_sec: float, threshold: float, cross_threshold: float
) -> DataFrame:
    """As similarity_edges, but edges between different base services need `cross_threshold`.

    Edges that hold for any service are packed per vector (`service` is NULL there);
    those that hold only inside a base service are packed per vector and service.
    """
    if not 0 < threshold <= cross_threshold <= 1:
        raise ValueError("need 0 < threshold <= cross_threshold <= 1")
    units = linkable(vectors)
    window_us = window_micros(window_sec)
    tagged = alerts.withColumn("service", base_service(F.col("service")))
    strong = graph_links(tagged, units, window_us, cross_threshold)
    local = graph_links(tagged, units, window_us, threshold, ["service"], below=cross_threshold, within=False)
    return strong.withColumn("service", F.lit(None).cast("string")).unionByName(local)
