"""Near-duplicates against all pairs compared by brute force."""

import random
import re

import numpy as np
import pyarrow as pa
import pytest

from alertloom.llm import neardup

DOCS = "doc_id long, text string, n string, key int"


def words(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall("[^\x20\x09-\x0d]+", low)


def shingles(text):
    w = words(text)
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def expected(rows):
    sets = {i: shingles(t) for i, t, *_ in rows if i is not None}
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for x, a in enumerate(ids):
        for b in ids[x + 1 :]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= 75 * (len(sets[a]) + len(sets[b]) - both):
                low, high = sorted((find(a), find(b)))
                root[high] = low
    return {i: (len(sets[i]), find(i)) for i in sets}


def corpus():
    """Base texts with copies at every distance, a crowd of near copies, and a passage that many texts share."""
    rng = random.Random(5)
    make = lambda n: [f"w{rng.randrange(5000)}" for _ in range(n)]
    texts = []
    for _ in range(12):
        base = make(rng.randrange(30, 300))
        for edits in (0, 1, 2, 4, 8, 16, 30):
            copy = list(base)
            for _ in range(edits):
                copy[rng.randrange(len(copy))] = f"x{rng.randrange(10**6)}"
            texts.append(copy)
    hot = make(150)
    for _ in range(60):
        copy = list(hot)
        copy[rng.randrange(150)] = f"y{rng.randrange(10**6)}"
        copy[rng.randrange(150)] = f"y{rng.randrange(10**6)}"
        texts.append(copy)
    passage = make(60)
    texts += [make(40) + passage + make(40) for _ in range(40)]
    rng.shuffle(texts)
    rows = [(i, " ".join(t), "clash", 0) for i, t in enumerate(texts)]
    rows += [(900, None, None, None), (901, "", "a", 1), (902, " \n\t", "a", 1), (903, "one two", "a", 1), (904, "ONE\ttwo", "a", 1)]
    rows += [(905, "a " * 40000, "a", 1), (906, "a a a a a", "a", 1), (907, "É a b c d", "", 2), (908, "é a b c d", "", 2)]
    return rows + [(900, None, None, None), (903, "one two", "b", 1), (None, "one two", "b", 1)]


def test_matches_brute_force(spark):
    rows = corpus()
    got = neardup.near_duplicates(spark.createDataFrame(rows, DOCS).repartition(5)).collect()
    assert len(got) == len(rows)
    right = expected(rows)
    for r in got:
        if r.doc_id is None:
            assert r.component_id is None and r.kept and r.n_shingles == 1
        else:
            assert (r.n_shingles, r.component_id) == right[r.doc_id], r
            assert r.kept == (r.doc_id == r.component_id)
    assert {r.class_id for r in got if r.doc_id in (905, 906)} == {905}  # repeats are one shingle


def test_empty_table(spark):
    assert neardup.near_duplicates(spark.createDataFrame([], DOCS)).collect() == []


def test_blocks_of_a_bucket_see_all_pairs(spark, monkeypatch):
    """With blocks of 8 rows and no leaders, the comparison alone finds every link."""
    monkeypatch.setattr(neardup, "BLOCK", 8)
    monkeypatch.setattr(neardup, "LEADER_ROUNDS", 1)
    rows = [r for r in corpus() if r[0] is not None][:160]
    got = {r.doc_id: r.component_id for r in neardup.near_duplicates(spark.createDataFrame(rows, DOCS)).collect()}
    assert got == {i: root for i, (_, root) in expected(rows).items()}


def test_pairs_within_the_guaranteed_distance_share_a_key():
    rng = np.random.default_rng(3)
    a = rng.integers(0, 2**16, (200, neardup.PLACES)).astype("<u2")
    b = a.copy()
    most = neardup.CHUNKS * (neardup.ERRORS + 1) - 1
    for row in b:
        row[rng.choice(neardup.PLACES, most, replace=False)] += 1
    shared = np.zeros(200, bool)
    for mask in range(len(neardup._MASKS)):
        shared |= neardup._key(a, mask) == neardup._key(b, mask)
    assert shared.all()
    first = neardup._first_key(a == b, a)
    assert all(any(first[i] == neardup._key(x[i : i + 1], m)[0] for m in range(len(neardup._MASKS))) for x in (a, b) for i in range(0, 200, 20))


@pytest.mark.parametrize("text,count", [("a b c d e f", 2), ("a b", 1), ("", 0), ("x" * 100000, 1)])
def test_shingle_counts(text, count):
    assert len(neardup.shingle_hashes([text.encode()])[0]) == count


@pytest.mark.parametrize("hashes", [1 << 20, 700])
def test_dense_buckets_are_confirmed_in_their_tasks(spark, monkeypatch, hashes):
    """A cloud of copies around one text: most pairs are no links, and the links that join must all be found."""
    monkeypatch.setattr(neardup, "SET_HASHES", hashes)  # the second one cuts blocks further, to a few sets each
    monkeypatch.setattr(neardup, "LEADER_ROUNDS", 1)
    monkeypatch.setattr(neardup, "BLOCK", 50)
    rng = random.Random(9)
    base = [f"w{i}" for i in range(150)]
    rows = []
    for i in range(150):
        copy = list(base)
        for _ in range(rng.randrange(1, 12)):
            copy[rng.randrange(150)] = f"z{rng.randrange(10**6)}"
        rows.append((i, " ".join(copy), "", 0))
    got = {r.doc_id: r.component_id for r in neardup.near_duplicates(spark.createDataFrame(rows, DOCS)).collect()}
    right = {i: root for i, (_, root) in expected(rows).items()}
    assert got == right and 1 < len(set(right.values())) < 150


def test_signatures_and_sets_of_texts_with_repeats():
    """Repeated shingles count once, texts without words have no signature, and a text's neighbours change nothing."""
    texts = [b"", b"a b c d e f g", b"a b c d e a b c d e a b c d e", b" ", b"a b", b"a b c d e a b c d e"]
    got = neardup._signed(texts)
    sets = neardup._sets(texts)["shingles"].to_pylist()
    assert got["n"].to_pylist() == [len(shingles(t.decode())) for t in texts] == [len(s) for s in sets]
    assert [s is None for s in got["signature"].to_pylist()] == [not shingles(t.decode()) for t in texts]
    for i, text in enumerate(texts):
        h = np.unique(neardup.shingle_hashes([text])[0])
        assert np.array(sets[i], np.int64).tolist() == h.view(np.int64).tolist()
        alone = neardup._signed([text])
        assert all(alone[c][0] == got[c][i] for c in got)
    n, kept = neardup._distinct(*neardup.shingle_hashes([texts[2], texts[5]]))
    assert len(n) == kept[-1] == 10  # no repeats go on to the minimum hashes
    assert neardup._signed([])["n"].to_pylist() == [] and neardup._sets([])["shingles"].to_pylist() == []


def test_a_crowd_is_linked_without_listing_its_pairs():
    """4,000 near copies in one cell: the rows leave it as a crowd, and as many links as join them come of it."""
    rng = np.random.default_rng(2)
    n, length = 4000, 400
    base = rng.integers(0, 2**63, length, dtype=np.uint64)
    sets = [np.sort(np.where(rng.random(length) < 0.02, rng.integers(0, 2**63, length, dtype=np.uint64), base)) for _ in range(n)]
    places = np.tile(rng.integers(0, 2**16, neardup.PLACES).astype("<u2"), (n, 1))
    key = int(neardup._key(places[:1], 0).view(np.int64)[0])
    columns = {"key": np.full(n, key), "low": np.zeros(n, int), "high": np.zeros(n, int), "id": np.arange(n), "n": np.full(n, length)}
    columns |= {"root": np.arange(n), "block": np.zeros(n, int)}
    table = pa.table({**columns, "signature": [p.tobytes() for p in places], "shingles": [s.view(np.int64) for s in sets]})
    near = [b for b in neardup._near(75)(iter(table.drop_columns("shingles").to_batches(1000)))]
    assert sum(b.num_rows for b in near) == n and all(b["b"].null_count == b.num_rows for b in near)
    found = pa.Table.from_batches(neardup._linked(75)(iter(table.to_batches(1000))))
    assert found.num_rows == n - 1 and set(found["a"].to_pylist()) | set(found["b"].to_pylist()) == set(range(n))
