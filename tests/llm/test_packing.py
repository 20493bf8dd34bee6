"""Packing: the tokenizer's own ids, gapless sequences, and a search that only improves."""

import zlib
from collections import defaultdict

import numpy as np
import pytest

from alertloom.llm import packing
from alertloom.llm.queries import tokenizer_path

HARD = [
    None, "", " \n\t", "İstanbul ΣΑΣ Σ's <|endoftext|> a<|startoftext|>b", "é café x y\x1cz \x85 q", "it's IT'S we'LL o'clock'd ''s",
    "12345 1½²", "日本語 テスト 🙂🙂 a🙂b", "\xad soft\xadhyphen \x00\x01 a\x7fb", "ÀÉÎÕÜ ÿ ¡¿ «»", "x" * 300, "the and, of THE. " * 3000,
]


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(tokenizer_path())


def test_whole_texts_round_trip(spark, tokenizer):
    rows = [(i, t, 5, "x") for i, t in enumerate(HARD)] + [(1, "", 5, "x"), (None, "a b", 0, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, length int, offset string")
    got = packing.pack_documents(docs, tokenizer_path(), with_ids=True).collect()
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in got:
        by_doc[r.doc_id].append(r)
        by_sequence[r.sequence_id].append(r)
        assert r.ids_crc32 == zlib.crc32(np.array(r.ids, "<u4").tobytes()) and r.length == len(r.ids) <= 2048
    for i, t in enumerate(HARD):
        own = sorted(by_doc[i], key=lambda r: r.piece)
        if i == 1:  # the repeated row
            assert [(r.piece, r.ids) for r in own] == [(0, [0]), (0, [0])]
            continue
        ids = [x for r in own for x in r.ids]
        assert ids == [*tokenizer.encode(t or "", add_special_tokens=False).ids, 0], t
        assert [r.start for r in own] == [2048 * k for k in range(len(own))]
    assert by_doc[None]
    for own in by_sequence.values():
        at = 0
        for r in sorted(own, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 2048


def test_empty_table(spark):
    assert packing.pack_documents(spark.createDataFrame([], "doc_id long, text string"), tokenizer_path()).collect() == []


def test_groups_do_not_share_sequences(spark):
    docs = spark.createDataFrame([(i, "word " * (i % 700)) for i in range(600)], "doc_id long, text string")
    got = packing.packed(packing.pieces(docs, tokenizer_path()), group=100).collect()
    fill = defaultdict(int)
    for r in got:
        fill[r.sequence_id] += r.length
    assert max(fill.values()) <= 2048 and len({s >> 32 for s in fill}) > 3
    assert len(fill) <= sum(fill.values()) / 2048 + 2 * len({s >> 32 for s in fill})


@pytest.mark.parametrize("low,high", [(1, 2048), (500, 1100), (600, 760), (2048, 2048), (1, 1)])
def test_local_search_empties_bins_and_never_overfills(low, high):
    sizes = np.random.default_rng(low).integers(low, high + 1, 1500)
    before = packing.best_fit(sizes, 2048)
    after = packing.local_search(sizes, before, 2048)
    first, then = np.bincount(before, sizes), np.bincount(after, sizes)
    assert then.max() <= 2048 and then.sum() == sizes.sum()
    assert (then > 0).sum() <= (first > 0).sum() and (then**2).sum() >= (first**2).sum()
    assert (low, high) not in ((500, 1100), (600, 760)) or (then > 0).sum() < (first > 0).sum()


def test_search_finds_the_exchange_that_best_fit_misses():
    sizes = np.array([6, 4, 4, 3, 3])  # 6 + 4 and 4 + 3 + 3 fill two bins of 10
    assert len(set(packing.local_search(sizes, np.array([0, 1, 0, 1, 2]), 10).tolist())) == 2


def steps_left(sizes, bins, length):
    """Whether handing one or two pieces of some bin on, for none, one or two, helps a bin that is at least as full."""
    own = defaultdict(list)
    for z, b in zip(sizes.tolist(), bins.tolist(), strict=True):
        own[b].append(z)
    own = [x for x in own.values() if sum(x) < length]
    totals = [sorted({0, *x, *(a + b for i, a in enumerate(x) for b in x[:i])}) for x in own]
    owner = np.repeat(np.arange(len(own)), [len(t) for t in totals])
    back, fill = np.concatenate([np.array(t) for t in totals]), np.array([sum(x) for x in own])
    for v, given in enumerate(totals):
        others = (fill[owner] >= fill[v]) & (owner != v)
        for g in given:
            gain = g - back[others]
            if ((gain > 0) & (gain <= length - fill[owner[others]])).any():
                return True
    return False


@pytest.mark.parametrize("low,high,most", [(500, 1100, 6716), (600, 760, 5570), (300, 800, 4415)])
def test_search_of_a_whole_group_ends_without_a_step_left(low, high, most):
    sizes = np.random.default_rng(low).integers(low, high + 1, packing.GROUP)
    after = packing.local_search(sizes, packing.best_fit(sizes, 2048), 2048)
    fill = np.bincount(after, sizes)
    assert fill.max() <= 2048 and fill.sum() == sizes.sum() and (fill > 0).sum() <= most
    assert not steps_left(sizes, after, 2048)


def test_search_on_small_tables_ends_without_a_step_left():
    rng = np.random.default_rng(5)
    for _ in range(300):
        sizes = rng.integers(1, rng.integers(2, 30), rng.integers(1, 60))
        after = packing.local_search(sizes, packing.best_fit(sizes, 30), 30)
        fill = np.bincount(after, sizes)
        assert fill.max() <= 30 and ((fill > 0).sum() == -(-sizes.sum() // 30) or not steps_left(sizes, after, 30))


def test_repeated_rows_are_spread_over_groups(spark, tmp_path):
    """A hot row - without id, or one id many times - does not fill one group."""
    docs = spark.createDataFrame([(None, "the same text")] * 2000 + [(7, "one more text")] * 1000, "doc_id long, text string")
    packing.pieces(docs, tokenizer_path()).write.parquet(str(tmp_path / "pieces"))
    got = packing.packed(spark.read.parquet(str(tmp_path / "pieces")), group=100).collect()
    assert len(got) == 3000
    groups = defaultdict(int)
    for r in got:
        groups[r.sequence_id >> 32] += 1
    assert len(groups) == 30 and max(groups.values()) < 200
