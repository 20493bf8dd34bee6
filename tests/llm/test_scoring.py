"""Scoring operators: held-out accuracy, counts and code lengths by brute force, and edge rows."""

import collections
import math
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from alertloom.llm import language, quality, rules, toxicity
from alertloom.llm.texts import fold, learned_rows, within

EDGES = [None, "", " \n\t", "a", "É", "123 !!!", "日本語", "the words " * 30000, "x" * 200000]


def prose(rng, n, extra=()):
    words = [rng.choice(VOCABULARY) for _ in range(n)]
    for w in extra:
        words.insert(rng.randrange(len(words)), w)
    for i in range(9, len(words), 10):
        words[i] += rng.choice([".", ",", ".\n"])
    return " ".join(words)


VOCABULARY = ["".join(random.Random(i).choices("abcdefghijklmnop", k=random.Random(-i).randrange(2, 9))) for i in range(1500)]
BAD = ["vile", "grumf", "zorkish", "quaxel"]


@pytest.fixture(scope="module")
def corpus(spark):
    """Documents with clashing columns, and their labels: toxic by words in one sentence, low quality by its looks."""
    rng = random.Random(4)
    rows, labels = [], []
    for i in range(900):
        toxic, good = int(rng.random() < 0.2), int(rng.random() < 0.75)
        text = prose(rng, rng.randrange(60, 200), rng.sample(BAD, 2) if toxic else [])
        if not good:
            text = rng.choice([text.upper().replace(" ", "!! "), text.replace(" ", "%%% "), " | ".join(text.split()), text.split()[0] + (" " + text.split()[1]) * 120])
        rows.append((i, text, "en"))
        labels.append((i, good, toxic))
    rows += [(10_000 + i, t, None) for i, t in enumerate(EDGES)] + [rows[0], (None, rows[1][1], "en")]
    docs = spark.createDataFrame([(*r, "own", 1.0) for r in rows], "doc_id long, text string, lang string, kept string, toxic_score double")
    known = spark.createDataFrame([*labels, (None, 1, 1), (5, None, None), (77_777, 1, 0)], "doc_id long, quality int, toxic int")
    return docs.repartition(4), known, {i: (q, t) for i, q, t in labels}


def test_toxicity(corpus):
    docs, known, labels = corpus
    model = toxicity.fit(docs, learned_rows(known, "toxic").where(fold("doc_id", 5) != 0))
    got = toxicity.scored(docs, model).collect()
    assert len(got) == docs.count() and set(got[0].asDict()) == {*docs.columns, "offences"}
    held = [r for r in got if r.doc_id in labels and r.doc_id is not None]
    truth = lambda r: any(w in r.text.lower() for w in BAD)
    assert np.mean([(r.toxic_score >= 0.5) == truth(r) for r in held]) > 0.97
    for r in held:
        for o in r.offences:  # the offence is in the sentence that is named
            assert any(w in r.text[o.start : o.start + o.length].lower() for w in BAD) or o.score < 0.9
    by_id = {r.doc_id: r for r in got}
    assert all(0 <= r.toxic_score <= 1 for r in got)
    assert by_id[10_000].toxic_score == by_id[10_001].toxic_score == by_id[10_002].toxic_score == 0 and by_id[10_000].offences == []


def test_noisy_or_is_the_product(corpus):
    model = toxicity.Model(np.random.default_rng(0).normal(size=toxicity.BUCKETS).astype(np.float32), -1.0)
    chunk = [b"one two. three! four\nfive", b"", b"six"]
    buckets, words, sentences, begin, stop = toxicity.bags(chunk)
    p = toxicity.sentence_scores(model, buckets, words)
    assert sentences.tolist() == [0, 4, 4, 5]
    assert toxicity.noisy_or(p, sentences).tolist() == pytest.approx([1 - np.prod(1 - p[:4]), 0.0, p[4]])
    assert [b"".join(chunk[:1])[a:b] for a, b in zip(begin[:4], stop[:4], strict=True)] == [b"one two.", b" three!", b" four\n", b"five"]


def test_without_labels_nothing_is_toxic_and_all_is_kept(corpus):
    docs, known, _ = corpus
    none = learned_rows(known.where("false"), "toxic")
    assert toxicity.scored(docs, toxicity.fit(docs, none)).where("toxic_score > 0.1").isEmpty()
    assert {r.quality_score for r in quality.classified(docs, none).collect()} == {0.5}
    assert rules.judged(docs, rules.fit(docs, none)).where("kept = base_failed").isEmpty()
    empty = docs.where("false")
    assert toxicity.scored(empty, toxicity.fit(empty, none)).collect() == quality.classified(empty, none).collect() == []
    assert rules.judged(empty, rules.fit(empty, none)).collect() == []
    assert language.identified(empty, language.fit(empty)).collect() == []
    assert {r.lang_pred for r in language.identified(docs, language.fit(empty)).collect()} == {"und"}


def test_quality(corpus):
    docs, known, labels = corpus
    got = quality.classified(docs, learned_rows(known, "quality").where(fold("doc_id", 3) != 1)).withColumn("held", fold("doc_id", 3) == 1).collect()
    assert len(got) == docs.count() and all(0 <= r.quality_score <= 1 for r in got)
    right = [(r.quality_score >= 0.5) == (labels[r.doc_id][0] == 1) for r in got if r.doc_id in labels and r.held]
    assert len(right) > 200 and np.mean(right) > 0.95


def test_discriminant_is_the_difference_of_log_densities(spark):
    rng = np.random.default_rng(1)
    d = len(quality.FEATURES)
    x = np.concatenate([rng.normal(0, 1, (300, d)), rng.normal(1, 2, (200, d))])
    y = [1] * 300 + [0] * 200
    model = quality.fit(spark.createDataFrame([(a, b.tolist()) for a, b in zip(y, x, strict=True)], "y int, x array<double>"))
    one = x[:300]
    z = np.clip((x - one.mean(0)) / one.std(0), -quality.CLIP, quality.CLIP)
    groups = [z[300:], z[:300]]
    pooled = (np.cov(groups[0].T, bias=True) * 200 + np.cov(groups[1].T, bias=True) * 300) / 500
    logs = []
    for group, share in zip(groups, (0.4, 0.6), strict=True):
        own = 0.9 * np.cov(group.T, bias=True) + 0.1 * pooled
        own = 0.95 * own + 0.05 * np.diag(np.diag(own)) + 1e-3 * np.eye(d)
        off = z - group.mean(0)
        logs.append(math.log(share) - 0.5 * np.linalg.slogdet(own)[1] - 0.5 * (off @ np.linalg.inv(own) * off).sum(1))
    assert model.scores(x) == pytest.approx(1 / (1 + np.exp(logs[0] - logs[1])), abs=1e-9)


def counted(text):
    text = text or ""
    w = re.findall("[^\x20\x09-\x0d]+", text)
    lines = [x for x in text.split("\n") if re.search("[^\x20\x09-\x0d]", x)]
    windows = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    often = collections.Counter(windows)
    inside = {i + j for i, x in enumerate(windows) if often[x] > 1 for j in range(3)}
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(inside)


def test_quality_rules(corpus):
    docs, known, labels = corpus
    got = rules.judged(docs, rules.fit(docs, learned_rows(known, "quality"))).collect()
    assert len(got) == docs.count()
    for r in got:
        own = counted(r.text)
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == own
        assert r.base_failed == (own[0] < 50 or 100 * own[4] > 50 * own[0])
        assert r.kept == (not r.base_failed and r.probability >= 0.5)
    right = [(r.probability >= 0.5) == (labels[r.doc_id][0] == 1) for r in got if r.doc_id in labels]
    assert np.mean(right) > 0.97


@pytest.mark.parametrize("text", ["a b a b a b", "x\ny\nx\n\n \nx", "é ü é ü é", "a b c a b c d", "#*$%&|<>\r\n#"])
def test_counts_by_hand(text):
    got = rules.counts([text.encode(), b"", text.encode()])
    assert [int(v[0]) for v in got.values()] == [int(v[2]) for v in got.values()] == list(counted(text))


def normal(text):
    low = re.sub("[À-ÖØ-Þ]", lambda m: m.group().lower(), re.sub("[A-Z]", lambda m: m.group().lower(), text)).encode()
    out = [0, 0, 0, *re.sub(rb"[^a-z\x80-\xff]+", b"\0", low)]
    return out[:3] + out[4:] if len(out) > 3 and out[3] == 0 else out


def test_code_lengths_against_a_coder_of_dictionaries(spark):
    rng = random.Random(2)
    alphabets = {"aa": "abcdeé", "bb": "cdefgü", "cc": "日本語a"}
    make = lambda name, n: " ".join("".join(rng.choices(alphabets[name], k=rng.randrange(1, 6))) for _ in range(n))
    rows = [(i, make(name, 40), name) for i, name in enumerate(list(alphabets) * 10)]
    model = language.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    texts = [make(n, 20) for n in alphabets] + ["", "ÀÉ 12 zz日", "  lead", "trail  ", "x"]
    g, first = language.grams([t.encode() for t in texts])
    got = model.lengths(g)
    for column, name in enumerate(sorted(alphabets)):
        seen = [collections.defaultdict(collections.Counter) for _ in range(4)]
        for _, t, own in rows:
            z = normal(t)
            for i in range(3, len(z)) if own == name else []:
                for k in range(4):
                    seen[k][tuple(z[i - k : i])][z[i]] += 1
        for t, lo, hi in zip(texts, first[:-1], first[1:], strict=True):
            z, bits = normal(t), 0.0
            for i in range(3, len(z)):
                for k in (3, 2, 1, 0):
                    c = seen[k].get(tuple(z[i - k : i]))
                    if c and z[i] in c:
                        bits -= math.log2(c[z[i]] / (c.total() + len(c)))
                        break
                    bits -= math.log2(len(c) / (c.total() + len(c))) if c else 0
                else:
                    bits += 8
            assert got[lo:hi, column].sum() == pytest.approx(bits, rel=1e-4), (name, t)


def test_languages(spark, corpus):
    rng = random.Random(3)
    letters = {"de": "äöüßschie", "fr": "éèêçoiaux", "en": "thingerat"}
    rows = [(i, " ".join("".join(rng.choices(letters[n], k=4)) for _ in range(30)), n) for i, n in enumerate(list(letters) * 60)]
    rows += [(1000 + i, t, "en") for i, t in enumerate(EDGES)] + [(None, rows[0][1], "de"), rows[1], (2000, "ohne", None)]
    docs = spark.createDataFrame([(*r, "clash") for r in rows], "doc_id long, text string, lang string, lang_pred string")
    model = language.fit(docs.where((fold("doc_id", 5) != 0) & (F.col("doc_id") < 1000)))
    got = language.identified(docs, model).collect()
    assert len(got) == len(rows) and all(0 <= r.lang_score <= 1 for r in got)
    assert all(r.lang_pred == r.lang for r in got if r.doc_id is None or r.doc_id < 1000)
    edge = {r.text: r.lang_pred for r in got if r.doc_id is not None and 1000 <= r.doc_id < 2000}
    assert all(edge[t] == "und" for t in (None, "", " \n\t", "123 !!!")) and all(edge[t] != "und" for t in ("a", "É", "日本語"))


def test_samples_have_one_row_of_an_id_and_are_bounded(spark, corpus):
    docs, known, _ = corpus
    many = docs.where("doc_id in (3, 4, 9)").select("doc_id", "text").withColumn("n", F.explode(F.sequence(F.lit(1), F.lit(500))))
    many = many.select("doc_id", F.concat("text", F.lit(" "), F.col("n").cast("string")).alias("text"))
    labels = learned_rows(known, "quality").where("doc_id in (3, 4, 9, 11)")
    rows, _ = toxicity.sample(many, labels, 10)
    assert sorted(r.doc_id for r in rows.collect()) == [3, 4, 9]
    assert {r.doc_id: r.text for r in rows.collect()} == {r.doc_id: r.text for r in many.groupBy("doc_id").agg(F.min("text").alias("text")).collect()}
    sized = spark.createDataFrame([(i, 1000 if i == 5 else 10) for i in range(100)], "doc_id long, size long")
    got = within(sized, "doc_id", "size", 200).collect()
    assert len(got) == 20 and 5 not in {r.doc_id for r in got}
    assert within(sized.where("false"), "doc_id", "size", 200).collect() == []
