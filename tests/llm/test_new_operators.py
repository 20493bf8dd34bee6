"""Fill-in-middle, prefix token counts and the divergence audit, against plain versions and the tokenizer itself."""

import hashlib
import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from alertloom.llm import divergence, infill, prefixes
from alertloom.llm.queries import COUNTED, tokenizer_path

DOCS = "doc_id long, text string, lang string, source string, n string, form string, counts string, rank int"


def texts():
    rng = random.Random(5)
    odd = ["the", " international", "  ", "\n\n", "\n", "\t", "'re", "'s", "'ll", "'", "!", "aaaaaaa", "1234", "٣٤", "été", "日本語", "。", "😀"]
    odd += ["<|endoftext|>", "<|endof", "<P", ">", "<", "\x1c", "\x85", "　", "don't", "\x00", "Ⅷ", "\U0001d400", "        ", "x=1;"]
    made = ["".join(rng.choice(odd) for _ in range(rng.randrange(1, 25))) for _ in range(150)]
    return [*made, None, "", " ", "a", "<P>", "x<M>y", "\n" * 40, "word " * 30_000, "q" * 5_000, "字" * 3_000]


def table(spark):
    rows = [(i, t, "de", "s", "n", "f", "c", 1) for i, t in enumerate(texts())]
    rows += [rows[0], rows[0], (None, "no id", None, None, None, None, None, None)]
    return rows, spark.createDataFrame(rows, DOCS).repartition(5)


def filled_in(doc_id, text):
    """The contract, unit by unit."""
    text = text or ""
    u = re.findall("[A-Za-z]+|[^A-Za-z]", text)
    digest = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[8 * i : 8 * i + 8], 16) for i in range(4)]
    a, b = sorted((h[0] % (len(u) + 1), h[1] % (len(u) + 1)))
    prefix, middle, suffix = "".join(u[:a]), "".join(u[a:b]), "".join(u[b:])
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90:
        return len(u), "plain", None, None, text, text
    spm = h[3] % 100 < 20
    output = f"<S>{suffix}<P>{prefix}<M>{middle}" if spm else f"<P>{prefix}<S>{suffix}<M>{middle}"
    return len(u), "spm" if spm else "psm", len(prefix), len(middle), output, text


def test_fill_in_middle_against_a_plain_loop(spark):
    rows, docs = table(spark)
    got = infill.restored(infill.transformed(docs)).collect()
    key = lambda r: tuple((x is None, x or 0 if not isinstance(x, str) else x) for x in r)
    right = [(d, *filled_in(d, t)) for d, t, *_ in rows]
    assert sorted(map(tuple, got), key=key) == sorted(right, key=key)
    assert {r.form for r in got} == {"plain", "psm", "spm"}


def test_fill_in_middle_of_an_empty_table(spark):
    made = infill.restored(infill.transformed(spark.createDataFrame([], DOCS)))
    assert made.collect() == []
    assert made.columns == ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output", "restored"]


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(tokenizer_path(COUNTED))


def test_every_prefix_has_the_tokenizers_count(tokenizer):
    known = prefixes.prefixes(tokenizer_path(COUNTED))
    for text in texts():
        if text is None or len(text) > 1000:
            continue
        counts = known.of(text.encode())
        whole = tokenizer.encode_batch([text[:k] for k in range(len(text) + 1)], add_special_tokens=False)
        assert counts.tolist() == [len(e.ids) for e in whole], repr(text)


def test_random_strings_of_few_letters(tokenizer):
    known = prefixes.prefixes(tokenizer_path(COUNTED))
    rng = random.Random(9)
    for letters in ("ab", "na", "st re", "'sretlv ", " \n\t", "é€😀 "):
        for _ in range(20):
            text = "".join(rng.choice(letters) for _ in range(rng.randrange(1, 40)))
            whole = tokenizer.encode_batch([text[:k] for k in range(len(text) + 1)], add_special_tokens=False)
            assert known.of(text.encode()).tolist() == [len(e.ids) for e in whole], repr(text)


def test_long_texts_in_slices_and_a_small_table(tokenizer, monkeypatch):
    rng = random.Random(2)
    text = "".join(rng.choice(["word", " ", "  ", "don't", " é", "\n", "'ll", "7"]) for _ in range(20_000))
    known = prefixes.prefixes(tokenizer_path(COUNTED))
    whole = known.of(text.encode())
    monkeypatch.setattr(prefixes, "SLICE", 50)
    monkeypatch.setattr(prefixes, "TABLE_BYTES", 2000)
    monkeypatch.setattr(prefixes, "PAIRS", 5)
    assert (prefixes.Prefixes(tokenizer_path(COUNTED)).of(text.encode()) == whole).all()
    assert whole[-1] == len(tokenizer.encode(text, add_special_tokens=False).ids)


def test_counts_and_questions_without_encoding_again(spark, tokenizer):
    rows, docs = table(spark)
    got = prefixes.counted(docs, tokenizer_path(COUNTED), limit=12).collect()
    ids = lambda t: len(tokenizer.encode(t, add_special_tokens=False).ids)
    right = sorted(((-1 if d is None else d), len((t or "").encode()), ids(t or "")) for d, t, *_ in rows)
    assert sorted(((-1 if r.doc_id is None else r.doc_id), r.n_bytes, r.n_tokens) for r in got) == right
    text = {d: t or "" for d, t, *_ in rows}
    for r in got:
        t = text[r.doc_id]
        if len(t) < 400:
            assert r.limit_chars == max(k for k in range(len(t) + 1) if ids(t[:k]) <= 12)
    stored = prefixes.prefix_counts(docs.where("doc_id < 40"), tokenizer_path(COUNTED))
    asked = stored.select("doc_id", prefixes.tokens_in("counts", F.lit(9)).alias("n"), prefixes.chars_within("counts", F.lit(3)).alias("k"))
    for r in asked.collect():
        t = text[r.doc_id]
        assert r.n == ids(t[:9])
        assert r.k == max(k for k in range(len(t) + 1) if ids(t[:k]) <= 3)
    assert prefixes.counted(docs.limit(0), tokenizer_path(COUNTED)).collect() == []


def audited(rows, least, top):
    """The contract, term by term."""
    docs, counts, groups = Counter(), Counter(), set()
    for _, text, lang, source, *_ in rows:
        lang, source = lang or "", source or ""
        groups.add((lang, source))
        found = re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", text or "")
        found = ["".join(c.lower() if "A" <= c <= "Z" else c for c in t) for t in found]
        docs.update({(lang, t) for t in found})
        counts.update((lang, source, t) for t in found)
    out = []
    for lang in {g[0] for g in groups}:
        kept = sorted(t for (x, t), n in docs.items() if x == lang and n >= least)
        own = sorted(s for x, s in groups if x == lang)
        n = {s: {t: counts[lang, s, t] for t in kept} for s in own}
        n[None] = {t: sum(n[s][t] for s in own) for t in kept}
        p = {s: {t: 1 + 1_000_000_000 * (c + 5) // (sum(of.values()) + 5 * len(kept)) for t, c in of.items()} for s, of in n.items()}
        for s in own:
            pairs = [(-sum(abs(p[s][t] - p[o][t]) for t in kept), o) for o in own if o != s]
            terms = [(p[None][t] - p[s][t], t) for t in kept if n[s][t] and p[s][t] > p[None][t]]
            for part, found, most in (("pair", pairs, None), ("term", terms, top)):
                ranked = sorted(found, key=lambda x: (x[0], x[1].encode()))[:most]
                out += [(lang, s, part, item, -value, i) for i, (value, item) in enumerate(ranked, 1)]
    return sorted(out)


def corpus():
    rng = random.Random(8)
    vocabulary = ["Straße", "été", "Été", "x", "日本", "A1b", "don't", *(f"w{'abcdefghij'[i % 10]}{'klmnopqrst'[i // 10]}" for i in range(60))]
    rows = []
    for i in range(400):
        lang, source = rng.choice(["de", "en", None, ""]), rng.choice(["hot", "hot", "hot", "s1", "s2", "Ä", None])
        rows.append((i, " ".join(rng.choice(vocabulary[: 5 + i % 60]) for _ in range(rng.randrange(0, 40))), lang, source))
    rows += [(900, None, "de", "none"), (901, "", "de", "blank"), (902, "rare words alone", "xx", "a"), (903, "1 2 3", "xx", "b"), (904, None, "yy", "c")]
    rows += [rows[7], rows[7], (None, "x x x", "de", "hot")]
    return [(*r, "n", "f", "c", 1) for r in rows]


@pytest.mark.parametrize("groups, terms, panel", [(32, 2048, 4096), (2, 7, 3)])
def test_audit_against_plain_counting(spark, monkeypatch, groups, terms, panel):
    monkeypatch.setattr(divergence, "GROUPS", groups)
    monkeypatch.setattr(divergence, "TERMS", terms)
    monkeypatch.setattr(divergence, "PANEL", panel)
    rows = corpus()
    got = divergence.audit(spark.createDataFrame(rows, DOCS).repartition(6), least_docs=10, top_terms=6).collect()
    assert sorted(map(tuple, got)) == audited(rows, 10, 6)


def test_joint_tables_count_every_kept_term_once(spark):
    rows = corpus()
    known = divergence.vocabulary(spark.createDataFrame(rows, DOCS), least_docs=10)
    whole = divergence.joint_tables(known).groupBy("lang", "one", "two").agg(F.sum("terms").alias("terms"))
    kept = {r.lang: r.n for r in known.terms.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    for r in whole.collect():
        assert r.one < r.two and r.terms == kept.get(r.lang, 0)


def test_audit_of_empty_tables(spark):
    assert divergence.audit(spark.createDataFrame([], DOCS)).collect() == []
    assert divergence.audit(spark.createDataFrame([(1, None, None, None, None, None, None, None)], DOCS)).collect() == []
