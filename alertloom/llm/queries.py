"""Registered queries of this subpackage: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from alertloom.llm import divergence, infill, language, licences, mixing, neardup, packing, pages, prefixes, quality, rules, topk, toxicity
from alertloom.llm.texts import fold, learned_rows, table

#: The tokenizer file of op2 in the `tokenizers` format, by the package that installs it.
TOKENIZER = "word_bpe_49k.json"

#: The tokenizer file of op12.
COUNTED = "byte_bpe_50k.json"

Query = Callable[[SparkSession, str], DataFrame]


def held_out(k: int, remainder: int):
    return F.coalesce(fold("doc_id", k) == remainder, F.lit(False))


def op1_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = learned_rows(table(spark, sf_dir, "labels"), "quality").where(fold("doc_id", 3) != 1)
    score = F.col("quality_score")
    return quality.classified(docs, labels).select(
        "doc_id",
        held_out(3, 1).alias("held_out"),
        score.alias("score"),
        (score >= 0.5).cast("int").alias("predicted"),
    )


def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op2_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), tokenizer_path())


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = learned_rows(table(spark, sf_dir, "labels"), "toxic").where(fold("doc_id", 5) != 0)
    out = toxicity.scored(docs, toxicity.fit(docs, labels))
    score = F.col("toxic_score")
    return out.select(
        "doc_id",
        held_out(5, 0).alias("held_out"),
        score.alias("score"),
        (score >= 0.5).cast("int").alias("predicted"),
        F.size("offences").alias("n_offences"),
    )


def op4_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(table(spark, sf_dir, "documents")).select(
        "doc_id", "n_shingles", "component_id", "kept"
    )


def op5_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixed(table(spark, sf_dir, "documents"))


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = rules.fit(docs, learned_rows(table(spark, sf_dir, "labels"), "quality"))
    return rules.judged(docs, model).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "probability"
    )


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = language.fit(docs.where(fold("doc_id", 5) != 0))
    return language.identified(docs.select("doc_id", "text"), model).select(
        "doc_id", held_out(5, 0).alias("held_out"), "lang_pred", F.col("lang_score").alias("score")
    )


def op8_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", topk.whole(F.col("embedding")).alias("v"))
    return topk.top_k(vectors.where("vec_id % 20 = 0"), vectors)


def op9_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    return pages.main_text(rows, pages.fit(rows), ["page_id", "url"])


def op10_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = licences.recognised(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", F.array_join("licences", ",").alias("licences"), "n_matches")


def op11_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = infill.restored(infill.transformed(table(spark, sf_dir, "documents").select("doc_id", "text")))
    return made.select(
        "doc_id",
        "n",
        "form",
        "prefix_chars",
        "middle_chars",
        F.sha2("output", 256).alias("output_sha256"),
        F.sha2("restored", 256).alias("restored_sha256"),
    )


def op12_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = prefixes.counted(table(spark, sf_dir, "documents"), tokenizer_path(COUNTED))
    over = F.col("n_tokens") > prefixes.LIMIT
    return found.select("doc_id", "n_bytes", "n_tokens", over.alias("over_limit"), "limit_chars")


def op13_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(table(spark, sf_dir, "documents"))


OP8_SQL = """
WITH usable AS (
  SELECT DISTINCT vec_id, [CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT) FOR x IN embedding] AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0
), scored AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id,
    CAST(list_inner_product(CAST(q.v AS DOUBLE[]), CAST(c.v AS DOUBLE[])) AS BIGINT) AS score
  FROM usable q JOIN usable c ON q.vec_id % 20 = 0 AND q.vec_id <> c.vec_id
), ranked AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM scored
)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 20
"""


QUERIES: dict[str, Query] = {
    "op1_quality_classifier": op1_quality_classifier,
    "op2_best_fit_packing": op2_best_fit_packing,
    "op3_toxicity": op3_toxicity,
    "op4_minhash_near_dedup": op4_minhash_near_dedup,
    "op5_source_mixing": op5_source_mixing,
    "op6_quality_rules": op6_quality_rules,
    "op7_language_id": op7_language_id,
    "op8_exact_topk": op8_exact_topk,
    "op9_html_extraction": op9_html_extraction,
    "op10_license_scan": op10_license_scan,
    "op11_fill_in_middle": op11_fill_in_middle,
    "op12_token_counts": op12_token_counts,
    "op13_source_divergence": op13_source_divergence,
}

SQL: dict[str, str] = {
    "op8_exact_topk": OP8_SQL,
    "op10_license_scan": licences.oracle_sql(),
    "op11_fill_in_middle": infill.ORACLE_SQL,
    "op13_source_divergence": divergence.ORACLE_SQL,
}
