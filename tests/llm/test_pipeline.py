"""The pipeline stage by stage, each held against the operators' own rules."""

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
import corpus_pipeline as pipeline
from alertloom.session import durable

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    odd = "doc_id long, text string, lang string, source string, n_chars long"
    extra = [(9_000, None, None, None, None), (9_001, "", "en", "src0", 0), (None, None, None, None, None), (9_002, "same words here " * 30, "en", "src1", 480)]
    docs = docs.unionByName(spark.createDataFrame([*extra, extra[-1]], odd)).unionByName(docs.where("doc_id % 10 = 3"))
    # Extra columns with names that operators use.
    docs = docs.withColumns({"toxic_score": F.lit("own"), "n": F.lit(1), "y": F.lit(2), "size": F.lit("s"), "quality_score": F.lit(3)})
    out = {"documents": durable(docs)}
    for name, stage in pipeline.STAGES:
        out[name] = durable(stage(spark, out[list(out)[-1]], SF))
    return out


def test_stages_return_the_columns_of_documents(stages):
    names = list(stages)
    for name in names[:-1]:
        assert stages[name].schema.names == stages["documents"].schema.names, name
    assert stages["quality_classifier"].where("toxic_score != 'own' or y != 2 or quality_score != 3").isEmpty()


def test_filters_only_drop(stages):
    names = list(stages)
    for before, after in zip(names[:3], names[1:4], strict=True):
        gone = stages[before].exceptAll(stages[after])
        assert gone.count() == stages[before].count() - stages[after].count()
        assert 0.5 * stages[before].count() < stages[after].count()


def test_one_document_of_each_group_stays(stages):
    from test_neardup import expected

    rows = [(r.doc_id, r.text) for r in stages["quality_classifier"].select("doc_id", "text").distinct().collect()]
    right = sorted(i for i, (_, root) in expected(rows).items() if i == root)
    kept = [r.doc_id for r in stages["near_dedup"].collect()]
    assert sorted(i for i in kept if i is not None) == right


def test_packing_has_all_documents_of_the_mix(stages):
    mix, packed = stages["source_mixing"], stages["packing"]
    assert packed.where("piece = 0").count() == mix.count()
    fills = packed.groupBy("sequence_id").agg(F.sum("length").alias("n"), F.max(F.col("offset") + F.col("length")).alias("end"))
    assert fills.where("n > 2048 or n != end").isEmpty()


def test_empty_tables(spark, stages):
    for name, stage in pipeline.STAGES:
        assert stage(spark, stages["documents"].where("false"), SF).isEmpty(), name


def test_registered():
    names = list(entry.queries())
    assert "pipeline" in names and {n.split("_")[0] for n in names if n.startswith("op")} == {f"op{i}" for i in range(1, 14)}


def test_texts_of_one_id_are_judged_one_by_one(spark):
    def words(seed):
        return " ".join(f"w{(seed * 7919 + i * i * 31 + i) % 100_003}" for i in range(120))

    near = lambda text: text.replace(text.split()[60], "changed", 1)
    rows = [
        (1, words(1)), (5, near(words(1))), (5, words(2)),  # a near copy of a smaller id, and a text of its own
        (6, words(3)), (6, words(4)), (6, words(4)),  # two texts, one of them twice
        (7, words(5)), (7, words(6) + " more"), (9, near(words(5))), (3, near(words(6))),  # copies of one in greater and smaller ids
        (8, words(7)), (8, near(words(7)) + " longer text"), (10, None), (10, words(8)), (11, words(9)), (None, words(9)),
    ]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"source": F.lit("s"), "node": F.lit(7), "first": F.lit("own"), "_node_": F.lit(1)})
    got = pipeline.drop_near_duplicates(spark, docs, "").collect()
    assert got[0].asDict().keys() == set(docs.columns) and {(r.node, r.first, r["_node_"]) for r in got} == {(7, "own", 1)}
    gone = [rows[1], rows[5], rows[7], rows[8], rows[10]]
    left = list(rows)
    for r in gone:
        left.remove(r)
    key = lambda r: (r[0] or 0, r[1] or "")
    assert sorted([(r.doc_id, r.text) for r in got], key=key) == sorted(left, key=key)
