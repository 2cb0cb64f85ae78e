"""The registered queries against their SQL, and the pipeline's stages, on the smallest tables."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from annalist.llm import queries
from annalist.llm.near_dedup import near_dedup
from tests.oracle import DATA, assert_same

pytestmark = pytest.mark.skipif(not DATA.exists(), reason="no test tables here")


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query_equals_sql(spark, name):
    assert_same(spark, queries.queries()[name], queries.oracle_sql()[name])


def test_pipeline_stages(spark, tmp_path):
    sf_dir = str(DATA)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    seen = {}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, sf_dir).write.parquet(str(tmp_path / str(k)))
        out = spark.read.parquet(str(tmp_path / str(k)))
        seen[name] = out
        if name != "packing":
            assert out.columns == docs.columns
            assert 0 < out.count() <= docs.count()
            assert out.join(docs, "doc_id", "left_anti").count() == 0
        docs = out
    lowered = seen["exact_dedup"].select(F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz").alias("t"))
    assert lowered.count() == lowered.distinct().count()
    assert near_dedup(seen["near_dedup"], 80).filter("not kept").count() == 0
    packed = {r.doc_id for r in seen["packing"].select("doc_id").distinct().collect()}
    assert packed == {r.doc_id for r in seen["mixing"].select("doc_id").collect()}
    assert [name for name, _ in corpus_pipeline.STAGES] == ["toxicity", "exact_dedup", "near_dedup", "mixing", "packing"]


DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def test_pipeline_stages_of_nothing(spark):
    docs = spark.createDataFrame([], DOCS)
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, str(DATA))
        assert out.count() == 0
        assert name == "packing" or out.columns == docs.columns


def test_pipeline_stages_account_for_every_row(spark):
    """Nulls in every column, empty and very long texts, repeated ids and rows: no text is lost but to another like it."""
    long = " ".join(f"word{i * i % 977} of" for i in range(60_000))
    rows = [
        (1, "A first text", "en", "src0", 12), (1, "quite another text", "en", "src0", 18), (5, "a FIRST text", "en", "src1", 12),
        (None, "no id here", "en", "src1", 10), (None, "no id here", "en", "src1", 10), (None, None, None, None, None),
        (7, None, "de", None, None), (8, "", None, "src2", 0), (9, " \n ", "fr", "src3", 3), (10, long, "es", "src4", len(long)),
        (11, long + " end", "es", "src4", len(long) + 4), (12, long, "en", "src9", len(long)),
    ]
    docs = spark.createDataFrame(rows, DOCS)
    texts = lambda df: sorted((r.text or "").lower() for r in df.collect())
    stages = dict(corpus_pipeline.STAGES)
    assert texts(stages["toxicity"](spark, docs, str(DATA))) == texts(docs)
    exact = stages["exact_dedup"](spark, docs, str(DATA))
    assert texts(exact) == sorted(set(texts(docs)))
    exact = spark.createDataFrame(exact.collect(), DOCS)
    near = spark.createDataFrame(stages["near_dedup"](spark, exact, str(DATA)).collect(), DOCS)
    assert set(texts(exact)) - set(texts(near)) == {long.lower()}  # the copy with the larger id goes
    mixed = stages["mixing"](spark, near, str(DATA)).collect()
    assert {(r.doc_id, r.text) for r in mixed} <= {(r.doc_id, r.text) for r in near.collect()}
    packed = stages["packing"](spark, near, str(DATA))
    assert packed.filter("start = 0").count() == near.count()
