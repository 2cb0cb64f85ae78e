"""Plans and bounds that matter at scale."""

import io
from contextlib import redirect_stdout

from pyspark.sql import functions as F

from annalist.llm import exact_dedup, line_dedup, mixing, packing, substring_dedup

DOCS = "doc_id long, text string, lang string, source string"


def plan(df):
    out = io.StringIO()
    with redirect_stdout(out):
        df.explain("formatted")
    return out.getvalue()


def docs(spark, n=200):
    return spark.range(n).select(
        F.col("id").alias("doc_id"), F.concat_ws(" ", *[F.lit(f"w{i}") for i in range(60)], F.col("id").cast("string")).alias("text"),
        F.lit("en").alias("lang"), F.concat(F.lit("src"), (F.col("id") % 3).cast("string")).alias("source"),
    )


def test_native_operators_run_no_python(spark):
    for out in (exact_dedup.exact_dedup(docs(spark)), line_dedup.line_dedup(docs(spark)), mixing.mix(docs(spark))):
        text = plan(out)
        assert "Python" not in text and "Arrow" not in text and "Pandas" not in text
        assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text


def test_packing_does_not_shuffle(spark, tmp_path):
    docs(spark).write.parquet(str(tmp_path / "d"))
    assert "Exchange" not in plan(packing.pack(spark.read.parquet(str(tmp_path / "d")), "unused.json"))


def test_only_needed_columns_are_read(spark, tmp_path):
    docs(spark).write.parquet(str(tmp_path / "d"))
    text = plan(substring_dedup.substring_dedup(spark.read.parquet(str(tmp_path / "d"))))
    assert "ReadSchema: struct<doc_id:bigint,text:string>" in text and "lang" not in text
