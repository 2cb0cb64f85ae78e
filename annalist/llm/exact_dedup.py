"""Exact deduplication by skew-safe combining, in DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from annalist.llm.common import UPPER, keep_rows, lower_ascii, materialise

SALTS = 16


def exact_dedup(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", salts: int = SALTS, digest_bits: int = 256
) -> DataFrame:
    """One row per input row: which row stands for its text.

    Texts are equal when identical after lower-casing A-Z.  Three combining
    stages, each keyed by the digest *and the whole text*, so that a digest
    collision never merges two texts:

    1. local: the partial aggregate inside each map task leaves one row per
       text and task, however many copies the task holds;
    2. salted: those rows meet by (digest, task modulo ``salts``), so a text
       present in every task is spread over ``salts`` reducers;
    3. global: at most ``salts`` winners per text are combined.

    Membership then comes from a narrow join on the digest (no text in it),
    which adaptive execution splits where one digest is hot.  Only if some
    digest had two texts are those few texts joined by their content.

    Output: ``id_col``, keep_id (largest id of the equal texts), group_size,
    kept, text_sha256.  Null text counts as empty; empty texts form a group;
    a row with a null id is never preferred, and is kept only if its whole
    group has null ids; repeated rows with one id share one fate; an empty
    table gives no rows; other columns, whatever their names, are not touched.
    ``digest_bits`` shortens the grouping digest (for tests of collisions).
    """
    rows = docs.select(
        F.col(id_col).cast("long").alias("doc_id"), lower_ascii(F.coalesce(F.col(text_col), F.lit(""))).alias("norm")
    )
    sha = F.unhex(F.sha2("norm", 256))
    hashed = rows.withColumn("sha", sha).withColumn("digest", F.substring("sha", 1, digest_bits // 8))

    salted = (
        hashed.withColumn("salt", F.spark_partition_id() % F.lit(salts))
        .groupBy("digest", "salt", "norm")
        .agg(F.max("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
    )
    texts = (
        salted.repartition("digest")
        .groupBy("digest", "norm")
        .agg(F.max("keep_id").alias("keep_id"), F.sum("group_size").alias("group_size"))
    )
    groups = materialise(
        texts.groupBy("digest").agg(
            F.count(F.lit(1)).alias("contents"),
            F.max("keep_id").alias("keep_id"),
            F.max("group_size").alias("group_size"),
        ),
        "exact_groups",
    )
    collided = groups.filter("contents > 1").select("digest")
    narrow = hashed.select("doc_id", "sha", "digest")
    if collided.isEmpty():
        out = narrow.join(groups.drop("contents"), "digest")
    else:  # two texts with one digest: these, and only these, are told apart by content
        alone = narrow.join(groups.filter("contents = 1").drop("contents"), "digest")
        told = hashed.join(collided, "digest", "left_semi").join(texts, ["digest", "norm"])
        out = alone.unionByName(told.select(alone.columns))
    return out.select(
        F.col("doc_id").alias(id_col),
        "keep_id",
        "group_size",
        F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"),
        F.lower(F.hex("sha")).alias("text_sha256"),
    )


def drop_exact_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one row of each text, one of those with the largest id; columns unchanged.

    Rows go by their own text, so an id that repeats with two texts loses none
    of them, and of rows alike in id and text one stays.
    """
    judged = exact_dedup(docs, id_col, text_col).select(
        F.col(id_col).alias("doc_id"), F.xxhash64("text_sha256").alias("version"), "kept"
    )
    norm = lower_ascii(F.coalesce(F.col(text_col), F.lit("")))
    return keep_rows(docs, judged, F.xxhash64(F.sha2(norm, 256)), once=True, id_col=id_col)


def oracle_sql() -> str:
    return f"""
    WITH n AS (SELECT doc_id, translate(coalesce(text, ''), '{UPPER}', '{UPPER.lower()}') AS norm FROM documents)
    SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
           doc_id = max(doc_id) OVER w AS kept, sha256(norm) AS text_sha256
    FROM n WINDOW w AS (PARTITION BY norm)
    """
