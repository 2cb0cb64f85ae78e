"""Keyed state as tables: upserts, checkpoints, caches, files.

Plain Parquet has no row-level update, so an upsert is a new version of the
touched partitions; the functions return that version and ``replace`` writes it.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from annalist import schemas


def to_documents(records: DataFrame, doc_type: str) -> DataFrame:
    """(doc_type, doc_id, payload) of records."""
    key = schemas.PAYLOADS[doc_type][1]
    if doc_type == "release" and "tag_name" in records.columns:
        doc_id = F.coalesce("tag", "tag_name")
    else:
        doc_id = F.col(key)
    return records.select(F.lit(doc_type).alias("doc_type"), doc_id.cast("string").alias("doc_id"), F.to_json(F.struct("*")).alias("payload"))


def upsert(
    old: DataFrame, new: DataFrame, keys: list[str], order: Column | None = None, order_first: bool = False
) -> DataFrame:
    """Union of two tables with the last row of every key.

    A new row replaces an old one, and of several new ones the last by ``order``
    stays; with ``order_first`` the order decides between old and new as well
    (for batches that may come out of turn).
    """
    rest = [c for c in old.columns if c not in keys]
    turn = F.lit(0) if order is None else order
    both = old.withColumns({"_batch_": F.lit(0), "_turn_": turn}).unionByName(
        new.select(*old.columns).withColumns({"_batch_": F.lit(1), "_turn_": turn})
    )
    rank = F.struct("_turn_", "_batch_") if order_first else F.struct("_batch_", "_turn_")
    last = both.groupBy(*keys).agg(F.max_by(F.struct(*rest), rank).alias("_row_"))
    return last.select(*keys, *[F.col(f"_row_.{c}").alias(c) for c in rest]).select(*old.columns)


def merge_checkpoint(old: DataFrame, new: DataFrame, key: str = "repo") -> DataFrame:
    """A null in ``new`` keeps the old value."""
    rest = [c for c in old.columns if c != key]
    a, b = old.alias("a"), new.alias("b")
    return a.join(b, key, "full").select(key, *[F.coalesce(f"b.{c}", f"a.{c}").alias(c) for c in rest])


def insert_missing(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Old rows and those new ones whose key is not there."""
    return old.unionByName(new.dropDuplicates(keys).join(old.select(*keys), keys, "left_anti"))


def replace_postings(old: DataFrame, new: DataFrame, key: str = "chunk_id") -> DataFrame:
    """Postings with those of the new chunks in place of their old ones."""
    return old.join(new.select(key).distinct(), key, "left_anti").unionByName(new)


def replace(spark: SparkSession, rows: DataFrame, path: str, partition_by: str | None = None, tidy: bool = False) -> DataFrame:
    """Write a new version beside the old one, then point ``path/_current`` to it; readers never see half a table.

    ``tidy`` removes the versions before the one that was current until now.
    """
    version = f"v-{uuid.uuid4().hex}"
    writer = rows.write.mode("error").option("compression", "zstd")
    (writer.partitionBy(partition_by) if partition_by else writer).parquet(f"{path}/{version}")
    stay = {version}
    if tidy:
        try:
            stay.add(_version(spark, path))
        except Exception as e:
            if "PATH_NOT_FOUND" not in str(e):
                raise
    spark.createDataFrame([(version,)], "version string").coalesce(1).write.mode("overwrite").json(f"{path}/_current")
    if tidy:
        place = spark._jvm.org.apache.hadoop.fs.Path(path)
        files = place.getFileSystem(spark._jsc.hadoopConfiguration())
        for found in files.listStatus(place):
            name = found.getPath().getName()
            if name.startswith("v-") and name not in stay:
                files.delete(found.getPath(), True)
    return current(spark, path)


def _version(spark: SparkSession, path: str) -> str:
    return spark.read.schema("version string").json(f"{path}/_current").head()[0]


def current(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(f"{path}/{_version(spark, path)}")


def written(rows: DataFrame, name: str) -> DataFrame:
    """``rows`` by way of a table in the folder that driver and executors share: what follows starts from the files."""
    spark = rows.sparkSession
    base = spark.conf.get("spark.checkpoint.dir", None) or f"{spark.conf.get('spark.sql.warehouse.dir')}/_checkpoints"
    path = f"{base}/{name}-{uuid.uuid4().hex}"
    rows.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(rows.schema).parquet(path)


def save_tables(tables: dict[str, DataFrame], path: str) -> None:
    """A new version of each table under ``path``."""
    for name, rows in tables.items():
        replace(rows.sparkSession, rows, f"{path}/{name}")


def load_tables(spark: SparkSession, path: str, *names: str) -> dict[str, DataFrame]:
    return {name: current(spark, f"{path}/{name}") for name in names}


def write_chunk_file(chunks: DataFrame, path: str) -> None:
    """Chunk file lines {text, metadata}; characters beyond ASCII stay as they are."""
    meta = F.struct(*[F.col(c) for c in chunks.columns if c != "text"])
    chunks.select("text", meta.alias("metadata")).write.mode("overwrite").json(path)


def write_qa_pairs(pairs: DataFrame, path: str) -> None:
    pairs.write.mode("overwrite").json(path)


def log_run(spark: SparkSession, path: str, params: dict, metrics: dict, run: str) -> None:
    """Append a run's parameters and metrics."""
    rows = [(run, "param", k, str(v)) for k, v in params.items()] + [(run, "metric", k, str(v)) for k, v in metrics.items()]
    spark.createDataFrame(rows, "run string, kind string, name string, value string").coalesce(1).write.mode("append").parquet(path)
