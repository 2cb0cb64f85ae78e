"""Session and storage helpers shared by the operators."""

from __future__ import annotations

import ctypes
import uuid

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def tune(spark: SparkSession) -> None:
    """Bound the bytes of an Arrow batch, so that Python workers stay small whatever the texts' lengths."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2000")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(8 << 20))


def give_back() -> None:
    """Return freed memory to the system: a Python worker lives on through later stages, beside a JVM that grows."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc's alone
    if trim is not None:
        trim(0)


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or the warehouse where that is unset."""
    return spark.conf.get("spark.checkpoint.dir", None) or f"{spark.conf.get('spark.sql.warehouse.dir')}/_checkpoints"


def materialise(df: DataFrame, name: str, **options: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: later stages restart from the files, not from its lineage."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.options(compression="zstd", **options).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def lower_ascii(text: Column) -> Column:
    """A-Z to a-z and nothing else; pure ASCII texts take the fast path."""
    ascii_only = F.octet_length(text) == F.char_length(text)
    return F.when(ascii_only, F.lower(text)).otherwise(F.translate(text, UPPER, UPPER.lower()))


def id_and_text(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, text) of ``docs``.

    Columns that have these names and types already are passed as they are: an
    alias would make two uses of one shuffle look like two different ones.
    """
    kinds = dict(docs.dtypes)
    doc_id = F.col(id_col) if (id_col, kinds[id_col]) == ("doc_id", "bigint") else F.col(id_col).cast("long").alias("doc_id")
    text = F.col(text_col) if text_col == "text" else F.col(text_col).alias("text")
    return docs.select(doc_id, text)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


#: A list of ids up to this many rows (16 bytes each in a hash relation's page, 64 MB at most) may be broadcast.
BROADCAST_ROWS = 2_000_000


def drop_ids(docs: DataFrame, ids: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """``docs`` without the rows whose id is in ``ids`` (one materialised column named ``id_col``).

    The list is counted first: up to ``BROADCAST_ROWS`` it is broadcast and the
    documents stay where they are; a longer one is joined by shuffle.  Rows with
    a null id stay.
    """
    small = ids.count() <= BROADCAST_ROWS
    return docs.join(F.broadcast(ids) if small else ids, id_col, "left_anti")


def keep_rows(docs: DataFrame, judged: DataFrame, version: Column, once: bool, id_col: str = "doc_id") -> DataFrame:
    """``docs`` without the rows that ``judged`` does not keep; columns unchanged.

    ``judged`` (doc_id, version, kept) has a row for each row of ``docs``, whose
    ``version`` is a hash of what the judgement looked at.  An id none of whose
    rows is kept goes by the id alone.  Ids with rows of both fates, which the id
    cannot tell apart, and null ids go by id and version; with ``once`` so do ids
    with several rows, and of rows alike in both one stays.
    """
    judged = materialise(judged, "judged")
    known = "doc_id IS NOT NULL"
    fates = materialise(
        judged.filter(known)
        .groupBy("doc_id")
        .agg(F.max("kept").alias("some"), F.min("kept").alias("every"), F.count(F.lit(1)).alias("n"))
        .filter("NOT every OR n > 1" if once else "NOT every")
        .select("doc_id", "some"),
        "fates",
    )
    apart = fates.filter("some").select("doc_id")
    out = drop_ids(docs, fates.select(F.col("doc_id").alias(id_col)), id_col)
    nameless = not judged.filter(f"NOT ({known})" if once else f"NOT kept AND NOT ({known})").isEmpty()
    if nameless:
        out = out.filter(F.col(id_col).isNotNull())
    elif apart.isEmpty():
        return out
    taken = judged.filter("kept").join(apart, "doc_id", "left_semi")
    again = docs.join(apart.select(F.col("doc_id").alias(id_col)), id_col, "left_semi").select(*docs.columns)
    if nameless:
        taken = taken.unionByName(judged.filter(f"kept AND NOT ({known})"))
        again = again.unionByName(docs.filter(F.col(id_col).isNull()))
    taken = taken.select(F.col("doc_id").alias("_id_"), F.col("version").alias("_kept_")).distinct()
    again = again.withColumn("_version_", version).join(
        taken, F.col(id_col).eqNullSafe(F.col("_id_")) & (F.col("_version_") == F.col("_kept_"))
    )
    if once:
        again = again.dropDuplicates([id_col, "_version_"])
    return out.unionByName(again.select(*docs.columns))
