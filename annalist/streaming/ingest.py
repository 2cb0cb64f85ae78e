"""Continuous ingest: landed records to the document table, chunk by chunk.

The stream's own checkpoint remembers what was read, so no high-water mark is
kept by hand; corpus statistics are rebuilt in batch.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from annalist import schemas
from annalist.sources import sinks


def read_stream(spark: SparkSession, path: str, doc_type: str, files_per_batch: int = 1000) -> DataFrame:
    rows = spark.readStream.schema(schemas.PAYLOADS[doc_type][0]).option("maxFilesPerTrigger", files_per_batch).json(path)
    return sinks.to_documents(rows.filter("pull_request IS NULL") if doc_type == "issue" else rows, doc_type)


def upsert_stream(rows: DataFrame, path: str, keys: list[str], checkpoint: str, order: str | None = None) -> StreamingQuery:
    """Run over all that is there, each micro-batch upserted into the table at ``path``.

    A batch that is run again after a failure gives the same table.  Of older
    versions of the table only the last one stays.
    """

    def write(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        turn = F.col(order) if order else None
        try:
            old = sinks.current(spark, path)
        except Exception as e:
            if "PATH_NOT_FOUND" not in str(e):
                raise
            old = batch.limit(0)
        sinks.replace(spark, sinks.upsert(old, batch, keys, turn, order_first=order is not None), path, tidy=True)

    return rows.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
