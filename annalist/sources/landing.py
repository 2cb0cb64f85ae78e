"""Readers of landed records, chunk files and local files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from annalist import schemas


def read_records(spark: SparkSession, path: str, doc_type: str) -> DataFrame:
    """JSON lines of one record type, with its declared layout (no inference pass)."""
    rows = spark.read.schema(schemas.PAYLOADS[doc_type][0]).json(path)
    return rows.filter("pull_request IS NULL") if doc_type == "issue" else rows


def read_ci_runs(spark: SparkSession, path: str, limit: int = 200) -> DataFrame:
    """The newest ``limit`` runs."""
    return read_records(spark, path, "cicd").orderBy(F.desc("created_at"), F.desc("run_id")).limit(limit)


def closing_issue_texts(nodes: Column) -> Column:
    return F.transform(F.slice(nodes, 1, 5), lambda n: F.concat(F.lit("#"), n["number"].cast("string"), F.lit(": "), n["title"]))


def read_graphql_prs(spark: SparkSession, path: str, limit: int = 50) -> DataFrame:
    """Merged pull requests as the GraphQL service answers them, the last updated first."""
    schema = (
        "number INT, title STRING, body STRING, author STRUCT<login: STRING>, createdAt STRING, mergedAt STRING, "
        "updatedAt STRING, closingIssuesReferences STRUCT<nodes: ARRAY<STRUCT<number: INT, title: STRING>>>"
    )
    rows = spark.read.schema(schema).json(path).orderBy(F.desc("updatedAt"), F.desc("number")).limit(limit)
    return rows.select(
        "number",
        "title",
        "body",
        F.col("author.login").alias("author"),
        F.col("createdAt").alias("created_at"),
        F.col("mergedAt").alias("merged_at"),
        F.coalesce(closing_issue_texts(F.col("closingIssuesReferences.nodes")), F.array().cast("array<string>")).alias("closing_issues"),
    )


def read_changelog(spark: SparkSession, path: str, as_of: str) -> DataFrame:
    """A changelog file as one release record."""
    return spark.read.text(path, wholetext=True).select(
        F.lit("CHANGELOG").alias("tag"),
        F.lit(None).cast("string").alias("tag_name"),
        F.lit("CHANGELOG").alias("name"),
        F.col("value").alias("body"),
        F.lit(as_of).alias("created_at"),
        F.lit(as_of).alias("published_at"),
        F.lit(as_of).alias("timestamp"),
    )


def read_documents(spark: SparkSession, path: str, doc_type: str | None = None) -> DataFrame:
    """The document table, partitioned by type; a type prunes to its partition."""
    rows = spark.read.schema(schemas.DOCUMENT).parquet(path)
    return rows if doc_type is None else rows.filter(F.col("doc_type") == doc_type)


def find_document(documents: DataFrame, doc_type: str, doc_id: str) -> DataFrame:
    return documents.filter((F.col("doc_type") == doc_type) & (F.col("doc_id") == doc_id)).limit(1)


def read_chunks(spark: SparkSession, path: str) -> DataFrame:
    """Chunk file lines {text, metadata}; blank lines and rows without an id are left out."""
    inner = schemas.CHUNK.replace("text STRING, ", "", 1)
    fields = ", ".join(f"{c.strip().split(' ', 1)[0]}: {c.strip().split(' ', 1)[1]}" for c in inner.split(", "))
    rows = spark.read.schema(f"text STRING, metadata STRUCT<{fields}>").json(path)
    return rows.select("text", "metadata.*").filter("chunk_id IS NOT NULL")


def keep_last(rows: DataFrame, keys: list[str], order: Column) -> DataFrame:
    """The last row of each key; rows with a null key are left out."""
    last = Window.partitionBy(*keys).orderBy(order.desc())
    held = rows.dropna(subset=keys)
    return held.withColumn("_turn_", F.row_number().over(last)).filter("_turn_ = 1").drop("_turn_")


def chunks_by_node(chunks: DataFrame, order: Column) -> DataFrame:
    listed = F.sort_array(F.collect_list(F.struct(order.alias("o"), F.col("chunk_id"))))
    return chunks.groupBy("graph_node_id").agg(F.transform(listed, lambda x: x["chunk_id"]).alias("chunk_ids"))


def find_chunks(chunks: DataFrame, wanted: DataFrame) -> DataFrame:
    """Chunks of ``wanted`` (position, chunk_id), with the position; missing ones are left out."""
    return wanted.join(chunks, "chunk_id")


def read_qa_pairs(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(schemas.QA_PAIR).json(path)


def since(commits: DataFrame, sha: str | None = None, most: int | None = None, order: str = "authored_at") -> DataFrame:
    """Commits after ``sha`` (itself left out), the newest ``most`` of them; an unknown sha cuts nothing."""
    if sha is not None:
        known = commits.filter(F.col("sha") == sha).agg(F.max(F.struct(order, "sha")).alias("at"))
        commits = commits.crossJoin(F.broadcast(known)).filter(F.col("at").isNull() | (F.struct(order, "sha") > F.col("at"))).drop("at")
    return commits if most is None else commits.orderBy(F.desc(order), F.desc("sha")).limit(most)
