"""Question-answer data sets and answer metrics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from annalist.functions import text as X

TEMPLATES = (
    ("standard", "What does this change describe?", None),
    ("temporal", "When did this happen?", "Unknown"),
    ("multihop", "What led to this change?", "Unknown"),
)
ADVERSARIAL = ("Is there evidence of a database migration in this context?", "I could not find evidence in the provided context.")


def sample(chunks: DataFrame, n: int, seed: int = 0) -> DataFrame:
    """``n`` chunks by a hash of their id: the same in every run, wherever the rows lie."""
    return chunks.withColumn("_order_", F.xxhash64(F.lit(seed), F.col("chunk_id").cast("string"))).orderBy("_order_", "chunk_id").limit(n)


def qa_dataset(chosen: DataFrame, order: Column | None = None, adversarial: bool = True) -> DataFrame:
    """Dry-run pairs of chosen chunks (chunk_id, text): three per chunk, and one more for the first tenth (one at least)."""
    pair = [
        F.struct(
            F.lit(kind).alias("qa_type"),
            F.lit(question).alias("question"),
            (F.substring("text", 1, 200) if answer is None else F.lit(answer)).alias("answer"),
        )
        for kind, question, answer in TEMPLATES
    ]
    rows = chosen.select("chunk_id", "text", F.explode(F.array(*pair)).alias("p"))
    if adversarial:
        n = chosen.count()
        first = chosen.orderBy(F.col("chunk_id") if order is None else order).limit(max(1, n // 10))
        extra = F.struct(F.lit("adversarial").alias("qa_type"), F.lit(ADVERSARIAL[0]).alias("question"), F.lit(ADVERSARIAL[1]).alias("answer"))
        rows = rows.unionByName(first.select("chunk_id", "text", extra.alias("p")))
    return rows.select("p.question", "p.answer", F.col("text").alias("context"), F.col("chunk_id").alias("source_chunk_id"), "p.qa_type")


def _ratio(hit: Column, eligible: Column) -> Column:
    hits = F.sum(F.when(eligible & hit, 1).otherwise(0))
    return F.coalesce(hits, F.lit(0)) / F.greatest(F.lit(1), F.coalesce(F.sum(F.when(eligible, 1).otherwise(0)), F.lit(0)))


def temporal_accuracy(answer: Column, timestamps: Column) -> Column:
    """Of the answers that name a year, the share whose years meet those of their context's times."""
    told = X.years(answer)
    known = F.flatten(F.transform(timestamps, X.years))
    return _ratio(F.arrays_overlap(told, known), F.size(told) > 0)


def multihop_coverage(doc_types: Column) -> Column:
    """Share of answers whose context has more than one type of document."""
    kinds = F.array_distinct(F.filter(doc_types, lambda t: F.coalesce(t, F.lit("")) != ""))
    return _ratio(F.size(kinds) > 1, F.lit(True))


def entity_consistency(answer: Column, entity_tags: Column) -> Column:
    """Of the answers with capitalised names, the share that shares one with its context's entity tags (lists of lists)."""
    words = F.regexp_extract_all(F.coalesce(answer, F.lit("")), F.lit(r"([\p{L}\p{N}_]+)"), 1)
    names = F.filter(words, lambda w: w.rlike(r"\A[A-Z](?:\w{2,}|[A-Z]+)\z"))
    low = F.transform(names, F.lower)
    tags = F.transform(F.filter(F.flatten(entity_tags), lambda t: F.coalesce(t, F.lit("")) != ""), F.lower)
    return _ratio(F.arrays_overlap(low, tags), F.size(names) > 0)


def metrics(rows: DataFrame) -> DataFrame:
    """One row of the three ratios; ``rows`` has answer, timestamps, doc_types, entity_tags."""
    return rows.agg(
        temporal_accuracy(F.col("answer"), F.col("timestamps")).alias("temporal_accuracy"),
        multihop_coverage(F.col("doc_types")).alias("multihop_coverage"),
        entity_consistency(F.col("answer"), F.col("entity_tags")).alias("entity_consistency"),
    )
