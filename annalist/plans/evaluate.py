"""Question-answer pairs through the whole way from retrieval to answers, and what the answers are worth."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from annalist.functions import text as X
from annalist.operators import evaluation, search
from annalist.plans import answer as answering
from annalist.sources import sinks


def run(tables: dict[str, DataFrame], pairs: DataFrame, most: int | None = None, **options) -> dict[str, DataFrame]:
    """``results`` (query_id, question, ground_truth, answer, context, timestamps, doc_types, entity_tags) and one row of ``metrics``.

    ``pairs`` has question, answer, source_chunk_id and qa_type; ``most`` takes
    the first so many in order of chunk and type.  ``options`` are those of
    ``answer``.  All pairs are one batch: retrieval, expansion, rerank and
    context are planned once.  A pair whose question finds nothing keeps an empty
    answer and context, and counts in the metrics' denominators as such.
    """
    chosen = pairs if most is None else pairs.orderBy("source_chunk_id", "qa_type").limit(most)
    key = F.concat_ws(":", F.col("source_chunk_id").cast("string"), "qa_type")
    asked = sinks.written(chosen.select(key.alias("query_id"), "question", F.col("answer").alias("ground_truth")), "pairs")
    out = answering.answer(tables, asked.select("query_id", F.col("question").alias("query")), **options)
    shown = out["evidence"].select("query_id", "rank", "chunk_id", "doc_type", X.iso(F.col("timestamp")).alias("timestamp"))
    tags = tables["chunks"].select("chunk_id", "entity_tags")
    item = F.struct("rank", F.coalesce("timestamp", F.lit("")).alias("t"), F.coalesce("doc_type", F.lit("")).alias("d"), F.coalesce("entity_tags", F.array().cast("array<string>")).alias("e"))
    seen = search.hydrate(shown, tags).groupBy("query_id").agg(F.sort_array(F.collect_list(item)).alias("x"))
    none = F.array().cast("array<string>")
    results = (
        asked.join(out["answers"].select("query_id", "answer", "context"), "query_id", "left")
        .join(seen, "query_id", "left")
        .select(
            "query_id",
            "question",
            "ground_truth",
            F.coalesce("answer", F.lit("")).alias("answer"),
            F.coalesce("context", F.lit("")).alias("context"),
            F.coalesce(F.col("x.t"), none).alias("timestamps"),
            F.coalesce(F.col("x.d"), none).alias("doc_types"),
            F.coalesce(F.col("x.e"), F.array().cast("array<array<string>>")).alias("entity_tags"),
        )
    )
    results = sinks.written(results, "results")
    return {"results": results, "metrics": evaluation.metrics(results)}
