"""A batch of questions as one plan: retrieve, fuse, expand, rerank, assemble, ask."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from annalist import schemas
from annalist.functions import text as X
from annalist.functions.stemming import stem_words
from annalist.operators import context, graph, planning, search
from annalist.operators.embedding import Embedder, embed_texts
from annalist.sources import sinks


def check_request(mode: str, top_k: int, limit: int) -> None:
    if mode not in schemas.MODES:
        raise ValueError(f"mode must be one of {', '.join(schemas.MODES)}")
    if not 1 <= top_k <= 40:
        raise ValueError("top_k must be from 1 to 40")
    if not 5 <= limit <= 100:
        raise ValueError("limit must be from 5 to 100")


def stemmed_terms(queries: DataFrame) -> DataFrame:
    terms = search.query_terms(queries, X.fulltext_tokens(X.without_punctuation(F.col("query"))))
    stems = terms.select("term").distinct().select("term", stem_words("term").alias("stem"))
    return terms.join(stems, "term").groupBy("query_id", F.col("stem").alias("term")).agg(F.sum("qtf").alias("qtf"))


def retrieve(
    tables: dict[str, DataFrame],
    queries: DataFrame,
    limit: int = 40,
    where: Column | None = None,
    weights: dict[str, float] | None = None,
    code: bool = True,
    doc_type: str | None = None,
) -> DataFrame:
    """Fused candidates.  ``where`` restricts the dense rankers only, ``doc_type`` the full-text one.

    ``tables``: chunks, bm25_postings, bm25_stats, fts_postings, fts_stats and, for
    dense ranking, vectors (chunk_id, semantic_vector, code_vector and the
    columns of ``where``); ``queries``: query_id, query and then query_vector.
    """
    words = search.query_terms(queries, X.search_tokens(F.col("query")))
    rankings = {
        "bm25": search.bm25(tables["bm25_postings"], tables["bm25_stats"], words, limit),
        "fts": search.fulltext(tables["fts_postings"], tables["fts_stats"], stemmed_terms(queries), limit, doc_type=doc_type),
    }
    if "vectors" in tables:
        rankings["qdrant_semantic"] = search.dense(tables["vectors"], queries, limit, where)
        if code:
            rankings["qdrant_code"] = search.dense(tables["vectors"], queries, limit, where, "code_vector")
    return search.fuse(rankings, limit, weights)


def answer(
    tables: dict[str, DataFrame],
    queries: DataFrame,
    mode: str = "direct",
    top_k: int = 12,
    limit: int = 40,
    embedder: Embedder | None = None,
    dim: int = 768,
    where: Column | None = None,
    scorer: context.Scorer | None = None,
    writer: context.Writer | None = None,
    hops: int = 1,
    budget: int = context.BUDGET,
    doc_type: str | None = None,
) -> dict[str, DataFrame]:
    """``answers`` (query_id, query, context, answer, evidence, n_chunks, used_tokens[, memo]) and ``evidence`` rows.

    Questions of fewer than 3 characters are left out.  Where candidates are
    expanded and no scorer is given, words in common decide between what was
    found and what the graph adds; an order by ranks alone would leave all of the
    latter out.
    """
    check_request(mode, top_k, limit)
    asked = planning.plan(queries.filter(F.length("query") >= 3))
    if embedder is not None and "vectors" in tables:
        asked = embed_texts(asked, embedder, "query", dim).withColumnRenamed("vector", "query_vector")
        found = retrieve(tables, sinks.written(asked, "questions"), limit, where, doc_type=doc_type)
    else:
        found = retrieve({k: v for k, v in tables.items() if k != "vectors"}, asked, limit, doc_type=doc_type)
    if "edges" in tables:
        found = graph.expand_candidates(sinks.written(found, "candidates"), tables["chunks"], tables["edges"], hops)
        scorer = scorer or context.word_overlap
    rows = found
    if scorer is not None:
        texts = tables["chunks"].select("chunk_id", "text")
        rows = search.hydrate(found, texts).join(asked.select("query_id", "query"), "query_id")
    chosen = context.rerank(rows, top_k, scorer).select("query_id", "rank", "chunk_id", "score")
    full = sinks.written(search.hydrate(chosen, tables["chunks"]), "chosen")
    blocks = full.withColumn("block", context.block(F.col("doc_type"), F.col("doc_id"), X.iso(F.col("timestamp")), F.col("author"), F.col("text")))
    contexts = context.assemble(blocks, budget)
    ready = asked.select("query_id", "query").join(contexts, "query_id").withColumn("prompt", context.prompt(mode, F.col("query"), F.col("context")))
    written = context.write_answers(ready, writer).withColumn("evidence", context.evidence(F.col("context")))
    if mode == "memo":
        written = written.withColumn("memo", context.memo(F.col("answer")))
    shown = full.select(
        "query_id", "rank", "chunk_id", "doc_type", "doc_id", "timestamp", "author",
        F.round("score", 4).alias("score"), context.snippet(F.col("text")).alias("snippet"),
    )
    return {"answers": written.drop("prompt"), "evidence": shown}
