"""From landed documents to the tables that questions are answered from."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from annalist.functions import text as X
from annalist.operators import chunking, entities, graph, parsing, search


def parse_all(documents: DataFrame, as_of: str) -> dict[str, DataFrame]:
    raw = {t: parsing.payloads(documents, t) for t in ("commit", "pr", "issue", "release", "cicd", "pr_graphql")}
    return {
        "commit": parsing.parse_commits(raw["commit"], as_of),
        "pr": parsing.parse_prs(raw["pr"]),
        "issue": parsing.parse_issues(raw["issue"]),
        "release": parsing.parse_releases(raw["release"]),
        "cicd": parsing.parse_ci_runs(raw["cicd"]),
        "pr_graphql": parsing.parse_graphql_prs(raw["pr_graphql"]),
    }


def chunk_all(parsed: dict[str, DataFrame], repo: str, as_of: str) -> DataFrame:
    parts = [
        chunking.commit_chunks(parsed["commit"], repo, as_of),
        chunking.diff_chunks(parsed["commit"], repo, as_of),
        chunking.pr_chunks(parsed["pr"], repo, as_of),
        chunking.issue_chunks(parsed["issue"], repo, as_of),
        chunking.release_chunks(parsed["release"], repo, as_of),
        chunking.log_chunks(parsed["cicd"], "cicd", repo, as_of),
        chunking.log_chunks(parsed["pr_graphql"], "pr_graphql", repo, as_of),
    ]
    return reduce(DataFrame.unionByName, parts)


def entity_texts(parsed: dict[str, DataFrame]) -> DataFrame:
    """(doc_id, doc_type, text) that entities are drawn from: no diffs, no releases."""
    def of(kind: str, key: str, *texts) -> DataFrame:
        return parsed[kind].select(F.col(key).cast("string").alias("doc_id"), F.lit(kind).alias("doc_type"), F.concat_ws("\n", *texts).alias("text"))

    return reduce(
        DataFrame.unionByName,
        [
            of("commit", "sha", F.col("message")),
            of("pr", "number", F.col("title"), F.col("body_clean")),
            of("issue", "number", F.col("title"), F.col("body_clean"), F.array_join("comments", "\n")),
            of("cicd", "run_id", F.col("body_clean")),
            of("pr_graphql", "number", F.col("title"), F.col("body_clean")),
        ],
    )


def build_registry(parsed: dict[str, DataFrame]) -> DataFrame:
    return entities.register(entities.resolve_exact(entities.mentions(entity_texts(parsed))))


def build_graph(documents: DataFrame, parsed: dict[str, DataFrame]) -> DataFrame:
    prs, issues, commits = (parsing.payloads(documents, t) for t in ("pr", "issue", "commit"))
    issues = issues.filter("pull_request IS NULL")
    return graph.edges(
        graph.pr_issue_links(prs, issues), graph.merge_links(commits, prs), graph.parsed_issue_edges(parsed["pr"], parsed["issue"])
    )


def build_indexes(chunks: DataFrame) -> dict[str, DataFrame]:
    """Postings and statistics of the two term indexes; once postings are written, ``search.length_stats`` has the same statistics for less."""
    words, terms = X.search_tokens(F.col("text")), X.fulltext_tokens(F.col("text"))
    return {
        "bm25_postings": search.postings(chunks, words),
        "bm25_stats": search.corpus_stats(chunks, words),
        "fts_postings": search.stemmed(search.postings(chunks, terms, keep=("doc_type",))),
        "fts_stats": search.corpus_stats(chunks, terms),
    }


def report(chunks: DataFrame) -> DataFrame:
    return chunks.groupBy("doc_type").agg(F.count(F.lit(1)).alias("chunks"), F.count_distinct("doc_id").alias("documents"))


def build(documents: DataFrame, repo: str = "", as_of: str = "1970-01-01") -> dict[str, DataFrame]:
    """All tables, lazily; write each where it is to stay."""
    parsed = parse_all(documents, as_of)
    chunks = chunk_all(parsed, repo, as_of)
    return {"chunks": chunks, "entities": build_registry(parsed), "edges": build_graph(documents, parsed), **build_indexes(chunks)}
