"""python -m annalist: build tables from landed records, ask questions, make and run evaluations, look at what is there."""

from __future__ import annotations

import argparse
import json
import sys
from collections.abc import Sequence

from pyspark.sql import SparkSession

from annalist import schemas
from annalist.operators import evaluation
from annalist.operators.embedding import dual_vectors, embed_texts, hashing_embedder
from annalist.plans import answer as answering
from annalist.plans import build as building
from annalist.plans import evaluate
from annalist.sources import landing, sinks

TABLES = ("chunks", "entities", "edges", "bm25_postings", "bm25_stats", "fts_postings", "fts_stats", "vectors")


def ingest(spark: SparkSession, landed: str, out: str, repo: str, as_of: str, dim: int) -> dict:
    """Landed folders (one per record type, JSON lines) to the tables that questions are answered from."""
    parts = []
    for kind in ("commit", "pr", "issue", "release", "cicd", "pr_graphql"):
        try:
            parts.append(sinks.to_documents(landing.read_records(spark, f"{landed}/{kind}", kind), kind))
        except Exception as e:
            if "PATH_NOT_FOUND" not in str(e):
                raise
    documents = spark.createDataFrame([], schemas.DOCUMENT)
    for part in parts:
        documents = documents.unionByName(part.select("doc_type", "doc_id", "payload"))
    tables = building.build(documents, repo, as_of)
    sinks.save_tables({k: tables.pop(k) for k in ("chunks", "entities", "edges")}, out)
    chunks = sinks.current(spark, f"{out}/chunks")
    vectors = dual_vectors(embed_texts(chunks.select("chunk_id", "doc_type", "text", "author", "timestamp", "module_tags"), hashing_embedder(dim), dim=dim), dim=dim)
    sinks.save_tables(building.build_indexes(chunks) | {"vectors": vectors.drop("text")}, out)
    return {"documents": documents.count()} | health(spark, out)


def health(spark: SparkSession, path: str) -> dict:
    """Rows of each table; a table that is not there counts null."""
    out: dict = {}
    for name in TABLES:
        try:
            out[name] = sinks.current(spark, f"{path}/{name}").count()
        except Exception as e:
            if "PATH_NOT_FOUND" not in str(e):
                raise
            out[name] = None
    out["status"] = "ok" if all(v is not None for v in out.values()) else "incomplete"
    return out


def ask(spark: SparkSession, path: str, questions: Sequence[str], mode: str, limit: int, top_k: int, dim: int, doc_type: str | None = None) -> list[dict]:
    asked = spark.createDataFrame(list(enumerate(questions)), "query_id int, query string")
    tables = sinks.load_tables(spark, path, *TABLES)
    out = answering.answer(tables, asked, mode, top_k, limit, hashing_embedder(dim), dim, doc_type=doc_type)
    return [json.loads(x) for x in out["answers"].orderBy("query_id").toJSON().collect()]


def build_dataset(spark: SparkSession, path: str, out: str, most: int) -> int:
    chosen = evaluation.sample(sinks.current(spark, f"{path}/chunks"), most)
    pairs = sinks.written(evaluation.qa_dataset(chosen.select("chunk_id", "text")), "qa_pairs")
    sinks.write_qa_pairs(pairs, out)
    return pairs.count()


def run_evaluation(spark: SparkSession, path: str, dataset: str, most: int, dim: int) -> dict:
    tables = sinks.load_tables(spark, path, *TABLES)
    found = evaluate.run(tables, landing.read_qa_pairs(spark, dataset), most, embedder=hashing_embedder(dim), dim=dim)
    return found["metrics"].head().asDict() | {"pairs": found["results"].count()}


def main(argv: Sequence[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="annalist", description=__doc__)
    parser.add_argument("--dim", type=int, default=256, help="length of the offline embedder's vectors")
    commands = parser.add_subparsers(dest="command", required=True)
    c = commands.add_parser("ingest", help="landed records to tables")
    c.add_argument("landed"), c.add_argument("tables"), c.add_argument("--repo", default=""), c.add_argument("--as-of", default="1970-01-01")
    c = commands.add_parser("answer", help="contexts and answers of questions")
    c.add_argument("tables"), c.add_argument("questions", nargs="+"), c.add_argument("--mode", default="direct", choices=schemas.MODES)
    c.add_argument("--limit", type=int, default=40), c.add_argument("--top-k", type=int, default=12), c.add_argument("--doc-type")
    c = commands.add_parser("build-dataset", help="question-answer pairs of sampled chunks")
    c.add_argument("tables"), c.add_argument("out"), c.add_argument("--limit", type=int, default=100)
    c = commands.add_parser("evaluate", help="pairs through the whole way, and three ratios")
    c.add_argument("tables"), c.add_argument("dataset"), c.add_argument("--limit", type=int, default=20)
    c = commands.add_parser("status", help="rows of each table")
    c.add_argument("tables")
    o = parser.parse_args(argv)
    spark = SparkSession.builder.appName("annalist").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    if o.command == "ingest":
        out: object = ingest(spark, o.landed, o.tables, o.repo, o.as_of, o.dim)
    elif o.command == "answer":
        out = ask(spark, o.tables, o.questions, o.mode, o.limit, o.top_k, o.dim, o.doc_type)
    elif o.command == "build-dataset":
        out = {"pairs": build_dataset(spark, o.tables, o.out, o.limit)}
    elif o.command == "evaluate":
        out = run_evaluation(spark, o.tables, o.dataset, o.limit, o.dim)
    else:
        out = health(spark, o.tables)
    print(json.dumps(out, indent=2, default=str))
    return 0


if __name__ == "__main__":
    sys.exit(main())
