"""Rankers, fusion, graph, context, state, evaluation, and the whole way from landed documents to answers."""

import json
import math
import sqlite3

import pytest
from pyspark.sql import functions as F

from annalist import schemas
from annalist.functions import text as X
from annalist.operators import context, embedding, entities, evaluation, graph, planning, search
from annalist.plans import answer as answering
from annalist.plans import build as building
from annalist.plans import reports
from annalist.sources import git, hosting, landing, sinks
from annalist.streaming import ingest

CORPUS = [
    ("c1", "JWT authentication replaces sessions; tokens expire"), ("c2", "The database migration runs nightly and migrations log"),
    ("c3", "Rate limiter with Redis"), ("c4", "Running the limiter: tokens, tokens and more tokens"), ("c5", "Café olé"), ("c6", ""),
]


@pytest.fixture(scope="module")
def corpus(spark):
    return spark.createDataFrame(CORPUS, "chunk_id string, text string")


def asked(spark, *texts):
    return spark.createDataFrame(list(enumerate(texts)), "query_id int, query string")


def ranked(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: (r.query_id, r.rank)):
        out.setdefault(r.query_id, []).append((r.chunk_id, r.score))
    return out


def test_fulltext_equals_sqlite(spark, corpus):
    db = sqlite3.connect(":memory:")
    db.execute("create virtual table t using fts5(id unindexed, text, tokenize='porter unicode61')")
    db.executemany("insert into t values (?, ?)", CORPUS)
    questions = ["tokens", "run", "limiter tokens", "migration", "cafe", "nothing here", "the"]
    terms = X.fulltext_tokens(F.col("text"))
    got = ranked(
        search.fulltext(search.stemmed(search.postings(corpus, terms)), search.corpus_stats(corpus, terms), answering.stemmed_terms(asked(spark, *questions)))
    )
    for i, q in enumerate(questions):
        want = db.execute("select id, rank from t where t match ? order by rank, id limit 20", (" ".join(q.split()),)).fetchall()
        assert [c for c, _ in got.get(i, [])] == [c for c, _ in want]
        assert [s for _, s in got.get(i, [])] == pytest.approx([s for _, s in want], rel=1e-9)


def test_bm25(spark, corpus):
    words = X.search_tokens(F.col("text"))
    got = ranked(
        search.bm25(search.postings(corpus, words), search.corpus_stats(corpus, words), search.query_terms(asked(spark, "tokens of the limiter", "zzz"), X.search_tokens(F.col("query"))), 2)
    )
    assert set(got) == {0} and [c for c, _ in got[0]] == ["c4", "c3"]
    import re

    docs = {i: [w for w in re.findall(r"\w\w+", t.lower()) if w not in X.STOPWORDS] for i, t in CORPUS}
    avg = sum(map(len, docs.values())) / len(docs)

    def score(d):
        total = 0
        for t in ("tokens", "limiter"):
            df, tf = sum(t in w for w in docs.values()), docs[d].count(t)
            total += math.log(1 + (6 - df + 0.5) / (df + 0.5)) * tf / (tf + 1.5 * (0.25 + 0.75 * len(docs[d]) / avg))
        return total

    assert dict(got[0]) == pytest.approx({d: score(d) for d in ("c4", "c3")})


def test_dense_and_filter(spark):
    rows = [("a", [1.0, 0.0], "commit", ["x"]), ("b", [1.0, 1.0], "pr", ["y"]), ("c", [0.0, 0.0], "pr", []), ("d", [-1.0, 0.0], "diff", ["x"])]
    vectors = spark.createDataFrame(rows, "chunk_id string, semantic_vector array<float>, doc_type string, module_tags array<string>")
    questions = spark.createDataFrame([(0, [1.0, 0.0])], "query_id int, query_vector array<float>")
    assert [c for c, _ in ranked(search.dense(vectors, questions, 3))[0]] == ["a", "b", "c"]
    assert [c for c, _ in ranked(search.dense(vectors, questions, 3, search.payload_filter(doc_types=["pr"])))[0]] == ["b", "c"]
    assert [c for c, _ in ranked(search.dense(vectors, questions, 3, search.payload_filter(module_tags=["x"])))[0]] == ["a", "d"]
    assert search.payload_filter() is None


def test_fusion(spark):
    def ranking(*ids):
        return spark.createDataFrame([(0, i, c, 1.0) for i, c in enumerate(ids)], "query_id int, rank int, chunk_id string, score double")

    parts = {"qdrant_semantic": ranking("a", "b"), "bm25": ranking("b", "c"), "fts": ranking("c")}
    got = {r.chunk_id: (r.rank, r.score, r.source) for r in search.fuse(parts).collect()}
    assert got["b"] == (0, pytest.approx(1 / 62 + 0.7 / 61), "qdrant_semantic")
    assert got["c"] == (1, pytest.approx(0.7 / 62 + 0.6 / 61), "bm25")
    assert got["a"] == (2, pytest.approx(1 / 61), "qdrant_semantic")
    own = {r.chunk_id: r.score for r in search.fuse({"qdrant_code": ranking("a")}, weights={"bm25": 2.0}).collect()}
    assert own["a"] == pytest.approx(1 / 61)
    shuffled = {k: v.orderBy(F.rand(1)) for k, v in parts.items()}
    assert {r.chunk_id: r.rank for r in search.fuse(shuffled).collect()} == {"b": 0, "c": 1, "a": 2}


def test_context(spark):
    rows = spark.createDataFrame([(0, r, "x" * n) for r, n in enumerate([40, 8, 4000, 2, 1])], "query_id int, rank int, block string")
    got = context.assemble(rows, 20).head()
    assert (got.n_chunks, got.used_tokens, got.context) == (2, 12, "x" * 40 + "\n---\n" + "x" * 8)
    text = "[pr] [42] [2023] [bob]\nbody\n\n---\n[commit] [abc] [] []\n[pr] [42] [x]\n[solo]\n"
    row = spark.createDataFrame([(text,)], "c string")
    assert row.select(context.evidence(F.col("c"))).head()[0] == ["pr:42", "commit:abc"]
    p = row.select(context.prompt("blame", F.lit("auth"), F.lit("CTX"))).head()[0]
    assert "Context:\nCTX" in p and "Module: auth" in p


def test_memo(spark):
    memo = {"decision": "d", "context": "c", "rationale": "r", "evidence": ["x"]}
    rows = spark.createDataFrame([(json.dumps(memo),), ("So:\n" + json.dumps(memo) + "\nbye",), ("none",), ('{"decision": "d"}',)], "a string")
    got = [r[0] for r in rows.select(context.memo(F.col("a"))).collect()]
    assert got[0].evidence == ["x"] and got[1].decision == "d" and got[2] is None and got[3] is None


def test_rerank(spark):
    rows = spark.createDataFrame([(0, i, f"c{i}", "q", t) for i, t in enumerate(["bb", "a", "bbb", "bb"])], "query_id int, rank int, chunk_id string, query string, text string")
    assert [r.chunk_id for r in context.rerank(rows, 2).orderBy("rank").collect()] == ["c0", "c1"]
    got = context.rerank(rows, 3, lambda q, t: t.str.len()).orderBy("rank").collect()
    assert [r.chunk_id for r in got] == ["c2", "c0", "c3"]


def test_graph(spark):
    e = [line.split() for line in ("commit a pr 1 merge_commit", "pr 1 issue 7 mentions", "pr 2 issue 7 mentions", "pr 1 issue 7 mentions")]
    edges = graph.edges(spark.createDataFrame(e, schemas.EDGE))
    assert edges.count() == 3
    seeds = spark.createDataFrame([("pr", "1"), ("issue", "7")], "seed_type string, seed_id string")
    near = {(r.seed_id, r.type, r.id, r.direction) for r in graph.neighbours(edges, seeds).collect()}
    assert near == {("1", "commit", "a", "in"), ("1", "issue", "7", "out"), ("7", "pr", "1", "in"), ("7", "pr", "2", "in")}
    assert graph.neighbours(edges, seeds, "mentions", "out").count() == 1
    one = {(r.seed_id, r.id, r.depth) for r in graph.expand(edges, seeds, 1).collect()}
    two = {(r.seed_id, r.id, r.depth) for r in graph.expand(edges, seeds, 2).collect()}
    assert one < two and two - one == {("1", "2", 2), ("7", "a", 2)}


def test_links(spark):
    prs = spark.createDataFrame([(1, "see #7 #7", "#8"), (2, None, "#9")], "number int, title string, body string")
    issues = spark.createDataFrame([(7,), (8,)], "number int")
    assert {r.link_id for r in graph.pr_issue_links(prs, issues).collect()} == {"pr:1->issue:7:mentions", "pr:1->issue:8:mentions"}
    merged = spark.createDataFrame([(1, "s"), (3, "s"), (4, None)], "number int, merge_commit_sha string")
    commits = spark.createDataFrame([("s",), ("t",)], "sha string")
    assert [r.link_id for r in graph.merge_links(commits, merged).collect()] == ["commit:s->pr:3:merge_commit"]


def test_entities(spark):
    rows = [("d1", "We switched from sessions to JWT authentication. jwt and PostgreSQL."), ("d2", "jwt, Jwt"), ("d3", None)]
    found = entities.mentions(spark.createDataFrame(rows, "doc_id string, text string"))
    assert {(r.doc_id, r.surface) for r in found.collect()} == {("d1", "JWT"), ("d1", "PostgreSQL"), ("d2", "jwt")}
    registry = entities.register(entities.resolve_exact(found))
    got = {r.canonical_name: (r.aliases, r.doc_ids) for r in registry.collect()}
    assert got == {"JWT": (["jwt"], ["d1", "d2"]), "PostgreSQL": ([], ["d1"])}
    terms = spark.createDataFrame([("j",), ("post",), ("d1 postg",), ("zz",), (" ",)], "term string")
    hits = {(r.term, r.canonical_name) for r in entities.prefix_search(registry, terms).collect()}
    assert hits == {("j", "JWT"), ("post", "PostgreSQL"), ("d1 postg", "PostgreSQL")}
    names = spark.createDataFrame([("auth service", 1), ("Auth Service", 2), ("auth services", 3), ("billing", 4)], "surface string, seq int")
    assert {r.surface: r.canonical_name for r in entities.resolve_fuzzy(names).collect()} == {
        "auth service": "auth service", "Auth Service": "auth service", "auth services": "auth service", "billing": "billing",
    }
    merged = entities.merge_registry(registry, registry.limit(1))
    assert merged.count() == 2


def test_plan(spark):
    rows = asked(spark, 'What did "auth service" do in 2021 and 2019?', "plain")
    got = {r.query_id: r for r in planning.plan(rows).collect()}
    assert (got[0].time_start, got[0].time_end, got[0].entities) == ("2021-01-01", "2019-12-31", ["auth service"])
    assert got[1].time_start is None and got[1].entities == [] and got[1].sub_queries == ["plain"]
    model = rows.withColumn("m", F.when(F.col("query_id") == 1, F.lit('{"entities": ["x"], "intent": "why"}')).otherwise("oops"))
    got = {r.query_id: r for r in planning.plan(model, "m").collect()}
    assert got[1].entities == ["x"] and got[1].intent == "why" and got[0].entities == ["auth service"]


def test_embedding(spark):
    rows = spark.createDataFrame([("1", "alpha beta"), ("2", "  "), ("3", "alpha beta"), ("4", "bad")], "chunk_id string, text string")
    calls = spark.sparkContext.accumulator(0)
    plain = embedding.hashing_embedder(16)

    def embed(texts):
        calls.add(len(texts))
        if "bad" in texts:
            raise ValueError
        return plain(texts)

    got = {r.chunk_id: r.vector for r in embedding.embed_texts(rows, embed, dim=16).collect()}
    assert got["1"] == got["3"] and any(got["1"]) and not any(got["2"]) and got["4"] is None
    cache = spark.createDataFrame([], "cache_key string, vector array<float>")
    whole, fresh = embedding.cached_embeddings(rows, cache, plain, "m", dim=16)
    assert fresh.count() == 3 and whole.count() == 4
    assert embedding.cached_embeddings(rows, fresh, plain, "m", dim=16)[1].count() == 0
    dual = embedding.dual_vectors(spark.createDataFrame([("1", "diff", [1.0]), ("2", "pr", [1.0])], "chunk_id string, doc_type string, vector array<float>"), dim=1)
    points = embedding.vector_points(dual, 1)
    assert tuple(embedding.count_code_vectors(points).head()) == (1, 2)


def test_metrics(spark):
    rows = spark.createDataFrame(
        [("In 2021 JWT", ["2021-05-01"], ["pr", "commit"], [["jwt"]]), ("In 2020", ["2021"], ["pr", ""], [[]]), ("no", [], [], [["x"]])],
        "answer string, timestamps array<string>, doc_types array<string>, entity_tags array<array<string>>",
    )
    got = evaluation.metrics(rows).head()
    assert (got.temporal_accuracy, got.multihop_coverage, got.entity_consistency) == (0.5, pytest.approx(1 / 3), 1.0)
    none = evaluation.metrics(rows.limit(0)).head()
    assert tuple(none) == (0.0, 0.0, 0.0)
    chunks = spark.createDataFrame([(str(i), f"text {i}") for i in range(25)], "chunk_id string, text string")
    chosen = evaluation.sample(chunks, 20)
    kinds = {r.qa_type: r["count"] for r in evaluation.qa_dataset(chosen).groupBy("qa_type").count().collect()}
    assert kinds == {"standard": 20, "temporal": 20, "multihop": 20, "adversarial": 2}
    assert {r.chunk_id for r in chosen.collect()} == {r.chunk_id for r in evaluation.sample(chunks.repartition(5), 20).collect()}


def test_state(spark, tmp_path):
    old = spark.createDataFrame([("r", "a", None, "x"), ("s", "b", "u", None)], "repo string, sha string, pr string, issue string")
    new = spark.createDataFrame([("r", None, "p", None), ("t", "c", None, None)], old.schema)
    got = {r.repo: tuple(r)[1:] for r in sinks.merge_checkpoint(old, new).collect()}
    assert got == {"r": ("a", "p", "x"), "s": ("b", "u", None), "t": ("c", None, None)}
    docs = spark.createDataFrame([("pr", "1", "old"), ("pr", "2", "two")], schemas.DOCUMENT)
    path = str(tmp_path / "docs")
    sinks.replace(spark, docs, path, "doc_type")
    up = sinks.upsert(sinks.current(spark, path).select(docs.columns), spark.createDataFrame([("pr", "1", "new")], docs.schema), ["doc_type", "doc_id"])
    sinks.replace(spark, up, path, "doc_type")
    assert {(r.doc_id, r.payload) for r in sinks.current(spark, path).collect()} == {("1", "new"), ("2", "two")}
    sinks.log_run(spark, str(tmp_path / "runs"), {"k": 1}, {"m": 0.5}, "r1")
    assert spark.read.parquet(str(tmp_path / "runs")).count() == 2


def test_stream(spark, tmp_path):
    for i, (state, when) in enumerate([("open", "2023-01-01"), ("closed", "2023-01-02")]):
        (tmp_path / "landing").mkdir(exist_ok=True)
        (tmp_path / "landing" / f"{i}.json").write_text(json.dumps({"number": 5, "state": state, "updated_at": when}) + "\n")
        rows = ingest.read_stream(spark, str(tmp_path / "landing"), "pr")
        ingest.upsert_stream(rows, str(tmp_path / "table"), ["doc_type", "doc_id"], str(tmp_path / "progress")).awaitTermination()
        (row,) = sinks.current(spark, str(tmp_path / "table")).collect()
        assert json.loads(row.payload)["state"] == state
    rows = spark.createDataFrame([("pr", "6", "{}")], schemas.DOCUMENT)
    sinks.replace(spark, rows, str(tmp_path / "table"), tidy=True)
    assert len(list((tmp_path / "table").glob("v-*"))) == 2


def test_git_source(spark, tmp_path):
    import subprocess

    def run(*args):
        subprocess.run(["git", "-C", str(tmp_path), "-c", "user.name=Ann", "-c", "user.email=a@x", *args], check=True, capture_output=True)

    run("init", "-q")
    (tmp_path / "a.py").write_text("one\n")
    run("add", "."), run("commit", "-qm", "first\n\nbody")
    (tmp_path / "a.py").write_text("two\n")
    run("commit", "-qam", "second")
    git.register(spark)
    read = lambda **o: spark.read.format("git_history").option("path", str(tmp_path)).options(**o).load()
    got = {r.message: r for r in read(per_task=1).collect()}
    assert set(got) == {"first\n\nbody", "second"} and got["second"].stats.insertions == 1
    assert "-one\n+two" in got["second"].diff_text and got["first\n\nbody"].file_changes[0].change_type == "A"
    assert read(max_count=1).count() == 1 and read(since_sha=got["first\n\nbody"].sha).count() == 1
    parsed = building.parsing.parse_commits(read(), "2024-01-01")
    assert {h.file_path for r in parsed.collect() for h in r.hunks} == {"a.py"}
    assert reports.churn(parsed).head().commits == 2
    commits = read().withColumn("authored_at", F.when(F.col("message") == "second", "2").otherwise("1"))
    assert [r.message for r in landing.since(commits, got["first\n\nbody"].sha).collect()] == ["second"]


def test_hosting_rows():
    issue = {"number": 3, "title": "t", "labels": [{"name": "bug"}], "user": {"login": "u"}, "comments_data": [{"body": "c"}]}
    assert hosting.row_of("issue", issue)[8:10] == (["bug"], ["c"]) and hosting.row_of("issue", issue | {"pull_request": {}, "x": 1}) is not None
    assert hosting.row_of("issue", issue | {"pull_request": {"url": "x"}}) is None
    for kind in ("pr", "issue", "release", "cicd"):
        row = hosting.row_of(kind, {"number": 1, "id": 2})
        assert len(row) == len(schemas.PAYLOADS[kind][0].split(" STRING")) or row


def landed(spark):
    def doc(kind, key, **row):
        return kind, str(key), json.dumps(row)

    return spark.createDataFrame(
        [
            doc("commit", "s1", sha="s1", author_name="ann", authored_at="2023-01-02T00:00:00Z", message="Add JWT tokens\n\nReplaces sessions (#7)", file_paths=["src/auth/jwt.py"], diff_text="--- a/x\n+++ b/x\n@@ -1 +1 @@\n-a\n+jwt\n"),
            doc("pr", 1, number=1, title="JWT tokens", body="Fixes #7", state="closed", author="bob", created_at="2023-01-01T00:00:00Z", merge_commit_sha="s1", labels=["auth"], review_comments=["nice"]),
            doc("issue", 7, number=7, title="Sessions expire", body="Use Redis?", state="closed", author="eve", created_at="2022-12-01T00:00:00Z", comments=["yes", "no"]),
            doc("release", "v1", tag="v1", body="## v1.0 (2023-02-01)\nJWT", published_at="2023-02-01T00:00:00Z"),
            doc("cicd", 9, run_id=9, name="build", conclusion="failure", actor="ci"),
            doc("pr_graphql", 1, number=1, title="JWT tokens", body="text", author="bob"),
        ],
        schemas.DOCUMENT,
    )


def test_from_documents_to_answers(spark):
    tables = building.build(landed(spark), "o/r", "2024-01-01")
    chunks = tables["chunks"]
    assert {r.doc_type: r.chunks for r in building.report(chunks).collect()} == {"commit": 1, "diff": 1, "pr": 2, "issue": 2, "release": 1, "cicd": 1, "pr_graphql": 1}
    assert {r.relation for r in tables["edges"].collect()} == {"mentions", "merge_commit"}
    assert {r.canonical_name for r in tables["entities"].collect()} >= {"JWT", "Redis"}
    embed = embedding.hashing_embedder(32)
    vectors = embedding.embed_texts(chunks, embed, dim=32)
    tables["vectors"] = embedding.dual_vectors(vectors, dim=32)
    questions = asked(spark, "Why were JWT tokens added?", "x", "What about sessions?")
    out = answering.answer(tables, questions, embedder=embed, dim=32, writer=lambda p: p.str.len().astype(str))
    got = {r.query_id: r for r in out["answers"].collect()}
    assert set(got) == {0, 2} and int(got[0].answer) > 100
    assert {"commit:s1", "pr:1", "issue:7"} <= set(got[0].evidence) and got[0].used_tokens <= 3000
    assert out["evidence"].filter("query_id = 0 AND length(snippet) > 0").count() >= 3
    for bad in ({"mode": "x"}, {"top_k": 0}, {"limit": 101}):
        with pytest.raises(ValueError):
            answering.answer(tables, questions, **bad)
    memo = answering.answer(tables, questions, mode="memo", writer=lambda p: p.map(lambda _: '{"decision": "d", "context": "c", "rationale": "r"}'))
    assert memo["answers"].head().memo.decision == "d"


def test_chunk_files(spark, tmp_path):
    chunks = building.build(landed(spark), "o/r", "2024-01-01")["chunks"]
    sinks.write_chunk_file(chunks, str(tmp_path / "chunks"))
    again = landing.read_chunks(spark, str(tmp_path / "chunks"))
    assert {r.chunk_id for r in again.collect()} == {r.chunk_id for r in chunks.collect()}
    assert set(again.columns) == set(chunks.columns)
    nodes = {r.graph_node_id: len(r.chunk_ids) for r in landing.chunks_by_node(chunks, F.col("chunk_index")).collect()}
    assert nodes["commit_s1"] == 2


def test_reports(spark):
    commits = spark.createDataFrame([("1", "a", ["x", "y"]), ("2", "b", ["x", "y", "z"]), ("3", "a", ["x"])], "sha string, author string, file_paths array<string>").withColumn("timestamp", F.lit("2023-05-01").cast("timestamp"))
    assert {(r.a, r.b, r.commits) for r in reports.co_changes(commits).collect()} == {("x", "y", 2), ("x", "z", 1), ("y", "z", 1)}
    assert {(r.path, r.author, r.month, r.commits) for r in reports.ownership(commits).collect()} >= {("x", "a", "2023-05", 2)}
