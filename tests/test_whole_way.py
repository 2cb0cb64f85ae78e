"""Connector pages, alike names, retries and caches, evaluation runs and entry points."""

import json
import random
import threading
from http.server import BaseHTTPRequestHandler, HTTPServer
from urllib.parse import parse_qs, urlparse

import pandas as pd
import pytest
from pyspark.sql import functions as F

from annalist import __main__ as entry
from annalist import schemas
from annalist.functions import text as X
from annalist.functions.fuzzy import token_sort_ratio
from annalist.operators import context, embedding, entities, parsing, search
from annalist.plans import build as building
from annalist.plans import evaluate, reports
from annalist.sources import hosting, sinks
from tests.test_search_and_answer import landed


@pytest.fixture
def service():
    """A hosting service with 23 issues (one of 7 comments), pages of any size, and 5 merged pull requests."""

    class Handler(BaseHTTPRequestHandler):
        def reply(self, body):
            data = json.dumps(body).encode()
            self.send_response(200)
            self.send_header("Content-Length", str(len(data)))
            self.end_headers()
            self.wfile.write(data)

        def do_GET(self):
            url = urlparse(self.path)
            asked = {k: int(v[0]) for k, v in parse_qs(url.query).items() if v[0].isdigit()}
            lo = (asked["page"] - 1) * asked["per_page"]
            if url.path.endswith("/comments"):
                rows = [{"body": f"c{i}"} for i in range(7)]
            elif url.path.endswith("/runs"):
                rows = [{"id": i, "name": "build"} for i in range(8)]
                return self.reply({"workflow_runs": rows[lo : lo + asked["per_page"]]})
            else:
                rows = [{"number": i, "title": f"t{i}", "comments": int(i == 4)} | ({"pull_request": {"url": "x"}} if i == 9 else {}) for i in range(23)]
            self.reply(rows[lo : lo + asked["per_page"]])

        def do_POST(self):
            given = json.loads(self.rfile.read(int(self.headers["Content-Length"])))["variables"]
            lo = int(given["after"] or 0)
            nodes = [{"number": i, "author": None, "closingIssuesReferences": {"nodes": [{"number": k, "title": "n"} for k in range(i)]}} for i in range(7)]
            hi = lo + given["size"]
            self.reply({"data": {"repository": {"pullRequests": {"pageInfo": {"hasNextPage": hi < 7, "endCursor": str(hi)}, "nodes": nodes[lo:hi]}}}})

        def log_message(self, *args):
            pass

    server = HTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{server.server_port}"
    server.shutdown()


def test_hosting_reads_to_the_last_page(spark, service):
    hosting.register(spark)
    read = lambda kind, **o: spark.read.format("hosted_project").options(repo="o/r", kind=kind, api=service, per_page=3, readers=2, **o).load().collect()
    issues = {r.number: r for r in read("issue")}
    assert set(issues) == set(range(23)) - {9} and issues[4].comments == [f"c{i}" for i in range(7)]
    assert {r.run_id for r in read("cicd")} == set(range(8))
    merged = {r.number: r for r in read("pr_graphql")}
    assert set(merged) == set(range(7)) and merged[6].closing_issues == [f"#{k}: n" for k in range(5)] and merged[0].author == ""


def names(rng):
    base = ["auth service", "billing", "user registry", "log", "ab", "a", "data base", "cache layer", "queue worker"]
    out = {"", "aaaa aaaa", "axb", "ba"}
    for _ in range(140):
        name = list(rng.choice(base))
        for _ in range(rng.randrange(4)):
            at = rng.randrange(len(name) + 1)
            name[at : at + rng.randrange(2)] = rng.choice(["", "s", "x", " ", "A"])
        out.add("".join(name))
    return sorted(out)


@pytest.mark.parametrize("cutoff", [60.0, 85.0])
def test_fuzzy_pairs_equal_brute_force(spark, cutoff):
    some = names(random.Random(int(cutoff)))
    df = spark.createDataFrame([(n,) for n in [*some, None]], "name string")
    got = {(r.a, r.b): r.score for r in entities.fuzzy_pairs(df, df, cutoff).collect()}
    want = {(a, b): token_sort_ratio(a, b) for a in some for b in some if a != b and a.strip() and b.strip() and token_sort_ratio(a, b) >= cutoff}
    assert got == pytest.approx(want)


def test_resolve_fuzzy_equals_a_fold(spark):
    rng = random.Random(4)
    some = [n for n in names(rng) if n.strip()]
    rng.shuffle(some)
    rows = [(n, i // 3) for i, n in enumerate(some)]
    known, want = {}, {}
    for _, surface in sorted((seq, n) for n, seq in rows):
        low = surface.lower()
        if low not in known:
            best = max(((token_sort_ratio(low, k), -i, c) for i, (k, c) in enumerate(known.items())), default=(0, 0, ""))
            known[low] = best[2] if best[0] >= 85 else surface
        want[surface] = known[low]
    got = {r.surface: r.canonical_name for r in entities.resolve_fuzzy(spark.createDataFrame(rows, "surface string, seq int")).collect()}
    assert got == want


def test_registry_order_is_that_of_batches(spark):
    found = lambda *names: spark.createDataFrame([("d", "TECH", n.lower(), n, 1, i) for i, n in enumerate(names)], "doc_id string, label string, mention string, surface string, turn int, position int")
    first = entities.register(entities.resolve_exact(found("Redis", "Rust", "Ruby")), 1)
    second = entities.register(entities.resolve_exact(found("Ruby"), first), 2)
    merged = entities.merge_registry(first, second)
    terms = spark.createDataFrame([("r",)], "term string")
    got = sorted((r["rank"], r.canonical_name) for r in entities.prefix_search(merged, terms).collect())
    assert [name for _, name in got] == ["Redis", "Rust", "Ruby"]


def test_co_changes_have_no_limit(spark):
    rows = spark.createDataFrame([("s", [f"p{i:03}" for i in range(120)]), ("t", ["p000", "p001"])], "sha string, file_paths array<string>")
    got = {(r.a, r.b): r.commits for r in reports.co_changes(rows).collect()}
    assert len(got) == 120 * 119 // 2 and got["p000", "p001"] == 2
    assert reports.co_changes(rows, 50).count() == 1


def test_long_lines_keep_their_end(spark):
    line = "+" + "x" * (1 << 20) + "END"
    row = spark.createDataFrame([([line],)], "l array<string>").select(parsing.added_lines(F.col("l"))[0].alias("a"))
    assert row.select(F.length("a"), F.substring("a", -3, 3)).head() == ((1 << 20) + 3, "END")


def test_syntax_entities(spark):
    source = '@deco\nclass A(B):\n    def f(self):\n        def g():\n            pass\n    import os, sys\n\nasync def h():\n    return 1\nfrom x import (\n    y,\n)\n'
    rows = spark.createDataFrame([("a.py", source), ("b.py", "def broken(:"), ("c.js", "function f() {}"), ("d.py", None), ("e.py", "")], "file_path string, source string")
    got = {(r.entity_type, r.name, r.start_line, r.end_line, r.parent_class) for r in parsing.syntax_entities(rows).collect()}
    assert got == {
        ("class", "A", 2, 6, None), ("method", "f", 3, 5, "A"), ("method", "g", 4, 5, "A"), ("import", "import os, sys", 6, 6, None),
        ("function", "h", 8, 9, None), ("import", "from x import (", 10, 10, None),
    }


def test_retries_and_fallback():
    calls = []

    def writer(prompts):
        calls.append(list(prompts))
        if len(prompts) > 1:
            raise ValueError("batch too large")
        if prompts.iloc[0] == "busy" and sum(c == ["busy"] for c in calls) < 3:
            raise RuntimeError("429 slow down")
        if prompts.iloc[0] == "bad":
            raise ValueError("no")
        return prompts.str.upper()

    ask = context.retrying(writer, lambda p: "fallback: " + p, wait=0.0)
    assert ask(pd.Series(["one", "busy", "bad"])).tolist() == ["ONE", "BUSY", "fallback: bad"]
    assert sum(c == ["busy"] for c in calls) == 3 and sum(c == ["bad"] for c in calls) == 1
    assert context.retrying(writer, wait=0.0)(pd.Series(["bad"])).tolist() == [""]


def test_scores_are_cached(spark):
    rows = spark.createDataFrame([(0, i, f"c{i}", "q", t) for i, t in enumerate(["bb", "a", "bb"])], "query_id int, rank int, chunk_id string, query string, text string")
    none = spark.createDataFrame([], "score_key string, score double")
    length = lambda q, t: t.str.len()
    whole, fresh = context.cached_scores(rows, none, length)
    assert fresh.count() == 2 and {r.chunk_id: r.score for r in whole.collect()} == {"c0": 2, "c1": 1, "c2": 2}
    assert context.cached_scores(rows, fresh, length)[1].count() == 0


def test_fulltext_of_one_type(spark):
    docs = spark.createDataFrame([("c1", "pr", "redis cache"), ("c2", "issue", "redis"), ("c3", "pr", "other")], "chunk_id string, doc_type string, text string")
    words = X.search_tokens(F.col("text"))
    terms = search.query_terms(spark.createDataFrame([(0, "redis")], "query_id int, query string"), X.search_tokens(F.col("query")))
    post = search.postings(docs, words, keep=("doc_type",))
    every = {r.chunk_id: r.score for r in search.fulltext(post, search.corpus_stats(docs, words), terms).collect()}
    only = {r.chunk_id: r.score for r in search.fulltext(post, search.corpus_stats(docs, words), terms, doc_type="pr").collect()}
    assert set(every) == {"c1", "c2"} and only == {"c1": every["c1"]}


def test_evaluation_run(spark):
    tables = {k: sinks.written(v, k) for k, v in building.build(landed(spark), "o/r", "2024-01-01").items()}
    pairs = spark.createDataFrame(
        [("Why JWT tokens?", "x", "", "c1", "standard"), ("zz", "Unknown", "", "c2", "temporal"), ("Sessions and Redis?", "y", "", "c3", "standard")], schemas.QA_PAIR
    )
    embed = embedding.hashing_embedder(16)
    tables["vectors"] = sinks.written(embedding.dual_vectors(embedding.embed_texts(tables["chunks"], embed, dim=16), dim=16), "vectors")
    found = evaluate.run(tables, pairs, embedder=embed, dim=16, writer=lambda p: pd.Series(["In 2023 JWT"] * len(p)))
    got = {r.query_id: r for r in found["results"].collect()}
    assert set(got) == {"c1:standard", "c2:temporal", "c3:standard"}
    assert got["c1:standard"].answer == "In 2023 JWT" and len(got["c1:standard"].doc_types) == len(got["c1:standard"].entity_tags) > 1
    assert got["c2:temporal"].answer == "" and got["c2:temporal"].context == ""  # too short a question finds nothing
    metrics = found["metrics"].head()
    assert metrics.temporal_accuracy == 1.0 and metrics.multihop_coverage == pytest.approx(2 / 3)
    assert evaluate.run(tables, pairs, 1, embedder=embed, dim=16)["results"].count() == 1


def test_entry_points(spark, tmp_path, capsys):
    for row in landed(spark).collect():
        folder = tmp_path / "landed" / row.doc_type
        folder.mkdir(parents=True, exist_ok=True)
        (folder / f"{row.doc_id}.json").write_text(row.payload + "\n")
    tables = str(tmp_path / "tables")

    def run(*args):
        assert entry.main(["--dim", "16", *args]) == 0
        return json.loads(capsys.readouterr().out)

    built = run("ingest", str(tmp_path / "landed"), tables, "--repo", "o/r", "--as-of", "2024-01-01")
    assert built["documents"] == 6 and built["chunks"] == 9 and built["status"] == "ok"
    assert run("status", tables)["vectors"] == 9
    assert run("status", str(tmp_path / "none"))["status"] == "incomplete"
    (answer,) = run("answer", tables, "Why were JWT tokens added?", "--doc-type", "pr")
    assert "pr:1" in answer["evidence"]
    assert run("build-dataset", tables, str(tmp_path / "qa"), "--limit", "3")["pairs"] == 10
    assert run("evaluate", tables, str(tmp_path / "qa"), "--limit", "4")["pairs"] == 4
