"""Parsers and chunkers on small records."""

import json
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from annalist import schemas
from annalist.operators import chunking, parsing

DIFF = """--- a/lib/login.py
+++ b/lib/login.py
@@ -20,5 +20,7 @@ class Login:
     found = users.find(name)
     if found is None:
         return None
+    if found.locked:
+        return None
     return found
"""
AS_OF = "2024-01-01"


def hunks(spark, text):
    rows = spark.createDataFrame([("k", text)], "key string, diff string")
    folded = rows.select(parsing.parse_diff(F.col("diff")).alias("h")).head().h
    wide = parsing.diff_hunks(rows, "key", "diff").orderBy("hunk_index").drop("key", "hunk_index").collect()
    assert [tuple(h) for h in folded] == [tuple(w) for w in wide]
    return folded


def test_diff(spark):
    (h,) = hunks(spark, DIFF)
    assert (h.file_path, h.old_path, h.old_start, h.old_count, h.new_count) == ("lib/login.py", "a/lib/login.py", 20, 5, 7)
    assert len(h.lines) == 6 and "    if found.locked:" in [x[1:] for x in h.lines if x[0] == "+"]
    assert hunks(spark, "") == [] and hunks(spark, "  \n ") == [] and hunks(spark, "no diff") == []


def test_diff_without_headers_and_with_several(spark):
    text = "@@ -1 +2 @@\n-a\n+b\n@@ -5,2 +6,0 @@ x\n c\n--- a/q\n+++ b/b/q\n lost\n@@ -1 +1 @@\n\\ no newline\n+z\n"
    got = hunks(spark, text)
    assert [h.file_path for h in got] == ["", "", "b/q"]
    assert [h.lines for h in got] == [["-a", "+b"], [" c"], ["+z"]]
    assert (got[0].old_count, got[1].new_count) == (1, 0)


def test_code(spark):
    rows = spark.createDataFrame(
        [("test.py", "def hello():\n    pass\n\nclass MyClass:\n    async def method(self):\n        pass\n"), ("a/B.TS", "export async function f (x) {}\nconst g = async (y) => 1\n"), ("x.py", ""), ("y.md", "def no():")],
        "file_path string, source string",
    )
    got = parsing.code_entities(rows).orderBy("file_path", "entity_order").collect()
    assert [(r.file_path, r.entity_type, r.name, r.start_line) for r in got] == [
        ("a/B.TS", "function", "f", 1), ("a/B.TS", "function", "g", 2), ("test.py", "function", "hello", 1),
        ("test.py", "function", "method", 5), ("test.py", "class", "MyClass", 4),
    ]


def records(spark, kind, *rows):
    return parsing.payloads(spark.createDataFrame([(kind, "x", json.dumps(r)) for r in rows], schemas.DOCUMENT), kind)


def commit(spark, **changes):
    row = {
        "sha": "abc1234567", "authored_at": "2023-03-05T10:00:00+00:00", "author_email": "d@x", "author_name": "Dora",
        "message": "Lock users out\n\nCloses the JWT hole.", "file_paths": ["lib/login.py"], "diff_text": DIFF,
        "stats": {"deletions": 0, "insertions": 2, "files": 1},
    }
    return parsing.parse_commits(records(spark, "commit", row | changes), AS_OF)


def test_commit(spark):
    c = commit(spark).head()
    assert c.message_subject == "Lock users out" and "JWT" in c.message_body and len(c.hunks) == 1
    assert commit(spark, authored_at="").head().timestamp == datetime(2024, 1, 1)
    (k,) = chunking.commit_chunks(commit(spark), "r", AS_OF).collect()
    assert k.text == (
        "Lock users out\n\nCloses the JWT hole.\n\nFiles changed: lib/login.py\n\nStats: +2 -0 in 1 file(s)"
    )
    assert (k.doc_type, k.graph_node_id, k.chunk_index, k.total_chunks, k.module_tags) == ("commit", "commit_abc1234567", 0, 1, ["lib"])
    again = chunking.commit_chunks(commit(spark), "r", AS_OF).head()
    assert again.chunk_id == k.chunk_id


def test_diff_chunks(spark):
    (k,) = chunking.diff_chunks(commit(spark), "r", AS_OF).collect()
    assert k.text.startswith("File: lib/login.py | Commit: abc12345 | Lock users out\n@@ -20,5 +20,7 @@")
    assert (k.doc_type, k.graph_node_id, k.file_paths) == ("diff", "commit_abc1234567", ["lib/login.py"])
    long = DIFF + "".join(f"+line {i} {'x' * 60}\n context {i}\n" for i in range(120))
    got = chunking.diff_chunks(commit(spark, diff_text=long), "r", AS_OF).orderBy("chunk_index").collect()
    assert len(got) > 2 and [k.chunk_index for k in got] == list(range(len(got))) and {k.total_chunks for k in got} == {len(got)}
    assert chunking.diff_chunks(commit(spark, diff_text=""), "r", AS_OF).count() == 0


def packed(lines, prefix, most):
    est = lambda t: len(t) // 4
    budget = most - est(prefix) if most - est(prefix) > 0 else most
    out, held, tokens = [], [], 0
    for x in lines:
        if tokens + est(x) > budget and held:
            out.append(prefix + "\n".join(held))
            held = [y for y in held[-3:] if y.startswith(" ")]
            tokens = sum(map(est, held))
        held.append(x)
        tokens += est(x)
    return [*out, prefix + "\n".join(held)] if held else out or [prefix]


@pytest.mark.parametrize("n,most", [(0, 40), (1, 40), (60, 40), (60, 3), (200, 100)])
def test_pack_lines(spark, n, most):
    lines = [("+- "[i % 3]) + "y" * (i * 7 % 50) for i in range(n)]
    row = spark.createDataFrame([(lines, "prefix @@\n")], "lines array<string>, p string")
    assert row.select(chunking.pack_lines(F.col("lines"), F.col("p"), most).alias("x")).head().x == packed(lines, "prefix @@\n", most)


def test_pull_request(spark):
    row = {"number": 42, "title": "Use JWT (#17)", "state": "closed", "body": "Closes #17 by tokens.", "review_comments": ["LGTM", " ", "ok\n"], "author": "bob", "labels": ["auth"], "created_at": "2023-02-03T04:05:06"}
    prs = parsing.parse_prs(records(spark, "pr", row))
    assert prs.head().linked_issue_numbers == [17]
    got = chunking.pr_chunks(prs, "r", AS_OF).orderBy("chunk_index").collect()
    assert got[0].text == "[PR #42] Use JWT (#17)\nAuthor: bob | State: closed | Labels: auth\n\nCloses #17 by tokens."
    assert [k.text for k in got[1:]] == ["[PR #42 review comment #1]\nLGTM", "[PR #42 review comment #3]\nok"]
    assert got[1].entity_tags == ["review_comment", "auth"] and got[0].entity_tags == ["auth"]
    body = "intro\n# One\n" + "a" * 3000 + "\n## Two\n" + "b" * 9000 + "\n### \n"
    got = chunking.pr_chunks(parsing.parse_prs(records(spark, "pr", row | {"body": body, "review_comments": []})), "r", AS_OF).orderBy("chunk_index").collect()
    head = "[PR #42] Use JWT (#17)\nAuthor: bob | State: closed | Labels: auth\n\n"
    assert [k.text for k in got[:2]] == [head + "intro", head + "# One\n" + "a" * 3000]
    assert all(k.text.startswith(head) for k in got[:3]) and max(len(k.text) for k in got) <= 4000


def test_issue(spark):
    row = {"number": 17, "title": "JWT bug", "body": "It expires.", "labels": ["bug"], "author": "finn", "created_at": "2023-03-04T05:06:07Z", "state": "open", "comments": [f"Note {n}" for n in range(10)]}
    rows = records(spark, "issue", row, row | {"number": 18, "pull_request": "yes"}, row | {"number": 19, "comments": ["a", "  ", "b", "c"], "labels": []})
    got = chunking.issue_chunks(parsing.parse_issues(rows), "r", AS_OF).orderBy("doc_id", "chunk_index").collect()
    first = [k for k in got if k.doc_id == "17"]
    assert len(first) == 6 and not [k for k in got if k.doc_id == "18"]
    assert first[0].text == "[Issue #17] JWT bug\nAuthor: finn | State: open | Labels: bug\n\nIt expires."
    assert first[1].text == "[Issue #17 comments 1–3]\n\nNote 0\n\n---\n\nNote 1\n\n---\n\nNote 2"
    assert first[5].text == "[Issue #17 comments 9–10]\n\nNote 8\n\n---\n\nNote 9"
    other = [k.text for k in got if k.doc_id == "19"]
    assert other[0].splitlines()[1].endswith("Labels: none") and len(other) == 3 and other[2] == "[Issue #19 comments 3–3]\n\nc"


def test_release(spark):
    text = "Log\n\n## v3.1.0 — 2023-06-01\nMore\n\n# 3.0 (unreleased)\nLess\n\n## v2.8.5 — 2022/04/01\n" + "x" * 3000
    rows = records(spark, "release", {"tag": "all", "body": text}, {"tag_name": "v0.9.1", "body": "First one.", "timestamp": "", "published_at": "2020-01-01T00:00:00Z"})
    parsed = parsing.parse_releases(rows)
    assert [(r.tag, str(r.timestamp)) for r in parsed.collect()] == [("all", "None"), ("v0.9.1", "2020-01-01 00:00:00")]
    got = chunking.release_chunks(parsed, "r", AS_OF).collect()
    assert [k.text for k in got if k.doc_id == "v0.9.1"] == ["[Release v0.9.1]\n\nFirst one."]
    assert [k.doc_id for k in got if k.doc_id != "v0.9.1"] == ["v3.1.0", "3.0", "v2.8.5", "v2.8.5"]
    assert got[0].text == "[Release v3.1.0]\n## v3.1.0 — 2023-06-01\n\nMore" and got[0].timestamp == datetime(2023, 6, 1)


def test_logs(spark):
    runs = parsing.parse_ci_runs(records(spark, "cicd", {"run_id": 5, "name": "build", "status": "completed", "actor": "dan", "created_at": "2023-01-01T00:00:00Z"}))
    (k,) = chunking.log_chunks(runs, "cicd", "r", AS_OF).collect()
    assert k.text == "[cicd] build\n\nRun: build\nStatus: completed\nConclusion: None\nEvent: \nBranch: \nActor: dan\nURL:"
    assert (k.graph_node_id, k.author) == ("cicd_5", "dan")
    prs = parsing.parse_graphql_prs(records(spark, "pr_graphql", {"number": 9, "title": "T", "body": "b " * 3000, "author": "eve"}))
    got = chunking.log_chunks(prs, "pr_graphql", "r", AS_OF).collect()
    assert len(got) == 3 and got[0].graph_node_id == "pr_graphql_9" and got[0].total_chunks == 3 and got[0].author == "eve"


def test_languages(spark):
    row = spark.createDataFrame([("a/b.py",), ("x.TSX",), ("noext",), ("a.b/c",)], "p string")
    assert [r[0] for r in row.select(parsing.language(F.col("p"))).collect()] == ["python", "tsx", "unknown", "unknown"]
