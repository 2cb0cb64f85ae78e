"""Parsed records to chunks, one row in and several out; every list is built inside the row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from annalist.functions import ids
from annalist.functions import text as X
from annalist.operators.parsing import changelog_sections

MAX_TOKENS = {"commit": 256, "diff": 800, "pr": 1000, "issue": 512, "release": 600, "log": 600}
OVERLAP = 50
NO_STRINGS = "array<string>"


def max_chars(kind: str) -> int:
    return MAX_TOKENS[kind] * X.TOKEN_CHARS


def _empty() -> Column:
    return F.array().cast(NO_STRINGS)


def _labels(labels: Column) -> Column:
    return F.when(F.size(labels) > 0, F.array_join(labels, ", ")).otherwise(F.lit("none"))


def finish(rows: DataFrame, repo: str, as_of: str) -> DataFrame:
    """Rows with ``pieces`` (array of text and, where they differ by piece, tags, paths, doc_id, timestamp) to chunks.

    Numbers pieces from 0 within their row; module tags are the directories of the paths.
    """
    out = rows.select(
        "*", F.size("pieces").alias("total_chunks"), F.posexplode("pieces").alias("chunk_index", "piece")
    )
    doc_id = F.coalesce("piece.doc_id", "doc_id")
    paths = F.coalesce("piece.paths", F.col("file_paths"))
    folders = F.array_distinct(
        F.filter(F.transform(paths, lambda p: F.regexp_extract(p, r"\A(.*)/[^/]*\z", 1)), lambda d: d != "")
    )
    return out.select(
        F.col("piece.text").alias("text"),
        ids.chunk_key(F.col("doc_type"), doc_id, F.col("chunk_index"), F.col("piece.text")).alias("chunk_id"),
        "doc_type",
        doc_id.alias("doc_id"),
        F.coalesce("piece.timestamp", "timestamp", F.lit(as_of).cast("timestamp")).alias("timestamp"),
        "author",
        folders.alias("module_tags"),
        F.coalesce("piece.tags", _empty()).alias("entity_tags"),
        ids.node_key(F.coalesce("piece.node_type", "doc_type"), doc_id).alias("graph_node_id"),
        paths.alias("file_paths"),
        F.lit(repo).alias("repo"),
        "chunk_index",
        "total_chunks",
    )


def piece(
    text: Column,
    tags: Column | None = None,
    paths: Column | None = None,
    doc_id: Column | None = None,
    timestamp: Column | None = None,
    node_type: str | None = None,
) -> Column:
    nothing = F.lit(None)
    return F.struct(
        text.alias("text"),
        (nothing.cast(NO_STRINGS) if tags is None else tags).alias("tags"),
        (nothing.cast(NO_STRINGS) if paths is None else paths).alias("paths"),
        (nothing.cast("string") if doc_id is None else doc_id).alias("doc_id"),
        (nothing.cast("timestamp") if timestamp is None else timestamp).alias("timestamp"),
        F.lit(node_type).cast("string").alias("node_type"),
    )


def commit_text(kind: str = "commit") -> Column:
    """One text per commit: subject, body, first ten paths, totals; empty parts leave no gap."""

    def part(value: Column) -> Column:
        return F.when(value != "", value)

    paths = F.slice("file_paths", 1, 10)
    files = F.when(F.size("file_paths") > 0, F.concat(F.lit("Files changed: "), F.array_join(paths, ", ")))
    totals = F.when(
        F.col("stats").isNotNull(),
        F.format_string(
            "Stats: +%d -%d in %d file(s)",
            *[F.coalesce(f"stats.{c}", F.lit(0)) for c in ("insertions", "deletions", "files")],
        ),
    )
    text = F.concat_ws("\n\n", part(F.col("message_subject")), part(F.col("message_body")), files, totals)
    return F.substring(text, 1, max_chars(kind))


def commit_chunks(commits: DataFrame, repo: str = "", as_of: str = "1970-01-01") -> DataFrame:
    rows = commits.select(
        F.lit("commit").alias("doc_type"),
        F.col("sha").alias("doc_id"),
        "timestamp",
        "author",
        "file_paths",
        F.array(piece(commit_text())).alias("pieces"),
    )
    return finish(rows, repo, as_of)


def pack_lines(lines: Column, prefix: Column, most: int = MAX_TOKENS["diff"], carried: int = 3) -> Column:
    """Texts of ``prefix`` and as many lines as fit the token budget.

    What follows a full piece starts with those of its last ``carried`` lines
    that begin with a space.  No line is cut; no lines give the prefix alone.
    """
    room = F.lit(most) - X.estimate_tokens(prefix)
    budget = F.when(room > 0, room).otherwise(F.lit(most))
    start = F.struct(_empty().alias("held"), F.lit(0).alias("tokens"), F.array().cast("array<array<string>>").alias("done"))

    def total(held: Column) -> Column:
        return F.aggregate(held, F.lit(0), lambda n, x: n + X.estimate_tokens(x))

    def step(state: Column, line: Column) -> Column:
        cost = X.estimate_tokens(line)
        full = (state["tokens"] + cost > budget) & (F.size(state["held"]) > 0)
        tail = F.slice(state["held"], F.greatest(F.size(state["held"]) - (carried - 1), F.lit(1)), carried)
        kept = F.filter(tail, lambda x: x.startswith(" "))
        return F.struct(
            F.when(full, F.concat(kept, F.array(line))).otherwise(F.concat(state["held"], F.array(line))).alias("held"),
            (F.when(full, total(kept)).otherwise(state["tokens"]) + cost).alias("tokens"),
            F.when(full, F.concat(state["done"], F.array(state["held"]))).otherwise(state["done"]).alias("done"),
        )

    def end(state: Column) -> Column:
        groups = F.when(F.size(state["held"]) > 0, F.concat(state["done"], F.array(state["held"]))).otherwise(state["done"])
        texts = F.transform(groups, lambda g: F.concat(prefix, F.array_join(g, "\n")))
        return F.when(F.size(texts) > 0, texts).otherwise(F.array(prefix))

    return F.aggregate(lines, start, step, end)


def diff_chunks(commits: DataFrame, repo: str = "", as_of: str = "1970-01-01") -> DataFrame:
    """Chunks of all hunks of a commit, numbered through."""

    def of_hunk(h: Column) -> Column:
        prefix = F.concat(
            F.lit("File: "), h["file_path"], F.lit(" | Commit: "), F.substring("sha", 1, 8), F.lit(" | "),
            F.col("message_subject"), F.lit("\n"), h["header"], F.lit("\n"),
        )
        texts = pack_lines(h["lines"], prefix)
        return F.transform(texts, lambda t: piece(t, paths=F.array(h["file_path"]), node_type="commit"))

    rows = commits.filter(F.size("hunks") > 0).select(
        F.lit("diff").alias("doc_type"),
        F.col("sha").alias("doc_id"),
        "timestamp",
        "author",
        "file_paths",
        F.flatten(F.transform("hunks", of_hunk)).alias("pieces"),
    )
    return finish(rows, repo, as_of)


def heading_pieces(header: Column, body: Column, kind: str = "pr") -> Column:
    """The whole text if it fits; else a piece per Markdown section, the header on each, long ones split by characters."""
    most = MAX_TOKENS[kind]
    whole = F.concat(header, body)
    sections = F.filter(F.split(body, "(?m)(?=^#{1,3} )"), lambda s: ~X.is_blank(s))

    def cut(section: Column) -> Column:
        text = F.concat(header, X.strip(section))
        return F.when(X.estimate_tokens(text) > most, X.split_by_chars(text, max_chars(kind), OVERLAP)).otherwise(F.array(text))

    pieces = F.flatten(F.transform(sections, cut))
    pieces = F.when(F.size(pieces) > 0, pieces).otherwise(F.array(F.substring(whole, 1, max_chars(kind))))
    return F.when(X.estimate_tokens(whole) <= most, F.array(whole)).otherwise(pieces)


def pr_chunks(prs: DataFrame, repo: str = "", as_of: str = "1970-01-01") -> DataFrame:
    number = F.col("number").cast("string")
    header = F.concat(
        F.lit("[PR #"), number, F.lit("] "), F.col("title"), F.lit("\nAuthor: "), F.col("author"),
        F.lit(" | State: "), F.col("state"), F.lit(" | Labels: "), _labels(F.col("labels")), F.lit("\n\n"),
    )
    body = F.transform(heading_pieces(header, F.col("body_clean")), lambda t: piece(t, tags=F.col("labels")))
    tags = F.concat(F.array(F.lit("review_comment")), F.col("labels"))

    def comment(c: Column, i: Column) -> Column:
        text = F.concat(F.lit("[PR #"), number, F.lit(" review comment #"), (i + 1).cast("string"), F.lit("]\n"), X.strip(c))
        return F.when(~X.is_blank(c), piece(text, tags=tags))

    comments = F.filter(F.transform("review_comments", comment), lambda x: x.isNotNull())
    rows = prs.select(
        F.lit("pr").alias("doc_type"),
        number.alias("doc_id"),
        F.col("created_at").alias("timestamp"),
        "author",
        _empty().alias("file_paths"),
        F.concat(body, comments).alias("pieces"),
    )
    return finish(rows, repo, as_of)


def windows(items: Column, size: int = 3, overlap: int = 1) -> Column:
    """(start, items) of windows of ``size`` items, each starting ``size - overlap`` after the last."""
    step = max(size - overlap, 1)
    starts = F.sequence(F.lit(0), F.size(items) - 1, F.lit(step))
    made = F.transform(starts, lambda s: F.struct(s.alias("start"), F.slice(items, s + 1, F.lit(size)).alias("items")))
    return F.when(F.size(items) > 0, made).otherwise(F.array().cast("array<struct<start:int,items:array<string>>>"))


def issue_chunks(issues: DataFrame, repo: str = "", as_of: str = "1970-01-01", size: int = 3, overlap: int = 1) -> DataFrame:
    most = max_chars("issue")
    number = F.col("number").cast("string")
    head = F.concat(
        F.lit("[Issue #"), number, F.lit("] "), F.col("title"), F.lit("\nAuthor: "), F.col("author"),
        F.lit(" | State: "), F.col("state"), F.lit(" | Labels: "), _labels(F.col("labels")), F.lit("\n\n"),
    )

    def window(w: Column) -> Column:
        text = F.concat(
            F.lit("[Issue #"), number, F.lit(" comments "), (w["start"] + 1).cast("string"), F.lit("–"),
            (w["start"] + F.size(w["items"])).cast("string"), F.lit("]\n\n"), F.array_join(w["items"], "\n\n---\n\n"),
        )
        return piece(F.substring(text, 1, most), tags=F.col("labels"))

    told = F.filter("comments", lambda c: ~X.is_blank(c))
    rows = issues.select(
        F.lit("issue").alias("doc_type"),
        number.alias("doc_id"),
        F.col("created_at").alias("timestamp"),
        "author",
        _empty().alias("file_paths"),
        F.concat(
            F.array(piece(F.substring(F.concat(head, F.col("body_clean")), 1, most), tags=F.col("labels"))),
            F.transform(windows(told, size, overlap), window),
        ).alias("pieces"),
    )
    return finish(rows, repo, as_of)


def release_chunks(releases: DataFrame, repo: str = "", as_of: str = "1970-01-01") -> DataFrame:
    most = max_chars("release")
    alone = F.concat(F.lit("[Release "), F.col("tag"), F.lit("]\n\n"), F.col("body_clean"))

    def cut(text: Column) -> Column:
        return F.when(F.length(text) > most, X.split_by_chars(text, most, OVERLAP)).otherwise(F.array(text))

    def section(s: Column) -> Column:
        text = F.concat(F.lit("[Release "), s["version"], F.lit("]\n"), s["heading"], F.lit("\n\n"), s["body"])
        return F.transform(cut(text), lambda t: piece(t, doc_id=s["version"], timestamp=s["date"]))

    rows = releases.withColumn("sections", changelog_sections(F.col("body_clean"))).select(
        F.lit("release").alias("doc_type"),
        F.col("tag").alias("doc_id"),
        "timestamp",
        F.lit("").alias("author"),
        _empty().alias("file_paths"),
        F.when(F.size("sections") > 0, F.flatten(F.transform("sections", section)))
        .otherwise(F.transform(cut(alone), lambda t: piece(t)))
        .alias("pieces"),
    )
    return finish(rows, repo, as_of)


def log_pieces(doc_type: Column, title: Column, body: Column) -> Column:
    most = max_chars("log")
    head = X.strip(F.concat(F.lit("["), doc_type, F.lit("] "), title))
    text = X.strip(F.concat(head, F.lit("\n\n"), body))
    return F.when(F.length(text) > most, X.split_by_chars(text, most, OVERLAP)).otherwise(F.array(text))


def log_chunks(rows: DataFrame, doc_type: str, repo: str = "", as_of: str = "1970-01-01") -> DataFrame:
    """CI runs and pull requests of the GraphQL source; takes title or name, run_id or number, actor or author."""

    def first(*names: str) -> Column:
        have = [F.nullif(F.col(n).cast("string"), F.lit("")) for n in names if n in rows.columns]
        return F.coalesce(*have, F.lit(""))

    made = rows.select(
        F.lit(doc_type).alias("doc_type"),
        first("run_id", "number").alias("doc_id"),
        F.col("created_at").alias("timestamp"),
        first("actor", "author").alias("author"),
        _empty().alias("file_paths"),
        F.transform(log_pieces(F.lit(doc_type), first("title", "name"), F.coalesce("body_clean", F.lit(""))), lambda t: piece(t)).alias("pieces"),
    )
    return finish(made, repo, as_of)
