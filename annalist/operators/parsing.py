"""Raw records to parsed records, one row in and one out; diffs and sources to nested rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from annalist import schemas
from annalist.functions import text as X

HUNK_HEAD = r"^@@ -([0-9]+)(?:,([0-9]+))? [+]([0-9]+)(?:,([0-9]+))? @@"

_LANGUAGES = "c=.c .h; cpp=.cpp .hpp; go=.go; java=.java; javascript=.js .jsx; php=.php; python=.py; ruby=.rb; rust=.rs; tsx=.tsx; typescript=.ts"
EXTENSIONS = {end: name for name, ends in (x.split("=") for x in _LANGUAGES.split("; ")) for end in ends.split()}


def payloads(documents: DataFrame, doc_type: str) -> DataFrame:
    """Records of one type from (doc_type, doc_id, payload); the filter prunes partitions."""
    schema, _ = schemas.PAYLOADS[doc_type]
    return documents.filter(F.col("doc_type") == doc_type).select(F.from_json("payload", schema).alias("p")).select("p.*")


def _or_empty(name: str) -> Column:
    return F.coalesce(F.col(name), F.lit(""))


def _list(name: str, kind: str = "string") -> Column:
    return F.coalesce(F.col(name), F.array().cast(f"array<{kind}>"))


def parse_diff(diff: Column) -> Column:
    """Hunks of a unified diff, as an array.

    One fold over the lines carries the two paths and the hunks so far.  Lines
    before a hunk, and lines that are no context, addition or removal, are not kept.
    """
    hunk = schemas.HUNK
    none = F.lit(None).cast(hunk)
    start = F.struct(
        F.lit("").alias("old"), F.lit("").alias("new"), none.alias("open"), F.array().cast(f"array<{hunk}>").alias("done")
    )

    def closed(state: Column) -> Column:
        return F.when(state["open"].isNull(), state["done"]).otherwise(F.concat(state["done"], F.array(state["open"])))

    def number(line: Column, group: int) -> Column:
        found = F.regexp_extract(line, HUNK_HEAD, group)
        return F.when(found == "", F.lit(1)).otherwise(found.cast("int"))

    def step(state: Column, line: Column) -> Column:
        opened = F.struct(
            F.regexp_replace(state["new"], "^b/", "").alias("file_path"),
            state["old"].alias("old_path"),
            state["new"].alias("new_path"),
            number(line, 1).alias("old_start"),
            number(line, 2).alias("old_count"),
            number(line, 3).alias("new_start"),
            number(line, 4).alias("new_count"),
            line.alias("header"),
            F.array().cast("array<string>").alias("lines"),
        )
        grown = state["open"].withField("lines", F.concat(state["open"]["lines"], F.array(line)))
        path = X.strip(F.substring(line, F.lit(5), F.length(line)))
        old, new, head = line.startswith("--- "), line.startswith("+++ "), line.rlike(HUNK_HEAD)
        body = state["open"].isNotNull() & line.rlike("^[-+ ]")
        return F.struct(
            F.when(old, path).otherwise(state["old"]).alias("old"),
            F.when(~old & new, path).otherwise(state["new"]).alias("new"),
            F.when(old, none).when(new, state["open"]).when(head, opened).when(body, grown).otherwise(state["open"]).alias("open"),
            F.when(old | (~new & head), closed(state)).otherwise(state["done"]).alias("done"),
        )

    hunks = F.aggregate(X.lines(diff), start, step, closed)
    return F.when(X.is_blank(diff), F.array().cast(f"array<{hunk}>")).otherwise(hunks)


def diff_hunks(diffs: DataFrame, key: str, text: str) -> DataFrame:
    """(key, hunk number, fields) for every hunk, by windows over lines: for diffs too long for one fold.

    Work and state per line are constant, and sorting spills.
    """
    line = F.col("line")
    order = Window.partitionBy(key).orderBy("at")
    upto = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = diffs.select(key, F.posexplode(X.lines(F.col(text))).alias("at", "line"))
    old, new = line.startswith("--- "), ~line.startswith("--- ") & line.startswith("+++ ")
    head = ~old & ~new & line.rlike(HUNK_HEAD)
    marked = (
        rows.withColumn("head", head)
        .withColumn("old_path", F.coalesce(F.last(F.when(old, X.strip(F.substring(line, F.lit(5), F.length(line)))), True).over(upto), F.lit("")))
        .withColumn("new_path", F.coalesce(F.last(F.when(new, X.strip(F.substring(line, F.lit(5), F.length(line)))), True).over(upto), F.lit("")))
        .withColumn("hunk", F.count(F.when(F.col("head"), 1)).over(upto))
        # open from its head to the next file's first line
        .withColumn("alive", F.last(F.when(F.col("head"), True).when(old, False), True).over(upto))
        .withColumn("inside", F.col("alive") & ~F.col("head") & ~old & ~new & line.rlike("^[-+ ]"))
    )

    def number(group: int) -> Column:
        found = F.regexp_extract("header", HUNK_HEAD, group)
        return F.when(found == "", F.lit(1)).otherwise(found.cast("int"))

    grouped = (
        marked.filter(F.col("head") | F.col("inside"))
        .groupBy(key, "hunk")
        .agg(
            F.max(F.when(F.col("head"), line)).alias("header"),
            F.max(F.when(F.col("head"), F.col("old_path"))).alias("old_path"),
            F.max(F.when(F.col("head"), F.col("new_path"))).alias("new_path"),
            F.sort_array(F.collect_list(F.when(F.col("inside"), F.struct("at", "line")))).alias("body"),
        )
    )
    return grouped.select(
        key,
        (F.col("hunk") - 1).cast("int").alias("hunk_index"),
        F.regexp_replace("new_path", "^b/", "").alias("file_path"),
        "old_path",
        "new_path",
        number(1).alias("old_start"),
        number(2).alias("old_count"),
        number(3).alias("new_start"),
        number(4).alias("new_count"),
        "header",
        F.col("body.line").alias("lines"),
    )


def added_lines(lines: Column) -> Column:
    return F.transform(F.filter(lines, lambda x: x.startswith("+")), lambda x: F.substring(x, F.lit(2), F.length(x)))


def removed_lines(lines: Column) -> Column:
    return F.transform(F.filter(lines, lambda x: x.startswith("-")), lambda x: F.substring(x, F.lit(2), F.length(x)))


def hunk_text(header: Column, lines: Column) -> Column:
    return F.array_join(F.concat(F.array(header), lines), "\n")


def language(path: Column) -> Column:
    pairs = [F.lit(x) for item in EXTENSIONS.items() for x in item]
    return F.coalesce(F.element_at(F.create_map(*pairs), F.lower(F.regexp_extract(path, r"\.[^./]*$", 0))), F.lit("unknown"))


def code_entities(sources: DataFrame, path: str = "file_path", text: str = "source") -> DataFrame:
    """(entity_type, name, start_line, end_line, file_path, language, text) of the definitions found by pattern.

    Python: functions and classes; JavaScript and TypeScript: functions and
    arrow functions.  ``entity_order`` lists functions before classes, as found.
    """
    rules = [
        ("python", 0, "function", r"^[ ]*(?:async[ ])?def[ ](\w+)\s*[(]"),
        ("python", 1, "class", r"^[ ]*class[ ](\w+)(?:[(:\s]|$)"),
        ("script", 0, "function", r"^(?:(?:export|async)\s+){0,2}function\s+(\w+)\s*[(]"),
        ("script", 1, "function", r"^(?:export\s+)?(?:var|let|const)\s+(\w+)[ \t]*=[ \t]*(?:async)?[ \t]*[(]"),
    ]
    family = F.when(F.col("language") == "python", "python").when(
        F.col("language").isin("javascript", "typescript"), "script"
    )
    rows = (
        sources.select(F.col(path).alias("file_path"), language(F.col(path)).alias("language"), F.col(text).alias("source"))
        .withColumn("family", family)
        .filter("family IS NOT NULL")
        .select("file_path", "language", "family", F.posexplode(X.lines(F.col("source"))).alias("at", "line"))
    )
    found = F.array(
        *[
            F.struct(F.lit(kind).alias("entity_type"), F.lit(turn).alias("turn"), F.regexp_extract("line", rule, 1).alias("name"), F.lit(of).alias("of"))
            for of, turn, kind, rule in rules
        ]
    )
    return (
        rows.withColumn("e", F.explode(found))
        .filter((F.col("e.name") != "") & (F.col("e.of") == F.col("family")))
        .select(
            "e.entity_type",
            "e.name",
            (F.col("at") + 1).alias("start_line"),
            (F.col("at") + 1).alias("end_line"),
            "file_path",
            "language",
            F.col("line").alias("text"),
            (F.col("e.turn") * 1_000_000_000 + F.col("at")).alias("entity_order"),
        )
    )


def syntax_entities(sources: DataFrame, path: str = "file_path", text: str = "source") -> DataFrame:
    """(entity_type, name, start_line, end_line, file_path, language, text, parent_class) of Python sources, by their syntax tree.

    Functions, methods (functions in a class, however deep), classes and
    imports, with the lines they span; decorators are not counted in.  A source
    that does not parse gives nothing here: ``code_entities`` still finds its
    definitions by pattern.
    """
    import ast
    from collections.abc import Iterator

    import pandas as pd

    columns = ("entity_type", "name", "start_line", "end_line", "file_path", "language", "text", "parent_class")

    def entities_of(file_path: str, source: str) -> Iterator[tuple]:
        try:
            tree = ast.parse(source)
        except (SyntaxError, ValueError, RecursionError, MemoryError):
            return
        rows = source.splitlines()
        todo: list[tuple[ast.AST, str | None]] = [(tree, None)]
        while todo:
            node, parent = todo.pop()
            inside = parent
            span = (getattr(node, "lineno", 0), getattr(node, "end_lineno", 0))
            body = "\n".join(rows[max(span[0] - 1, 0) : span[1]])
            if isinstance(node, ast.FunctionDef | ast.AsyncFunctionDef):
                yield "method" if parent else "function", node.name, *span, file_path, "python", body, parent
            elif isinstance(node, ast.ClassDef):
                yield "class", node.name, *span, file_path, "python", body, None
                inside = node.name
            elif isinstance(node, ast.Import | ast.ImportFrom):
                yield "import", body.strip().split("\n")[0], span[0], span[0], file_path, "python", body.strip(), None
            todo += [(child, inside) for child in reversed(list(ast.iter_child_nodes(node)))]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = [e for p, s in zip(batch["file_path"], batch["source"], strict=True) if s for e in entities_of(p, s)]
            yield pd.DataFrame(found, columns=columns)

    rows = sources.select(F.col(path).alias("file_path"), F.col(text).alias("source")).filter(language(F.col("file_path")) == "python")
    return rows.mapInPandas(
        run,
        "entity_type string, name string, start_line int, end_line int, file_path string, language string, text string, parent_class string",
    )


def parse_commits(commits: DataFrame, as_of: str) -> DataFrame:
    """``as_of`` (ISO) stands in for a missing time, so that runs repeat."""
    return commits.select(
        _or_empty("sha").alias("sha"),
        _or_empty("author_name").alias("author"),
        _or_empty("author_email").alias("author_email"),
        F.coalesce(X.parse_time(F.col("authored_at")), F.lit(as_of).cast("timestamp")).alias("timestamp"),
        _or_empty("message").alias("message"),
        X.subject(_or_empty("message")).alias("message_subject"),
        X.message_body(_or_empty("message")).alias("message_body"),
        _list("file_paths").alias("file_paths"),
        parse_diff(_or_empty("diff_text")).alias("hunks"),
        "stats",
    )


def parse_prs(prs: DataFrame) -> DataFrame:
    return prs.select(
        F.coalesce("number", F.lit(0)).alias("number"),
        _or_empty("title").alias("title"),
        X.clean_markdown(F.col("body")).alias("body_clean"),
        _or_empty("state").alias("state"),
        _or_empty("author").alias("author"),
        X.parse_time(F.col("created_at")).alias("created_at"),
        X.parse_time(F.col("merged_at")).alias("merged_at"),
        _list("labels").alias("labels"),
        _list("review_comments").alias("review_comments"),
        X.references(F.col("title"), F.col("body")).alias("linked_issue_numbers"),
    )


def parse_issues(issues: DataFrame) -> DataFrame:
    """Rows that are pull requests are left out."""
    return issues.filter("pull_request IS NULL").select(
        F.coalesce("number", F.lit(0)).alias("number"),
        _or_empty("title").alias("title"),
        X.clean_markdown(F.col("body")).alias("body_clean"),
        _or_empty("state").alias("state"),
        _or_empty("author").alias("author"),
        X.parse_time(F.col("created_at")).alias("created_at"),
        X.parse_time(F.col("closed_at")).alias("closed_at"),
        _list("labels").alias("labels"),
        F.transform(_list("comments"), X.clean_markdown).alias("comments"),
    )


def parse_releases(releases: DataFrame) -> DataFrame:
    given = F.when(F.col("timestamp") != "", F.col("timestamp")).otherwise(F.col("published_at"))
    return releases.select(
        F.coalesce("tag", "tag_name", F.lit("")).alias("tag"),
        X.parse_time(given).alias("timestamp"),
        X.clean_markdown(F.col("body")).alias("body_clean"),
    )


def parse_ci_runs(runs: DataFrame) -> DataFrame:
    def line(label: str, value: Column) -> Column:
        return F.concat(F.lit(f"{label}: "), value)

    summary = F.concat_ws(
        "\n",
        line("Run", _or_empty("name")),
        line("Status", _or_empty("status")),
        line("Conclusion", F.coalesce("conclusion", F.lit("None"))),
        line("Event", _or_empty("event")),
        line("Branch", _or_empty("branch")),
        line("Actor", _or_empty("actor")),
        line("URL", _or_empty("html_url")),
    )
    return runs.select(
        F.coalesce("run_id", F.lit(0)).cast("bigint").alias("run_id"),
        *[_or_empty(c).alias(c) for c in ("name", "status", "html_url", "event", "branch", "actor")],
        "conclusion",
        X.parse_time(F.col("created_at")).alias("created_at"),
        X.parse_time(F.col("updated_at")).alias("updated_at"),
        summary.alias("body_clean"),
    )


def parse_graphql_prs(prs: DataFrame) -> DataFrame:
    return prs.select(
        F.coalesce("number", F.lit(0)).alias("number"),
        _or_empty("title").alias("title"),
        X.clean_markdown(F.col("body")).alias("body_clean"),
        _or_empty("author").alias("author"),
        X.parse_time(F.col("created_at")).alias("created_at"),
        X.parse_time(F.col("merged_at")).alias("merged_at"),
        _list("closing_issues").alias("closing_issues"),
    )


def changelog_sections(text: Column) -> Column:
    """Version sections (heading, body, version, date) of a changelog, as an array."""
    heading = r"^(#{1,3} .*(?:[0-9][.][0-9]|[uU][nN][rR][eE][lL][eE][aA][sS][eE][dD]).*)"
    parts = F.filter(F.split(text, f"(?m)(?={heading})"), lambda p: p.rlike(heading))

    def section(part: Column) -> Column:
        head = X.strip(F.regexp_extract(part, heading, 1))
        return F.struct(
            head.alias("heading"),
            X.strip(F.regexp_replace(part, heading, "")).alias("body"),
            X.heading_version(head).alias("version"),
            X.heading_date(head).alias("date"),
        )

    return F.transform(parts, section)
