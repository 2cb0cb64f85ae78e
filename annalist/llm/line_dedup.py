"""Line deduplication by a tree of log templates, in DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from annalist.llm.common import id_and_text, materialise

LEADING = 3
SIMILAR = 60  # in a hundred, so that of two free words both must agree
ANCHORS = 2
MIN_DOCS = 3
SALTS = 16  # a recurring template meets its lines in so many parts
WILD = "<*>"
_GAP = r"[\x20\x09-\x0D]"
_CHAR = r"[^\x20\x09-\x0D]"
_VARIABLE = rf"(?<!{_CHAR}){_CHAR}*(?:[0-9@]|://){_CHAR}*"


def _masked(line: Column) -> Column:
    """A line's tokens, one space between, those that vary by nature (digits, addresses) generalised."""
    spaced = F.regexp_replace(F.regexp_replace(line, f"{_GAP}+", " "), r"\A | \z", "")
    return F.regexp_replace(spaced, _VARIABLE, WILD)


def _leaf(line: Column, leading: int) -> Column:
    """Hash of the way down the tree: number of tokens, then the first ones."""
    lead = F.regexp_extract(line, rf"\A{_GAP}*((?:{_CHAR}+{_GAP}+){{0,{leading - 1}}}{_CHAR}+)", 1)
    return F.xxhash64(F.regexp_count(line, F.lit(f"{_CHAR}+")), _masked(lead))


def _of_lines(make) -> Column:
    """``make`` of the text's lines, which are split once, not for each use inside."""
    return F.element_at(F.transform(F.array(F.split("text", "\n")), make), 1)


def _belonging(variants: DataFrame, leading: int, similar: int, min_docs: int) -> DataFrame:
    """(leaf, variant, template) of the variants that belong to their leaf's template."""
    places = variants.select("leaf", "variant", "docs", F.posexplode("tokens").alias("position", "token")).filter(
        (F.col("position") >= leading) & (F.col("token") != WILD)
    )
    words = places.select("leaf", "variant", "docs", "position", F.xxhash64("leaf", "position", "token").alias("word"))
    # written, so that the join's sides come by shuffles of their own and a hot word can be split
    shared = materialise(
        words.groupBy("word")
        .agg(F.sum("docs").alias("support"), F.count(F.lit(1)).alias("forms"))
        .filter((F.col("support") >= min_docs) & (F.col("forms") > 1))
        .drop("forms"),
        "shared_words",
    )
    best = F.sort_array(F.collect_list(F.struct("support", (-F.col("position")).alias("place"), "word")), asc=False)
    anchored = materialise(
        words.join(shared, "word")
        .groupBy("leaf", "variant")
        .agg(F.slice(best, 1, ANCHORS).alias("best"))
        .select("leaf", "variant", F.xxhash64(F.col("best.word")).alias("template")),
        "anchored",
    )
    placed = variants.join(anchored, ["leaf", "variant"])
    templates = (
        placed.select("template", "docs", F.posexplode("tokens").alias("position", "token"))
        .filter(F.col("position") >= leading)
        .groupBy("template", "position", "token")
        .agg(F.sum("docs").alias("docs"))
        .groupBy("template", "position")
        .agg(F.max(F.struct("docs", "token")).alias("top"), F.sum("docs").alias("all"))
        .groupBy("template")
        .agg(
            F.sort_array(
                F.collect_list(F.struct("position", F.when(F.col("top.docs") * 2 >= F.col("all"), F.col("top.token")).alias("token")))
            ).alias("line")
        )
    )
    free = F.slice("tokens", leading + 1, F.greatest(F.size("tokens") - leading, F.lit(0)))
    agreeing = F.size(F.filter(F.zip_with(free, F.col("line.token"), lambda a, b: (a != WILD) & a.eqNullSafe(b)), lambda x: x))
    words_of = F.size(F.filter(free, lambda x: x != WILD))
    return (
        placed.join(materialise(templates, "templates"), "template")
        .filter(agreeing * 100 >= words_of * similar)
        .select("leaf", "variant", "template")
    )


def line_dedup(
    docs: DataFrame,
    leading: int = LEADING,
    similar: int = SIMILAR,
    min_docs: int = MIN_DOCS,
    keep_first: bool = True,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """One row per input row: doc_id, n_lines, n_dropped, dropped (line numbers from 0), kept_text.

    Tokens with a digit, an @ or a :// are generalised first; the others are
    words.  The tree has a fixed depth: a line goes down by its number of tokens,
    by its ``leading`` first tokens, and then by two of its further words, those
    that most documents have at the same place of the same branch (at least
    ``min_docs``, in two different lines; ties: the earlier place; one word, if
    no second is shared).  So a branch holds as many templates as there are such
    pairs of words, whatever else it holds.  A leaf's template has a place's most
    frequent token if at least half of the leaf's lines (each counted once per
    document) have it there, and a wildcard elsewhere.  A line belongs to it if
    at least ``similar`` in a hundred of the line's words *after the leading
    tokens* stand in the template; generalised tokens and wildcards say nothing.
    Any other line is a template of its own, and so is a line whose further words
    no other line shares.  A template found in ``min_docs`` documents recurs: its
    lines are dropped, but for the first of the smallest document
    (``keep_first``), so that no passage vanishes altogether.  A line without any
    word has no template and stays.

    Only lines of branches that two documents share are looked at token by token;
    all others go by two numbers.  No leaf is gathered: its counts combine.

    Lines end at line feeds.  Blank lines and null texts have no template; a row
    with a null id is kept whole and counts for nothing; rows that repeat an id
    with one text share one fate, with two texts are told apart; an empty table
    gives no rows; other columns are ignored.
    """
    rows = id_and_text(docs, id_col, text_col).withColumn(
        "version", F.xxhash64("text")
    )
    known = rows.filter("doc_id IS NOT NULL AND text IS NOT NULL")
    lines = materialise(
        known.select("doc_id", "version", F.posexplode(F.split("text", "\n")).alias("at", "line"))
        .filter(F.col("line").rlike(_CHAR))
        .select("doc_id", "version", "at", _leaf(F.col("line"), leading).alias("leaf")),
        "lines",
    )
    # written, so that the join's sides come by shuffles of their own and a hot leaf can be split
    shared = materialise(
        lines.groupBy("leaf")
        .agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi"), F.count(F.lit(1)).alias("n"))
        .filter((F.col("lo") < F.col("hi")) & (F.col("n") >= min_docs))
        .select("leaf"),
        "leaves",
    )
    looked_at = (
        lines.join(shared, "leaf").groupBy("doc_id", "version").agg(F.collect_set(F.struct("at", "leaf")).alias("ats"))
    )

    def marked(lines: Column) -> Column:
        def one(x: Column) -> Column:
            return F.struct(x["at"].alias("at"), x["leaf"].alias("leaf"), _masked(F.get(lines, x["at"])).alias("masked"))

        return F.transform("ats", one)

    has_word = F.regexp_replace("masked", r"<\*>| ", "") != ""
    found = materialise(
        known.join(looked_at, ["doc_id", "version"])
        .select("doc_id", "version", F.inline(_of_lines(marked)))
        .filter(has_word)
        .withColumn("variant", F.xxhash64("masked")),
        "found_lines",
    )
    variants = materialise(
        found.select("leaf", "variant", "masked", "doc_id")
        .distinct()
        .groupBy("leaf", "variant", "masked")
        .agg(F.count(F.lit(1)).alias("docs"))
        .select("leaf", "variant", "docs", F.split("masked", " ").alias("tokens")),
        "variants",
    )
    named = variants.join(
        _belonging(variants, leading, similar, min_docs).withColumnRenamed("template", "leafs"), ["leaf", "variant"], "left"
    ).select("leaf", "variant", "docs", F.coalesce("leafs", "variant").alias("template"), F.col("leafs").isNotNull().alias("several"))
    named = materialise(named.filter(F.col("several") | (F.col("docs") >= min_docs)).drop("docs"), "named")
    members = found.select("doc_id", "version", "at", "leaf", "variant").join(named, ["leaf", "variant"]).drop("several")
    place = F.struct("doc_id", "at", "version")
    recurring = (
        members.groupBy("leaf", "template", "doc_id")
        .agg(F.min(place).alias("first"))
        .groupBy("leaf", "template")
        .agg(F.count(F.lit(1)).alias("docs"), F.min("first").alias("first"))
        .filter(F.col("docs") >= min_docs)
    )
    salted = recurring.select("leaf", "template", "first", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    gone = members.withColumn("salt", F.pmod(F.xxhash64("doc_id", "at"), F.lit(SALTS)).cast("int")).join(
        salted, ["leaf", "template", "salt"]
    )
    if keep_first:
        gone = gone.filter(place != F.col("first"))
    dropped = gone.groupBy("doc_id", "version").agg(F.sort_array(F.collect_set("at")).alias("dropped"))

    def kept(lines: Column) -> Column:
        left = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col("dropped"))
        return F.array_join(F.transform(left, lambda i: F.get(lines, i)), "\n")

    judged = known.join(dropped, ["doc_id", "version"], "left").select(
        "doc_id",
        "dropped",
        F.size(F.split("text", "\n")).alias("n_lines"),
        F.when(F.col("dropped").isNull(), F.col("text")).otherwise(_of_lines(kept)).alias("kept_text"),
    )
    whole = rows.filter("doc_id IS NULL OR text IS NULL").select(
        "doc_id",
        F.lit(None).cast("array<int>").alias("dropped"),
        F.size(F.split(F.coalesce("text", F.lit("")), "\n")).alias("n_lines"),
        F.coalesce("text", F.lit("")).alias("kept_text"),
    )
    return (
        judged.select(whole.columns)
        .unionByName(whole)
        .select(
            "doc_id",
            F.col("n_lines").cast("long").alias("n_lines"),
            F.coalesce(F.size("dropped"), F.lit(0)).cast("long").alias("n_dropped"),
            F.coalesce("dropped", F.array().cast("array<int>")).alias("dropped"),
            "kept_text",
        )
    )


def digest(result: DataFrame) -> DataFrame:
    return result.select("doc_id", "n_lines", "n_dropped", F.sha2("kept_text", 256).alias("kept_sha256"))


def oracle_sql(leading: int = LEADING, similar: int = SIMILAR, min_docs: int = MIN_DOCS) -> str:
    return f"""
    WITH lines AS MATERIALIZED (
        SELECT doc_id, i - 1 AS at_, ls[i] AS line,
               list_transform(list_filter(regexp_split_to_array(ls[i], '[\\x20\\x09-\\x0D]+'), lambda x: x <> ''),
                   lambda t: CASE WHEN regexp_matches(t, '[0-9@]|://') THEN '{WILD}' ELSE t END) AS tokens
        FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
             LATERAL (SELECT unnest(range(1, len(ls) + 1)) AS i)
    ), found AS MATERIALIZED (
        SELECT *, len(tokens) || ' ' || array_to_string(tokens[:{leading}], ' ') AS leaf,
               array_to_string(tokens, ' ') AS variant
        FROM lines WHERE len(list_filter(tokens, lambda t: t <> '{WILD}')) > 0
    ), variants AS MATERIALIZED (
        SELECT leaf, variant, any_value(tokens) AS tokens, count(DISTINCT doc_id) AS docs FROM found GROUP BY leaf, variant
    ), places AS MATERIALIZED (
        SELECT leaf, variant, docs, p, tokens[p] AS token
        FROM variants, LATERAL (SELECT unnest(range({leading + 1}, len(tokens) + 1)) AS p)
    ), shared AS (
        SELECT leaf, p, token, sum(docs) AS support FROM places WHERE token <> '{WILD}' GROUP BY leaf, p, token
        HAVING sum(docs) >= {min_docs} AND count(*) > 1
    ), ranked AS (
        SELECT leaf, variant, p, token, row_number() OVER (PARTITION BY leaf, variant ORDER BY support DESC, p) AS r
        FROM places JOIN shared USING (leaf, p, token)
    ), anchored AS MATERIALIZED (
        SELECT leaf, variant, string_agg(p || ' ' || token, ' ' ORDER BY r) AS anchors
        FROM ranked WHERE r <= {ANCHORS} GROUP BY leaf, variant
    ), votes AS (
        SELECT leaf, anchors, p, token, sum(docs) AS docs FROM places JOIN anchored USING (leaf, variant) GROUP BY ALL
    ), tops AS MATERIALIZED (
        SELECT leaf, anchors, p, arg_max(token, (docs, token)) AS top FROM votes
        GROUP BY leaf, anchors, p HAVING max(docs) * 2 >= sum(docs)
    ), belonging AS (
        SELECT leaf, variant, any_value(anchors) AS anchors
        FROM places JOIN anchored USING (leaf, variant) LEFT JOIN tops USING (leaf, anchors, p)
        GROUP BY leaf, variant
        HAVING count(*) FILTER (WHERE token <> '{WILD}' AND token = top) * 100
               >= count(*) FILTER (WHERE token <> '{WILD}') * {similar}
    ), members AS (
        SELECT doc_id, at_, leaf, coalesce('+' || anchors, '=' || f.variant) AS template
        FROM found f LEFT JOIN belonging USING (leaf, variant)
    ), recurring AS (
        SELECT leaf, template, min((doc_id, at_)) AS first FROM members GROUP BY leaf, template
        HAVING count(DISTINCT doc_id) >= {min_docs}
    ), gone AS (
        SELECT doc_id, at_ FROM members JOIN recurring USING (leaf, template) WHERE (doc_id, at_) <> first
    )
    SELECT l.doc_id, count(*) AS n_lines, count(g.at_) AS n_dropped,
           sha256(coalesce(string_agg(line, chr(10) ORDER BY l.at_) FILTER (WHERE g.at_ IS NULL), '')) AS kept_sha256
    FROM lines l LEFT JOIN gone g ON g.doc_id = l.doc_id AND g.at_ = l.at_ GROUP BY l.doc_id
    """
