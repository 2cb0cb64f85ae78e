"""Licence scan by diagonal voting."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from annalist.llm.license_texts import PHRASES, TEMPLATES
from annalist.llm.textnum import ALNUM_SEP, LOWER, Words, inside, text_chunks, window_hashes

GRAM = 3
NEIGHBOURS = 4
COVERED = 0.75
PHRASE_ONLY = 0.5


def _words(text: str) -> list[bytes]:
    data = LOWER[np.frombuffer(text.encode(), dtype=np.uint8)]
    w = Words(data, np.array([0, len(data)]), ALNUM_SEP)
    return [data[a:b].tobytes() for a, b in zip(w.start, w.end, strict=True)]


def _hashes(text: str) -> np.ndarray:
    data = LOWER[np.frombuffer(text.encode(), dtype=np.uint8)]
    return Words(data, np.array([0, len(data)]), ALNUM_SEP).hashes()


def template_rows(templates: list[tuple[str, str]], gram: int) -> list[tuple[int, int, int, str, int]]:
    """(gram hash, template, position, label, words of the template), a row for every position of every template."""
    rows = []
    for t, (label, text) in enumerate(templates):
        h = _hashes(text)
        for at, g in enumerate(window_hashes(h, gram).view(np.int64).tolist()):
            rows.append((g, t, at, label, len(h)))
    return rows


def _scan(phrases: list[tuple[str, str]], gram: int):
    wanted = [(_hashes(p), label) for p, label in phrases]
    base = pa.struct(
        [
            ("doc_id", pa.int64()),
            ("n_words", pa.int64()),
            ("n_base", pa.int64()),
            ("first_word", pa.int64()),
            ("last_word", pa.int64()),
            ("base_labels", pa.list_(pa.string())),
        ]
    )
    schema = pa.schema([("row", pa.int64()), ("base", base), ("grams", pa.list_(pa.int64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task = TaskContext.get()
        row = (task.partitionId() if task else 0) << 40
        for batch in batches:
            ids = batch.column(0).to_pylist()
            for lo, hi, data, offsets in text_chunks(batch.column(1)):
                w = Words(LOWER[data], offsets, ALNUM_SEP)
                h = w.hashes()
                n = hi - lo
                count = np.zeros(n, dtype=np.int64)
                least, most = np.full(n, np.iinfo(np.int64).max), np.full(n, -1, dtype=np.int64)
                labels: list[set[str]] = [set() for _ in range(n)]
                for p, label in wanted:
                    k = len(p)
                    if len(h) < k:
                        continue
                    hit = inside(w.first, k)
                    for i in range(k):
                        hit &= h[i : len(h) - k + 1 + i] == p[i]
                    at = np.flatnonzero(hit)
                    doc = w.doc[at]
                    place = at - w.first[doc]
                    np.add.at(count, doc, 1)
                    np.minimum.at(least, doc, place)
                    np.maximum.at(most, doc, place)
                    for d in np.unique(doc).tolist():
                        labels[d].add(label)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(range(row, row + n), pa.int64()),
                        pa.array(
                            [
                                {
                                    "doc_id": ids[lo + d],
                                    "n_words": int(w.first[d + 1] - w.first[d]),
                                    "n_base": int(count[d]),
                                    "first_word": int(least[d]) if count[d] else None,
                                    "last_word": int(most[d]) if count[d] else None,
                                    "base_labels": sorted(labels[d]),
                                }
                                for d in range(n)
                            ],
                            base,
                        ),
                        pa.nulls(n, pa.list_(pa.int64())),
                    ],
                    schema=schema,
                )
                # rolling grams of every document; its last ones would run into the next
                room = np.maximum(np.diff(w.first) - gram + 1, 0)
                grams = window_hashes(h, gram)[inside(w.first, gram)].view(np.int64)
                cuts = np.concatenate([[0], np.cumsum(room)]).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(range(row, row + n), pa.int64()),
                        pa.nulls(n, base),
                        pa.ListArray.from_arrays(pa.array(cuts), pa.array(grams)),
                    ],
                    schema=schema,
                )
                row += n

    return run, (
        "row long, base struct<doc_id:long,n_words:long,n_base:long,first_word:long,last_word:long,"
        "base_labels:array<string>>, grams array<long>"
    )


def license_scan(
    docs: DataFrame,
    templates: list[tuple[str, str]] = TEMPLATES,
    phrases: list[tuple[str, str]] = PHRASES,
    gram: int = GRAM,
    neighbours: int = NEIGHBOURS,
    covered: float = COVERED,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """One row per input row: doc_id, n_words, n_base, first_word, last_word, base_labels, spans, labels, score.

    Words are runs of a-z, 0-9 and non-ASCII characters after lower-casing A-Z.
    Every rolling gram of every document is joined to the templates' positions
    (a table fixed by the code, some 1,000 rows, hence broadcast).  Hits vote for
    their diagonal, document position minus template position; diagonals of one
    template at most ``neighbours`` apart (a word put in or left out) merge; the
    merged span is verified by the share of the template's words that its grams
    cover, ``covered`` at least.  Of overlapping spans the best stays.

    ``spans`` holds (label, start, end, score) in words; ``labels`` the spans'
    and the phrases' labels, sorted and distinct; ``score`` the best span's
    share, or 0.5 where only a phrase was found, or 0.

    Null and empty texts have no words and score 0; null ids are carried; rows
    that repeat an id are scanned each for itself; an empty table gives no rows;
    other columns are ignored.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    known = spark.createDataFrame(
        template_rows(templates, gram), "gram long, template int, at int, label string, template_words int"
    )
    run, schema = _scan(phrases, gram)
    voted = (
        rows.mapInArrow(run, schema)
        .select("row", "base", F.posexplode_outer("grams").alias("pos", "gram"))
        .join(F.broadcast(known), "gram", "left")
        .filter("base IS NOT NULL OR template IS NOT NULL")
        .withColumn("diagonal", F.col("pos") - F.col("at"))
        .repartition("row")
        .groupBy("row", "template", "diagonal")
        .agg(
            F.first("base", ignorenulls=True).alias("base"),
            F.first("label", ignorenulls=True).alias("label"),
            F.first("template_words", ignorenulls=True).alias("template_words"),
            F.collect_set("at").alias("ats"),
            F.min("pos").alias("lo"),
            F.max("pos").alias("hi"),
        )
    )
    along = Window.partitionBy("row", "template").orderBy("diagonal")
    merged = (
        voted.withColumn("new", (F.col("diagonal") - F.lag("diagonal").over(along) > neighbours).cast("int"))
        .withColumn("cluster", F.sum("new").over(along))
        .groupBy("row", "template", "cluster")
        .agg(
            F.first("base", ignorenulls=True).alias("base"),
            F.first("label", ignorenulls=True).alias("label"),
            F.first("template_words", ignorenulls=True).alias("template_words"),
            F.array_distinct(F.flatten(F.collect_list("ats"))).alias("ats"),
            F.min("lo").alias("start"),
            (F.max("hi") + gram).alias("end"),
        )
    )
    words = F.size(F.array_distinct(F.flatten(F.transform("ats", lambda a: F.sequence(a, a + (gram - 1))))))
    checked = merged.withColumn("share", words / F.col("template_words")).filter(
        F.col("base").isNotNull() | (F.col("share") >= covered)
    )
    before = Window.partitionBy("row").orderBy("start", "end", "template").rowsBetween(Window.unboundedPreceding, -1)
    order = Window.partitionBy("row").orderBy("start", "end", "template")
    best = (
        checked.withColumn("reach", F.max("end").over(before))
        .withColumn("island", F.sum((F.col("start") >= F.coalesce("reach", F.lit(0))).cast("int")).over(order))
        .groupBy("row", "island")
        .agg(
            F.first("base", ignorenulls=True).alias("base"),
            F.max(
                F.when(
                    F.col("template").isNotNull(),
                    F.struct("share", "template_words", -F.col("template"), "label", "start", "end"),
                )
            ).alias("top"),
        )
    )
    span = F.struct(F.col("top.label"), F.col("top.start"), F.col("top.end"), F.col("top.share").alias("score"))
    found = best.groupBy("row").agg(
        F.first("base", ignorenulls=True).alias("base"),
        F.sort_array(F.collect_list(F.when(F.col("top").isNotNull(), F.struct("top.start", span.alias("s"))))).alias("s"),
    )
    spans = F.transform("s", lambda x: x["s"])
    return found.select("base.*", spans.alias("spans")).select(
        "doc_id",
        "n_words",
        "n_base",
        "first_word",
        "last_word",
        F.array_join("base_labels", ",").alias("base_labels"),
        "spans",
        F.array_join(F.array_sort(F.array_union("base_labels", F.col("spans.label"))), ",").alias("labels"),
        F.greatest(
            F.coalesce(F.array_max(F.col("spans.score")), F.lit(0.0)),
            F.when(F.col("n_base") > 0, F.lit(PHRASE_ONLY)).otherwise(F.lit(0.0)),
        ).alias("score"),
    )


def digest(result: DataFrame) -> DataFrame:
    return result.drop("spans")


def oracle_sql(gram: int = GRAM, neighbours: int = NEIGHBOURS, covered: float = COVERED) -> str:
    from annalist.llm.common import UPPER

    values = ", ".join(
        f"('{b' '.join(words[at:at + gram]).decode()}', {t}, {at}, '{label}', {len(words)})"
        for t, (label, text) in enumerate(TEMPLATES)
        for words in [_words(text)]
        for at in range(len(words) - gram + 1)
    )
    phrases = ", ".join(f"('{p}', {p.count(' ') + 1}, '{label}')" for p, label in PHRASES)
    return f"""
    WITH known(gram, template, tpos, label, template_words) AS (VALUES {values}),
    phrases(phrase, k, label) AS (VALUES {phrases}),
    d AS MATERIALIZED (
        SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), '{UPPER}', '{UPPER.lower()}'),
            '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda x: x <> '') AS words FROM documents
    ), w AS MATERIALIZED (
        SELECT doc_id, words, i FROM d, LATERAL (SELECT unnest(range(0, len(words))) AS i)
    ), places AS (
        SELECT doc_id, i, label FROM w JOIN phrases p ON array_to_string(words[i + 1:i + k], ' ') = phrase
    ), base AS (
        SELECT doc_id, count(*) AS n_base, min(i) AS first_word, max(i) AS last_word,
               list_sort(list_distinct(list(label))) AS base_labels FROM places GROUP BY doc_id
    ), votes AS (
        SELECT doc_id, template, label, template_words, tpos, i, i - tpos AS diagonal
        FROM w JOIN known ON array_to_string(words[i + 1:i + {gram}], ' ') = gram
    ), diagonals AS (SELECT DISTINCT doc_id, template, diagonal FROM votes),
    clusters AS (
        SELECT doc_id, template, diagonal, sum(new) OVER (PARTITION BY doc_id, template ORDER BY diagonal) AS cluster
        FROM (SELECT *, (coalesce(diagonal - lag(diagonal) OVER (PARTITION BY doc_id, template ORDER BY diagonal), 0)
                         > {neighbours})::int AS new FROM diagonals)
    ), merged AS (
        SELECT doc_id, template, cluster, label, template_words, min(i) AS s, max(i) + {gram} AS e,
               count(DISTINCT tpos + o) / template_words AS share
        FROM votes JOIN clusters USING (doc_id, template, diagonal), (SELECT unnest(range(0, {gram})) AS o)
        GROUP BY doc_id, template, cluster, label, template_words HAVING share >= {covered}
    ), islands AS (
        SELECT *, sum((s >= coalesce(reach, 0))::int) OVER (PARTITION BY doc_id ORDER BY s, e, template) AS island
        FROM (SELECT *, max(e) OVER (PARTITION BY doc_id ORDER BY s, e, template
                                     ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM merged)
    ), best AS (
        SELECT doc_id, label, share FROM islands
        QUALIFY row_number() OVER (PARTITION BY doc_id, island ORDER BY share DESC, template_words DESC, template,
                                   label DESC, s DESC, e DESC) = 1
    ), found AS (
        SELECT doc_id, max(share) AS share, list(label) AS labels FROM best GROUP BY doc_id
    )
    SELECT doc_id, len(words) AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word,
           coalesce(array_to_string(base_labels, ','), '') AS base_labels,
           array_to_string(list_sort(list_distinct(
               list_concat(coalesce(base_labels, []), coalesce(labels, [])))), ',') AS labels,
           greatest(coalesce(share, 0.0), CASE WHEN n_base > 0 THEN {PHRASE_ONLY} ELSE 0.0 END)::double AS score
    FROM d LEFT JOIN base USING (doc_id) LEFT JOIN found USING (doc_id)
    """
