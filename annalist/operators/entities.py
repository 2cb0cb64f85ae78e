"""Entity mentions, their resolution to canonical names, and search over the registry."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from annalist.functions import text as X
from annalist.functions.fuzzy import token_sort_similarity
from annalist.sources import sinks

#: Technology names, matched as whole words in any case.
TECHNOLOGIES = (
    "jwt oauth graphql rest grpc websocket cors csrf sql nosql kafka redis rabbitmq celery django fastapi flask express "
    "react vue angular next\\.js nuxt svelte postgres(?:ql)? mysql mongodb sqlite qdrant elasticsearch pinecone docker "
    "kubernetes k8s aws gcp azure terraform ansible python javascript typescript go(?:lang)? rust java c\\+\\+ ruby "
    "github[ ]actions ci/cd pytest jest mypy ruff black asyncio aiohttp httpx requests pydantic sqlmodel sqlalchemy "
    "langchain llamaindex openai anthropic ollama mistral ragas mlflow weights\\s?&\\s?biases w&b"
).split()
HEAD = 3  # characters of a word that a prefix search goes by
BLOCK = 4_096  # terms of a prefix search that go to the entries at once
TECH_PATTERN = r"(?i)\b(" + "|".join(TECHNOLOGIES) + r")\b"

#: Labels of a named-entity model to ours; others pass through.
_GIVEN = {"CONCEPT": "EVENT LAW WORK_OF_ART", "PLACE": "GPE LOC", "TECH": "PRODUCT"}
LABELS = {theirs: ours for ours, names in _GIVEN.items() for theirs in names.split()}


def tech_mentions(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, position, surface, label) of technology names, in order of the text."""
    found = F.regexp_extract_all(F.coalesce(F.col(text), F.lit("")), F.lit(TECH_PATTERN), 1)
    return docs.select(F.col(doc_id).alias("doc_id"), F.posexplode(found).alias("position", "surface")).withColumn("label", F.lit("TECH"))


def mentions(
    docs: DataFrame, model: Callable[[DataFrame], DataFrame] | None = None, doc_id: str = "doc_id", text: str = "text"
) -> DataFrame:
    """Mentions distinct by lower-cased surface and label within a document, the first kept.

    ``model``, if given, takes the documents and returns (doc_id, position,
    surface, label); its mentions come before the pattern's.
    """
    found = tech_mentions(docs, doc_id, text).withColumn("turn", F.lit(1))
    if model is not None:
        names = F.create_map(*[F.lit(x) for kv in LABELS.items() for x in kv])
        own = model(docs).withColumn("label", F.coalesce(F.element_at(names, F.col("label")), F.col("label")))
        found = own.withColumn("turn", F.lit(0)).select(found.columns).unionByName(found)
    return (
        found.groupBy("doc_id", "label", F.lower("surface").alias("mention"))
        .agg(F.min(F.struct("turn", "position", "surface")).alias("first"))
        .select("doc_id", "label", "mention", "first.surface", "first.turn", "first.position")
    )


def code_mentions(entities: DataFrame) -> DataFrame:
    """Classes as MODULE, functions and methods as FUNCTION; imports left out."""
    label = F.when(F.col("entity_type") == "class", "MODULE").otherwise("FUNCTION")
    return entities.filter(F.col("entity_type").isin("class", "function", "method")).select(
        F.col("file_path").alias("doc_id"), label.alias("label"), F.col("name").alias("surface"), F.col("start_line").alias("position")
    )


def resolve_exact(found: DataFrame, registry: DataFrame | None = None, order: list[Column] | None = None) -> DataFrame:
    """Canonical name of each mention: ``found`` plus ``canonical_name``.

    A surface equal, without regard to case, to a registered name or alias takes
    that name; a new one the surface that came first, by ``order``.
    """
    key = F.lower(F.trim("surface"))
    order = order or [F.col("doc_id"), F.col("turn"), F.col("position")]
    keyed = found.withColumn("key", key)
    firsts = keyed.groupBy("key").agg(F.min_by(F.trim("surface"), F.struct(*order)).alias("new_name"))
    if registry is None:
        return keyed.join(firsts, "key").withColumnRenamed("new_name", "canonical_name").drop("key")
    names = (
        registry.select("canonical_name", "seq", F.explode(F.array_union(F.array("canonical_name"), F.col("aliases"))).alias("alias"))
        .groupBy(F.lower("alias").alias("key"))
        .agg(F.min(F.struct("seq", "canonical_name"))["canonical_name"].alias("old_name"))
    )
    return (
        keyed.join(firsts, "key")
        .join(names, "key", "left")
        .withColumn("canonical_name", F.coalesce("old_name", "new_name"))
        .drop("key", "old_name", "new_name")
    )


def fuzzy_pairs(left: DataFrame, right: DataFrame, cutoff: float = 85.0) -> DataFrame:
    """(a, b, score) of names at least ``cutoff`` alike; both sides have one column ``name``.

    Similarity is 200 * common / (sum of lengths), over the names' sorted words.
    Let k characters be common of la + lb: no more than la + lb - 2k others can
    part neighbours, so 3k - 1 - (la + lb) pairs of neighbouring characters stand
    in both names.  Of a name's pairs, in order of rarity, all but as many as may
    be missing are therefore looked up; where that bound says nothing (short
    names, low cutoffs) single characters are looked up as well.  Common pairs of
    characters are never joined on, unless a name has no others.
    """
    share = 1.5 * cutoff / 100 - 1  # of la + lb, that is the least number of common pairs, plus 1
    longest = 2 / share if share > 0.05 else float("inf")  # the bound says something for longer names together
    words = F.filter(F.split(F.trim("name"), r"\s+"), lambda w: w != "")

    def keyed(names: DataFrame, out: str) -> DataFrame:
        rows = names.filter("name IS NOT NULL").select(F.col("name").alias(out), F.array_join(F.array_sort(words), " ").alias("s")).distinct()
        size = F.length("s")
        pairs = F.when(size > 1, F.transform(F.sequence(F.lit(1), size - 1), lambda i: F.substring("s", i, F.lit(2))))
        single = F.when(size <= longest, F.filter(F.split("s", ""), lambda c: c != ""))
        none = F.array().cast("array<string>")
        return rows.select(out, size.alias("size"), F.array_distinct(F.coalesce(pairs, none)).alias("pairs"), F.array_distinct(F.coalesce(single, none)).alias("single"))

    a, b = keyed(left, "a"), keyed(right, "b")
    both = a.select("a", F.explode("pairs").alias("gram")).unionByName(b.select(F.col("b").alias("a"), F.explode("pairs").alias("gram")))
    often = both.groupBy("gram").agg(F.count(F.lit(1)).alias("n"))

    def rare(rows: DataFrame, out: str) -> DataFrame:
        # the shortest partner makes the sum of lengths least; repeated pairs count once here, so as many more may be missing
        least = F.floor(F.lit(share) * F.col("size") * (2 / (2 - cutoff / 100)) - 1 - F.lit(1e-9))
        repeats = F.col("size") - 1 - F.size("pairs")
        keep = F.greatest(F.size("pairs") - F.greatest(least - repeats, F.lit(1)) + 1, F.lit(1)).cast("int")
        ranked = (
            rows.select(out, "size", "pairs", F.explode("pairs").alias("gram"))
            .join(often, "gram")
            .groupBy(out, "size", "pairs")
            .agg(F.sort_array(F.collect_list(F.struct("n", "gram"))).alias("g"))
            .select(out, "size", F.explode(F.slice(F.col("g.gram"), 1, keep)).alias("gram"))
        )
        return ranked.unionByName(rows.select(out, "size", F.explode("single").alias("gram")))

    near = 200 * F.least("a.size", "b.size") >= F.lit(cutoff) * (F.col("a.size") + F.col("b.size"))
    return (
        rare(a, "a").alias("a")
        .join(rare(b, "b").alias("b"), F.col("a.gram") == F.col("b.gram"))
        .filter(near & (F.col("a") != F.col("b")))
        .select("a", "b")
        .distinct()
        .withColumn("score", token_sort_similarity("a", "b"))
        .filter(F.col("score") >= cutoff)
    )


def resolve_fuzzy(surfaces: DataFrame, cutoff: float = 85.0) -> DataFrame:
    """(surface, canonical_name) of (surface, seq), in order of ``seq``.

    Each surface takes the name of the most alike earlier surface at ``cutoff``
    or above (ties: the earliest), without regard to case, or else is a name of
    its own.  An earlier surface counts whether it was new itself or an alias, so
    each surface has one predecessor, whatever became of that, and names are
    found by following predecessors: a join of alike pairs, then jumps that
    double, with no fold over the vocabulary.
    """
    turn = F.struct("seq", "surface")
    firsts = sinks.written(
        surfaces.filter("surface IS NOT NULL").groupBy(F.lower("surface").alias("name")).agg(F.min(turn).alias("turn")), "surfaces"
    )
    pairs = fuzzy_pairs(firsts.select("name"), firsts.select("name"), cutoff)
    places = [firsts.select(F.col("name").alias(c), F.col("turn").alias(f"turn_{c}")) for c in "ab"]
    before = (
        pairs.join(places[0], "a")
        .join(places[1], "b")
        .filter("turn_b < turn_a")
        .groupBy("a")
        .agg(F.min(F.struct((-F.col("score")).alias("far"), "turn_b", "b")).alias("best"))
        .select(F.col("a").alias("name"), F.col("best.b").alias("up"))
    )
    step = sinks.written(
        firsts.join(before, "name", "left").select("name", F.coalesce("up", "name").alias("up")), "predecessors"
    )
    while True:
        above = step.select(F.col("name").alias("up"), F.col("up").alias("top"))
        jumped = sinks.written(step.join(above, "up").select("name", F.col("top").alias("up")), "predecessors")
        if jumped.join(step.withColumnRenamed("up", "old"), "name").filter("up <> old").isEmpty():
            break
        step = jumped
    named = step.join(firsts.select(F.col("name").alias("up"), F.col("turn.surface").alias("canonical_name")), "up")
    return surfaces.join(named.select("name", "canonical_name"), F.lower("surface") == F.col("name")).select("surface", "canonical_name")


def register(resolved: DataFrame, batch: int = 0) -> DataFrame:
    """Registry rows of resolved mentions: aliases and documents as sorted sets; the first label stays.

    ``seq`` is the number of the batch that brought the entity, for the order of searches; within a batch names decide.
    """
    order = F.struct("doc_id", "turn", "position")
    return resolved.groupBy("canonical_name").agg(
        F.min_by("label", order).alias("entity_type"),
        F.sort_array(F.collect_set(F.when(F.trim("surface") != F.col("canonical_name"), F.trim("surface")))).alias("aliases"),
        F.sort_array(F.collect_set(F.col("doc_id").cast("string"))).alias("doc_ids"),
        F.lit(batch).cast("long").alias("seq"),
    )


def merge_registry(old: DataFrame, new: DataFrame) -> DataFrame:
    """Union of two registries by name: sets united, the older type kept.

    The newly touched come last where ``new`` was registered with a later batch's number.
    """
    both = old.withColumn("batch", F.lit(0)).unionByName(new.withColumn("batch", F.lit(1)))
    return both.groupBy("canonical_name").agg(
        F.min_by("entity_type", "batch").alias("entity_type"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("aliases")))).alias("aliases"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("doc_ids")))).alias("doc_ids"),
        F.max("seq").alias("seq"),
    )


def prefix_search(registry: DataFrame, terms: DataFrame, limit: int = 10, columns: list[str] | None = None) -> DataFrame:
    """(term, rank, canonical_name) of entries that hold all words of the term, the last as a prefix.

    Words are sought in name, aliases, document ids and type together.  Terms go
    to the entries, which stay in place; a task keeps and hands on ``limit`` entries
    a term.  Each entry looks up the first ``HEAD`` characters of its words and fewer
    among the terms', and only what stands there is compared.
    """
    columns = columns or ["canonical_name", "aliases", "doc_ids", "entity_type"]
    parts = [F.array_join(c, " ") if dict(registry.dtypes)[c].startswith("array") else F.col(c).cast("string") for c in columns]
    words = lambda c: F.filter(F.split(F.lower(X.without_punctuation(c)), r"\s+"), lambda w: w != "")
    entries = registry.select("canonical_name", F.col("seq").cast("long").alias("seq"), F.array_distinct(words(F.concat_ws(" ", *parts))).alias("words"))
    asked = terms.select("term").distinct().withColumn("asked", words(F.col("term"))).filter(F.size("asked") > 0)
    sought = sinks.written(asked, "terms").toArrow()
    found = [entries.mapInArrow(_prefixed(sought.slice(lo, BLOCK), limit), "term string, seq long, canonical_name string") for lo in range(0, sought.num_rows, BLOCK)]
    hit = reduce(DataFrame.unionByName, found or [entries.select(F.col("canonical_name").alias("term"), "seq", "canonical_name").limit(0)])
    best = Window.partitionBy("term").orderBy("seq", "canonical_name")
    return hit.withColumn("rank", F.row_number().over(best) - 1).filter(F.col("rank") < limit).select("term", "rank", "canonical_name")


def _prefixed(sought: pa.Table, limit: int):
    """Kernel: of (canonical_name, seq, words), the first ``limit`` by seq and name of each term."""
    asked = list(zip(sought["term"].to_pylist(), sought["asked"].to_pylist(), strict=True))
    heads: dict[str, list[int]] = {}
    for i, (_, all_words) in enumerate(asked):
        heads.setdefault(all_words[-1][:HEAD], []).append(i)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: dict[int, list] = {i: [] for i in range(len(asked))}
        hits: dict[str, list[int]] = {}
        for batch in batches:
            sizes = batch.column("words").value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
            coded = batch.column("words").flatten().dictionary_encode()
            codes, row = coded.indices.to_numpy(zero_copy_only=False), np.repeat(np.arange(batch.num_rows), sizes)
            for k, w in enumerate(coded.dictionary.to_pylist()):
                for i in {i for n in range(1, HEAD + 1) for i in heads.get(w[:n], ())}:
                    if w.startswith(asked[i][1][-1]):
                        hits.setdefault(i, []).append(k)
            place = {w: k for k, w in enumerate(coded.dictionary.to_pylist())}
            for i, found in hits.items():
                flags = np.zeros(len(coded.dictionary), bool)
                flags[found] = True
                rows = np.unique(row[flags[codes]])
                for w in asked[i][1][:-1]:
                    rows = np.intersect1d(rows, row[codes == place.get(w, -1)])
                some = batch.select(["seq", "canonical_name"]).take(pa.array(rows))
                both = pa.Table.from_batches([some] if not kept[i] else [*kept[i], some])
                order = [("seq", "ascending"), ("canonical_name", "ascending")]
                kept[i] = both.take(pc.sort_indices(both, sort_keys=order, null_placement="at_start")[:limit]).combine_chunks().to_batches()
            hits.clear()
        for i, found in kept.items():
            for b in found:
                yield pa.RecordBatch.from_arrays([pa.array([asked[i][0]] * b.num_rows, pa.string()), *b.columns], names=["term", "seq", "canonical_name"])

    return run


def resolve_terms(registry: DataFrame, terms: DataFrame, limit: int = 5, columns: list[str] | None = None) -> DataFrame:
    """(query_id, canonical names): of each term the first entry found, else the term; distinct in order.

    ``terms`` has query_id, position and term.
    """
    first = prefix_search(registry, terms, limit, columns).filter("rank = 0").select("term", "canonical_name")
    named = terms.join(first, "term", "left").withColumn("name", F.coalesce("canonical_name", "term"))
    ordered = F.transform(F.sort_array(F.collect_list(F.struct("position", "name"))), lambda x: x["name"])
    return named.groupBy("query_id").agg(F.array_distinct(ordered).alias("names"))
