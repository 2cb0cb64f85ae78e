"""Mixing of sources to target weights by hierarchical budgeting."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from annalist.llm.common import drop_ids, materialise

LEVELS = ("domain", "lang", "source")
DOMAIN_OF = ("web", "reference", "forum", "books")  # by a source's number
WEIGHTS = {
    "domain": {"web": 0.4, "reference": 0.3, "forum": 0.2, "books": 0.1},
    "lang": {"en": 0.55, "de": 0.15, "es": 0.15, "fr": 0.15},
    "source": {},
}
OTHER = {"domain": 0.05, "lang": 0.05, "source": 1.0}  # of a name without a weight
SHARE = 0.5  # of all tokens
EPOCHS = 2
SEED = 17
BROADCAST_LEAVES = 100_000


def default_domain(source: Column) -> Column:
    number = F.regexp_extract(source, "([0-9]{1,9})$", 1)
    named = F.element_at(F.array(*[F.lit(d) for d in DOMAIN_OF]), F.pmod(number.cast("int"), F.lit(4)) + 1)
    return F.when(number == "", F.lit("other")).otherwise(named)


def word_count(text: Column) -> Column:
    """Words (runs without ASCII white space) of a text; null has none."""
    text = F.coalesce(text, F.lit(""))
    lead = F.when(text.rlike("\\A[\\x20\\x09-\\x0D]"), 1).otherwise(0)
    pieces = F.size(F.split(text, "[\\x20\\x09-\\x0D]+"))
    trail = F.when(text.rlike("[\\x20\\x09-\\x0D]\\z"), 1).otherwise(0)
    return F.when(~text.rlike("[^\\x20\\x09-\\x0D]"), F.lit(0)).otherwise(pieces - lead - trail).cast("long")


def _weight(level: str, weights: dict[str, dict[str, float]]) -> Column:
    known = weights.get(level, {})
    out = F.lit(float(OTHER[level]))
    for name, w in known.items():
        out = F.when(F.col(level) == name, F.lit(float(w))).otherwise(out)
    return out


def _fill(nodes: DataFrame, parent: list[str]) -> DataFrame:
    """Adds ``budget`` to children (weight, room) of parents with ``parent_budget``.

    A child gets its weight's part of the budget up to its room; what it cannot
    take goes to its siblings by their weights, and so on.  With the children in
    order of room by weight, the water level is the largest over the children of
    (budget - room of those before) / (weight of this and those after).
    """
    order: list[Column] = [F.col("room") / F.col("weight"), *[F.col(c) for c in LEVELS[: len(parent) + 1]]]
    before = Window.partitionBy(*parent).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    # this one and those after, as a running sum from the other end: one addition a row
    after = Window.partitionBy(*parent).orderBy(*[c.desc() for c in order]).rowsBetween(Window.unboundedPreceding, 0)
    level = (F.col("parent_budget") - F.coalesce(F.sum("room").over(before), F.lit(0))) / F.sum("weight").over(after)
    return (
        nodes.withColumn("level", level)
        .withColumn("budget", F.least(F.col("room").cast("double"), F.col("weight") * F.max("level").over(Window.partitionBy(*parent))))
        .drop("level", "parent_budget")
    )


def budgets(leaves: DataFrame, weights: dict[str, dict[str, float]], total: float | Column, epochs: int) -> DataFrame:
    """Token budgets of ``leaves`` (domain, lang, source, tokens), from the top of the tree down.

    A node's room is ``epochs`` times the tokens below it, so no node is promised
    more than it has: a leaf's shortage goes to its siblings, and only what the
    whole branch lacks goes to the branch's siblings.  Names of weight 0 get
    nothing; weights count relative to the siblings present.
    """
    rooms = leaves.withColumn("room", F.col("tokens") * epochs)
    for level in LEVELS:
        rooms = rooms.filter(_weight(level, weights) > 0)
    parents = None
    for depth in range(1, len(LEVELS) + 1):
        here = list(LEVELS[:depth])
        nodes = rooms.groupBy(*here).agg(F.sum("room").alias("room")).withColumn("weight", _weight(LEVELS[depth - 1], weights))
        if parents is None:
            nodes = nodes.withColumn("parent_budget", total if isinstance(total, Column) else F.lit(float(total)))
        else:
            nodes = nodes.join(parents, here[:-1])
        parents = _fill(nodes, here[:-1]).select(*here, F.col("budget").alias("parent_budget"))
    return parents.withColumnRenamed("parent_budget", "budget")


def _leaf_and_tokens(domain) -> list[Column]:
    return [
        F.coalesce(domain(F.col("source")), F.lit("other")).alias("domain"),
        F.coalesce("lang", F.lit("unknown")).alias("lang"),
        F.coalesce("source", F.lit("unknown")).alias("source"),
        word_count(F.col("text")).alias("n_tokens"),
    ]


def mix(
    docs: DataFrame,
    weights: dict[str, dict[str, float]] = WEIGHTS,
    share: float = SHARE,
    epochs: int = EPOCHS,
    seed: int = SEED,
    domain=default_domain,
) -> DataFrame:
    """One row per input row: doc_id, domain, lang, source, n_tokens, copies.

    ``docs`` has doc_id, text, lang and source; tokens are words.  The budget is
    ``share`` of all tokens.  A leaf whose budget holds e whole epochs of its
    tokens takes every document e times; of the next epoch it takes a prefix, in
    the order of a hash of seed, epoch and doc_id, as long as the running sum of
    tokens stays within the rest.

    The running sum is split by the hash's first three digits: totals of the
    4,096 bins of a leaf, then a window over one bin only, so no task sees a
    whole leaf.

    Null lang or source counts as 'unknown' (its domain: 'other'), null text has
    no tokens; rows that repeat an id and all else are copied alike; a row with
    a null id takes part under the id ''; an empty table gives no rows; other
    columns are ignored.
    """
    digest = lambda epoch: F.md5(F.concat_ws("-", F.lit(seed), epoch, F.coalesce(F.col("doc_id").cast("string"), F.lit(""))))
    rows = materialise(
        docs.select(
            F.col("doc_id").cast("long").alias("doc_id"),
            *_leaf_and_tokens(domain),
        ),
        "mix_rows",
    )
    leaf = list(LEVELS)
    leaves = materialise(
        rows.groupBy(*leaf).agg(F.sum("n_tokens").alias("tokens")).filter("tokens > 0"), "mix_leaves"
    )
    total = float(leaves.agg(F.sum("tokens")).head()[0] or 0) * share
    plan = materialise(
        budgets(leaves, weights, total, epochs)
        .join(leaves, leaf)
        .withColumn("budget", F.floor(F.col("budget") + 1e-6))
        .withColumn("whole", F.floor(F.col("budget") / F.col("tokens")))
        .select(*leaf, "whole", (F.col("budget") - F.col("whole") * F.col("tokens")).alias("rest")),
        "mix_plan",
    )
    plan = F.broadcast(plan) if plan.count() <= BROADCAST_LEAVES else plan
    placed = (
        rows.join(plan, leaf, "left")
        .withColumn("order", digest(F.coalesce("whole", F.lit(0)).cast("string")))
        .withColumn("bin", F.substring("order", 1, 3))
    )
    bins = (
        placed.filter("rest > 0")
        .groupBy(*leaf, "bin", "rest")
        .agg(F.sum("n_tokens").alias("bin_tokens"))
        .withColumn("upto", F.sum("bin_tokens").over(Window.partitionBy(*leaf).orderBy("bin")))
    )
    last = materialise(
        bins.filter(F.col("upto") > F.col("rest"))
        .groupBy(*leaf)
        .agg(F.min("bin").alias("last_bin"), F.min_by(F.col("upto") - F.col("bin_tokens"), "bin").alias("base")),
        "mix_last",
    )
    last = F.broadcast(last) if last.count() <= BROADCAST_LEAVES else last
    placed = placed.join(last, leaf, "left")
    early = (F.col("rest") > 0) & (F.col("last_bin").isNull() | (F.col("bin") < F.col("last_bin")))
    edge = (F.col("rest") > 0) & (F.col("bin") == F.col("last_bin"))
    whole = F.coalesce("whole", F.lit(0))
    keep = ["doc_id", *leaf, "n_tokens"]
    plain = placed.filter(~F.coalesce(edge, F.lit(False))).select(
        *keep, (whole + F.when(F.coalesce(early, F.lit(False)), 1).otherwise(0)).cast("int").alias("copies")
    )
    running = F.sum("n_tokens").over(Window.partitionBy(*leaf).orderBy("order", "n_tokens"))
    cut = placed.filter(edge).withColumn("upto", F.col("base") + running)
    return plain.unionByName(
        cut.select(*keep, (whole + F.when(F.col("upto") <= F.col("rest"), 1).otherwise(0)).cast("int").alias("copies"))
    )


def mixed_documents(docs: DataFrame, **options) -> DataFrame:
    """``docs``, each row as often as the mix says (not at all, once, or more); columns unchanged.

    An id whose rows all have one number of copies goes by the id alone.  Rows
    with a null id, and of an id whose rows differ in copies, go by what the
    copies depend on: id, leaf and tokens.
    """
    version = lambda columns: F.xxhash64(*columns).alias("_version_")
    planned = materialise(
        mix(docs, **options).select("doc_id", version([*LEVELS, "n_tokens"]), "copies"), "mix_copies"
    )
    fates = materialise(
        planned.groupBy("doc_id").agg(F.min("copies").alias("least"), F.max("copies").alias("_copies_")), "mix_fates"
    )
    mixed = fates.filter("doc_id IS NOT NULL AND least < _copies_").select("doc_id")
    alike = fates.filter("doc_id IS NOT NULL AND least = _copies_").select("doc_id", "_copies_")
    gone = alike.filter("_copies_ = 0").select("doc_id").unionByName(mixed)
    out = drop_ids(docs, gone).filter("doc_id IS NOT NULL")
    again = alike.filter("_copies_ > 1")
    if not again.isEmpty():
        out = (
            out.join(again, "doc_id", "left")
            .withColumn("_copies_", F.explode(F.sequence(F.lit(1), F.coalesce("_copies_", F.lit(1)))))
            .select(*docs.columns)
        )
    if fates.filter("doc_id IS NULL OR least < _copies_").isEmpty():
        return out
    apart = docs.filter("doc_id IS NULL").unionByName(docs.join(mixed, "doc_id", "left_semi").select(*docs.columns))
    taken = planned.filter("copies > 0").distinct().toDF("_id_", "_planned_", "_copies_")
    by_row = (
        apart.withColumn("_version_", version(_leaf_and_tokens(options.get("domain", default_domain))))
        .join(taken, F.col("doc_id").eqNullSafe(F.col("_id_")) & (F.col("_version_") == F.col("_planned_")))
        .withColumn("_copies_", F.explode(F.sequence(F.lit(1), "_copies_")))
        .select(*docs.columns)
    )
    return out.unionByName(by_row)


def oracle_sql(share: float = SHARE, epochs: int = EPOCHS, seed: int = SEED) -> str:
    def weight(level: str) -> str:
        cases = " ".join(f"WHEN {level} = '{k}' THEN {v}" for k, v in WEIGHTS[level].items())
        return f"(CASE {cases} ELSE {OTHER[level]} END)" if cases else str(OTHER[level])

    def fill(name: str, parent: list[str], budget: str) -> str:
        here = ", ".join(LEVELS[: len(parent) + 1])
        part = f"PARTITION BY {', '.join(parent)} " if parent else ""
        join = f"JOIN {budget} USING ({', '.join(parent)})" if parent else f", (SELECT {share} * sum(tokens) AS given FROM leaves)"
        return f"""{name}_n AS (
            SELECT {here}, sum(tokens) * {epochs} AS room, any_value({weight(LEVELS[len(parent)])})::double AS weight
            FROM leaves GROUP BY {here}
        ), {name}_l AS (
            SELECT *, (given - coalesce(sum(room) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
                      / sum(weight) OVER (o ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
            FROM {name}_n {join} WINDOW o AS ({part}ORDER BY room / weight, {here})
        ), {name} AS (
            SELECT {here}, least(room::double, weight * max(level) OVER ({part})) AS given FROM {name}_l
        )"""

    domains = " ".join(f"WHEN {i} THEN '{d}'" for i, d in enumerate(DOMAIN_OF))
    return f"""
    WITH r AS MATERIALIZED (
        SELECT doc_id, CASE regexp_extract(source, '([0-9]{{1,9}})$', 1) WHEN '' THEN 'other' ELSE
                   CASE regexp_extract(source, '([0-9]{{1,9}})$', 1)::int % 4 {domains} END END AS domain,
               coalesce(lang, 'unknown') AS lang, coalesce(source, 'unknown') AS source,
               len(list_filter(regexp_split_to_array(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'),
                               lambda x: x <> '')) AS n_tokens FROM documents
    ), leaves AS (
        SELECT domain, lang, source, sum(n_tokens)::bigint AS tokens FROM r GROUP BY ALL HAVING sum(n_tokens) > 0
    ), {fill('d', [], '')}, {fill('l', ['domain'], 'd')}, {fill('s', ['domain', 'lang'], 'l')},
    plan AS (
        SELECT domain, lang, source, floor(floor(given + 1e-6) / tokens)::bigint AS whole,
               floor(given + 1e-6) - floor(floor(given + 1e-6) / tokens) * tokens AS rest
        FROM s JOIN leaves USING (domain, lang, source)
    ), ordered AS (
        SELECT r.*, coalesce(whole, 0) AS whole, rest,
               sum(n_tokens) OVER (PARTITION BY domain, lang, source
                   ORDER BY md5({seed} || '-' || coalesce(whole, 0) || '-' || doc_id), n_tokens) AS upto
        FROM r LEFT JOIN plan USING (domain, lang, source)
    )
    SELECT doc_id, domain, lang, source, n_tokens,
           (whole + CASE WHEN rest > 0 AND upto <= rest THEN 1 ELSE 0 END)::int AS copies FROM ordered
    """
