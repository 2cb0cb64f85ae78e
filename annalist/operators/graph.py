"""Cross references and the provenance graph; all set-at-a-time joins on node keys."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from annalist.functions import ids
from annalist.functions import text as X
from annalist.sources import sinks

EDGE = ["source_type", "source_id", "target_type", "target_id", "relation"]


def _link(source_type: str, source: Column, target_type: str, target: Column, relation: str) -> list[Column]:
    parts = [F.lit(source_type), source.cast("string"), F.lit(target_type), target.cast("string"), F.lit(relation)]
    return [ids.link_key(*parts).alias("link_id"), *[p.alias(n) for p, n in zip(parts, EDGE, strict=True)]]


def pr_issue_links(prs: DataFrame, issues: DataFrame) -> DataFrame:
    """A link for every issue number that a pull request's body or title names, once."""
    named = prs.select("number", F.explode(X.references(F.col("body"), F.col("title"))).alias("issue"))
    known = issues.select(F.col("number").cast("long").alias("issue")).distinct()
    return named.join(known, "issue").select(*_link("pr", F.col("number"), "issue", F.col("issue"), "mentions"))


def merge_links(commits: DataFrame, prs: DataFrame, order: Column | None = None) -> DataFrame:
    """A link from each merge commit to its pull request; of several with one sha the last by ``order``."""
    last = (
        prs.filter("merge_commit_sha IS NOT NULL")
        .groupBy("merge_commit_sha")
        .agg(F.max_by("number", F.col("number") if order is None else order).alias("number"))
    )
    both = commits.select("sha").join(last, F.col("sha") == F.col("merge_commit_sha"))
    return both.select(*_link("commit", F.col("sha"), "pr", F.col("number"), "merge_commit"))


def parsed_issue_edges(prs: DataFrame, issues: DataFrame) -> DataFrame:
    """Edges of parsed pull requests to the issues they name and that exist."""
    named = prs.select("number", F.explode("linked_issue_numbers").alias("issue"))
    known = issues.select(F.col("number").cast("long").alias("issue"))
    return named.join(known, "issue", "left_semi").select(*_link("pr", F.col("number"), "issue", F.col("issue"), "mentions")[1:])


def parent_edges(commits: DataFrame) -> DataFrame:
    """Edges to parents, of commits that name one."""
    return commits.filter("parent_sha IS NOT NULL").select(*_link("commit", F.col("sha"), "commit", F.col("parent_sha"), "parent")[1:])


def edges(*parts: DataFrame) -> DataFrame:
    """Union of edges or links, each edge once."""
    return reduce(DataFrame.unionByName, [p.select(*EDGE) for p in parts]).dropDuplicates(EDGE)


#: Rows up to this many go to the edges or chunks, which then stay in place.
BROADCAST_ROWS = 500_000


def _few(rows: DataFrame, write: bool = True) -> DataFrame:
    """``rows``, written and counted, with the hint to send them where they are few."""
    rows = sinks.written(rows, "few") if write else rows
    return F.broadcast(rows) if rows.count() <= BROADCAST_ROWS else rows


def _directed(graph: DataFrame, direction: str, relation: str | None) -> DataFrame:
    rows = graph if relation is None else graph.filter(F.col("relation") == relation)
    out = rows.select(
        F.col("source_type").alias("from_type"), F.col("source_id").alias("from_id"), F.col("target_type").alias("type"),
        F.col("target_id").alias("id"), "relation", F.lit("out").alias("direction"),
    )
    back = rows.select(
        F.col("target_type").alias("from_type"), F.col("target_id").alias("from_id"), F.col("source_type").alias("type"),
        F.col("source_id").alias("id"), "relation", F.lit("in").alias("direction"),
    )
    return {"out": out, "in": back, "both": out.unionByName(back)}[direction]


def neighbours(graph: DataFrame, nodes: DataFrame, relation: str | None = None, direction: str = "both") -> DataFrame:
    """(seed_type, seed_id, type, id, relation, direction); ``nodes`` has seed_type and seed_id."""
    steps = _directed(graph, direction, relation)
    return steps.join(nodes, (F.col("from_type") == F.col("seed_type")) & (F.col("from_id") == F.col("seed_id"))).select(
        "seed_type", "seed_id", "type", "id", "relation", "direction"
    )


def expand(graph: DataFrame, nodes: DataFrame, hops: int = 1, relation: str | None = None) -> DataFrame:
    """(seed_type, seed_id, type, id, depth): what each seed reaches in ``hops`` steps, at its least depth, itself excluded."""
    steps = _directed(graph, "both", relation).select("from_type", "from_id", "type", "id")
    seed = ["seed_type", "seed_id"]
    nodes = _few(nodes.select(*seed).distinct())
    kinds = nodes.select(F.col("seed_type").alias("from_type")).distinct()
    reached = nodes.withColumns({"type": F.col("seed_type"), "id": F.col("seed_id"), "depth": F.lit(0)})
    front = reached
    for depth in range(1, hops + 1):
        moved = front.select(*seed, F.col("type").alias("from_type"), F.col("id").alias("from_id"))
        some = steps.join(F.broadcast(kinds), "from_type", "left_semi") if depth == 1 else steps
        front = (
            moved.join(some, ["from_type", "from_id"])
            .select(*seed, "type", "id")
            .distinct()
            .join(reached.select(*seed, "type", "id"), [*seed, "type", "id"], "left_anti")
            .withColumn("depth", F.lit(depth))
        )
        reached = reached.unionByName(front)
    return reached.filter("depth > 0")


def expand_counts(graph: DataFrame, nodes: DataFrame, hops: int = 1, relation: str | None = None) -> DataFrame:
    """(type, depth, n, seeds): rows and distinct seeds of ``expand``, by type and depth, without the rows of the last step.

    What a seed reaches last is the union of the neighbours, of one type, of the
    nodes before.  Nodes whose neighbours of that type it all has already add
    nothing; seeds with the same other nodes have the same union, which is made
    once (a hub's neighbours are counted, not listed seed by seed), less those
    that the seed has already.
    """
    seed, node, at = ["seed_type", "seed_id"], ["type", "id"], ["from_type", "from_id"]
    start = sinks.written(nodes.select(*seed).distinct().withColumns({"type": F.col("seed_type"), "id": F.col("seed_id"), "depth": F.lit(0)}), "start")
    inner = sinks.written(expand(graph, nodes, hops - 1, relation), "inner") if hops > 1 else start
    reached = start.unionByName(inner) if hops > 1 else start
    had = reached.select(*seed, *node)
    front = inner.filter(F.col("depth") == hops - 1).select(*seed, F.col("type").alias("from_type"), F.col("id").alias("from_id"))

    # the front's edges, once each, and how many lead to each type
    steps = _directed(graph, "both", relation).select(*at, *node).join(F.broadcast(front.select("from_type").distinct()), "from_type", "left_semi")
    mine = sinks.written(steps.join(front.select(*at).distinct(), at, "left_semi").distinct().select(*at, *node), "front_steps")
    whole = sinks.written(mine.groupBy(*at, "type").agg(F.count(F.lit(1)).alias("n")), "degrees")
    degree = whole.groupBy(*at).agg(F.sum("n").alias("degree"))
    size = had.groupBy(*seed).agg(F.count(F.lit(1)).alias("size"))
    sized = sinks.written(front.join(degree, at).join(size, seed), "front")

    # edges back to what a seed has: sought among the node's neighbours, or among what the seed has, whichever are fewer
    kinds = F.broadcast(had.select("type").distinct())
    likely = mine.join(kinds, "type", "left_semi")
    few, heavy = sized.filter("degree <= size").select(*seed, *at), sized.filter("degree > size").select(*seed, *at)
    big = likely.join(heavy.select(*at).distinct(), at, "left_semi")
    by_node = few.join(likely, at).select(*seed, *at, *node).join(had, [*seed, *node], "left_semi")
    by_seed = heavy.join(had, seed).select(*seed, *at, *node).join(big, [*at, *node], "left_semi")
    back = sinks.written(by_node.select(*seed, *at, *node).unionByName(by_seed.select(*seed, *at, *node)), "back")

    # per seed and type, the nodes that lead to something new
    known = back.groupBy(*seed, *at, "type").agg(F.count(F.lit(1)).alias("known"))
    leads = front.join(whole, at).join(known, [*seed, *at, "type"], "left").withColumn("more", F.col("n") - F.coalesce("known", F.lit(0))).filter("more > 0")
    ways = leads.groupBy(*seed, "type").agg(
        F.count(F.lit(1)).alias("ways"), F.min("more").alias("n"), F.sort_array(F.collect_list(F.struct(*at))).alias("nodes")
    )
    ways = sinks.written(ways, "ways")

    # one such node: its count; several: their union, made once for the seeds that share it, less what a seed has
    one = ways.filter("ways = 1").select(*seed, "type", "n")
    many = ways.filter("ways > 1").select(*seed, "type", "nodes")
    shared = sinks.written(many.groupBy("type", "nodes").agg(F.min(F.struct(*seed)).alias("first")), "shared")
    union = (
        shared.select("type", "first", F.explode("nodes").alias("m")).select("type", "first", "m.*")
        .join(mine, [*at, "type"]).select("first", *node).distinct().groupBy("type", "first").agg(F.count(F.lit(1)).alias("n"))
    )
    less = (
        many.select(*seed, "type", F.explode("nodes").alias("m")).select(*seed, "type", "m.*")
        .join(back, [*seed, *at, "type"]).select(*seed, *node).distinct().groupBy(*seed, "type").agg(F.count(F.lit(1)).alias("less"))
    )
    several = (
        many.join(shared, ["type", "nodes"]).drop("nodes").join(union, ["type", "first"]).join(less, [*seed, "type"], "left")
        .select(*seed, "type", (F.col("n") - F.coalesce("less", F.lit(0))).alias("n"))
    )

    def counted(rows: DataFrame, depth: Column) -> DataFrame:
        return rows.groupBy("type", depth.alias("depth")).agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("seeds"))

    last = counted(one.unionByName(several).filter("n > 0"), F.lit(hops))
    if hops == 1:
        return last
    return counted(inner.groupBy(*seed, "type", "depth").agg(F.count(F.lit(1)).alias("n")), F.col("depth")).unionByName(last)


def expand_candidates(candidates: DataFrame, chunks: DataFrame, graph: DataFrame, hops: int = 1) -> DataFrame:
    """Candidates (query_id, rank, chunk_id, score, source) and, after them, all chunks of their nodes' neighbours.

    A chunk's node is its (node type, doc_id).  Added chunks have score 0 and
    source 'graph', and follow in order of the candidate that led to them.
    """
    # a type that holds an underscore itself: whatever stands before the document's id
    full = chunks.select("chunk_id", "graph_node_id", F.col("doc_id").alias("node_id")).withColumn(
        "node_type", F.expr("substring(graph_node_id, 1, length(graph_node_id) - length(node_id) - 1)")
    )
    nodes = full.select("chunk_id", "node_type", "node_id")
    placed = sinks.written(_few(candidates.select("query_id", "rank", "chunk_id")).join(nodes, "chunk_id"), "placed")
    seeds = placed.select(F.col("node_type").alias("seed_type"), F.col("node_id").alias("seed_id")).distinct()
    reach = expand(graph, seeds, hops)
    via = (
        placed.join(reach, (F.col("node_type") == F.col("seed_type")) & (F.col("node_id") == F.col("seed_id")))
        .groupBy("query_id", F.col("type").alias("node_type"), F.col("id").alias("node_id"))
        .agg(F.min("rank").alias("via"))
    )
    added = (
        _few(via).join(nodes, ["node_type", "node_id"])
        .groupBy("query_id", "chunk_id")
        .agg(F.min("via").alias("via"))
        .join(candidates.select("query_id", "chunk_id"), ["query_id", "chunk_id"], "left_anti")
    )
    last = candidates.groupBy("query_id").agg(F.max("rank").alias("last"))
    order = Window.partitionBy("query_id").orderBy("via", "chunk_id")
    tail = added.join(last, "query_id").select(
        "query_id",
        (F.col("last") + F.row_number().over(order)).cast("int").alias("rank"),
        "chunk_id",
        F.lit(0.0).alias("score"),
        F.lit("graph").alias("source"),
    )
    return candidates.select("query_id", "rank", "chunk_id", "score", "source").unionByName(tail)
