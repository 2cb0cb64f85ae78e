"""Connected components: union-find inside partitions, star contraction between them."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from annalist.llm.common import materialise

_ARROW = pa.schema([("u", pa.int64()), ("v", pa.int64())])


def _local_union_find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Edges of a partition to a forest of stars (node, smaller root) that joins the same nodes."""
    parent: dict[int, int] = {}

    def find(x: int) -> int:
        root = x
        while (up := parent.setdefault(root, root)) != root:
            root = up
        while parent[x] != root:
            parent[x], x = root, parent[x]
        return root

    for batch in batches:
        for u, v in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            a, b = find(u), find(v)
            if a != b:
                parent[max(a, b)] = min(a, b)
    nodes = [x for x in parent if find(x) != x]
    if nodes:
        roots = np.array([parent[x] for x in nodes], dtype=np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array(roots)], schema=_ARROW)


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of ``edges`` (u, v) but the roots; a root is its component's smallest node.

    Each round contracts what every partition holds by union-find, then lets
    nodes adopt the smallest neighbour (large star, small star); it ends when
    the edges are stars already.  Partitions hold edges, never whole groups.
    """
    stars = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).filter("u <> v")
    stars = materialise(stars.mapInArrow(_local_union_find, "u long, v long"), "edges")
    while True:
        both = stars.unionByName(stars.select(F.col("v").alias("u"), F.col("u").alias("v")))
        # written, so that both sides of the joins come by shuffles of their own and a hot node can be split
        least = materialise(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")), "least")
        large = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = materialise(large, "large")
        down = materialise(large.groupBy("u").agg(F.min("v").alias("m")), "down")
        small = (
            large.join(down, "u")
            .select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e"))
            .select("e.*")
            .filter("u <> v")
            .distinct()
        )
        stars = materialise(small.mapInArrow(_local_union_find, "u long, v long").distinct(), "edges")
        # stars: no node has two roots, and no root is a node
        ends = stars.select("u", F.lit(1).alias("ups"), F.lit(0).alias("root")).unionByName(
            stars.select(F.col("v").alias("u"), F.lit(0).alias("ups"), F.lit(1).alias("root"))
        )
        uses = ends.groupBy("u").agg(F.sum("ups").alias("ups"), F.max("root").alias("root"))
        if uses.filter("ups > 1 OR (ups = 1 AND root = 1)").isEmpty():
            return stars.select(F.col("u").alias("node"), F.col("v").alias("root"))
