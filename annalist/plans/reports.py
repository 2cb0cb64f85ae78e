"""Figures for the ownership and risk reports, computed rather than guessed (beyond the original's prompts)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _changes(commits: DataFrame) -> DataFrame:
    return commits.select("sha", "author", "timestamp", F.explode(F.array_distinct("file_paths")).alias("path"))


def ownership(commits: DataFrame) -> DataFrame:
    """(path, author, month, commits)"""
    month = F.date_format("timestamp", "yyyy-MM").alias("month")
    return _changes(commits).groupBy("path", "author", month).agg(F.count_distinct("sha").alias("commits"))


def churn(commits: DataFrame) -> DataFrame:
    """(path, commits, authors, first, last)"""
    return _changes(commits).groupBy("path").agg(
        F.count_distinct("sha").alias("commits"), F.count_distinct("author").alias("authors"),
        F.min("timestamp").alias("first"), F.max("timestamp").alias("last"),
    )


def co_changes(commits: DataFrame, most_paths: int | None = None) -> DataFrame:
    """(a, b, commits) of paths changed together.

    A caller may leave out commits of more than ``most_paths`` paths, which say
    little about pairs; by default all count.  A commit's pairs are made path by
    path, never as one list.
    """
    some = commits.select(F.array_sort(F.array_distinct("file_paths")).alias("p")).filter(F.size("p") > 1)
    if most_paths is not None:
        some = some.filter(F.size("p") <= most_paths)
    first = some.select("p", F.posexplode("p").alias("i", "a"))
    pairs = first.select("a", F.explode(F.slice("p", F.col("i") + 2, F.size("p"))).alias("b"))
    return pairs.groupBy("a", "b").agg(F.count(F.lit(1)).alias("commits"))
