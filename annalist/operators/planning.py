"""Question plans from the question's wording."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from annalist.functions import text as X

PLAN_SCHEMA = "entities ARRAY<STRING>, time_start STRING, time_end STRING, intent STRING, sub_queries ARRAY<STRING>"


def plan(queries: DataFrame, model_json: str | None = None) -> DataFrame:
    """``queries`` (query_id, query) plus entities, time_start, time_end, intent, sub_queries.

    Years give the bounds (the first and the last as written), quoted phrases
    the entities.  ``model_json`` names a column with a model's plan as JSON,
    which takes precedence where it parses.
    """
    found = X.years(F.col("query"))
    rows = queries.withColumns(
        {
            "entities": X.quoted(F.col("query")),
            "time_start": F.concat(F.get(found, 0), F.lit("-01-01")),
            "time_end": F.concat(F.try_element_at(found, F.lit(-1)), F.lit("-12-31")),
            "intent": F.lit("general"),
            "sub_queries": F.array("query"),
        }
    )
    if model_json is None:
        return rows
    own = rows.withColumn("_plan_", F.from_json(model_json, PLAN_SCHEMA))
    usable = F.coalesce(F.trim(F.col(model_json)).startswith("{"), F.lit(False)) & F.col("_plan_").isNotNull()
    empty = F.array().cast("array<string>")
    defaults = {"entities": empty, "intent": F.lit("general"), "sub_queries": empty}
    picked = {
        c: F.when(usable, F.coalesce(F.col(f"_plan_.{c}"), defaults.get(c, F.lit(None)))).otherwise(F.col(c))
        for c in ("entities", "time_start", "time_end", "intent", "sub_queries")
    }
    return own.withColumns(picked).drop("_plan_")


def search_terms(queries: DataFrame) -> DataFrame:
    """(query_id, position, term): quoted phrases, or else the words of the question."""
    phrases = X.quoted(F.col("query"))
    words = F.filter(F.split("query", r"\s+"), lambda w: w != "")
    return queries.select("query_id", F.posexplode(F.when(F.size(phrases) > 0, phrases).otherwise(words)).alias("position", "term"))
