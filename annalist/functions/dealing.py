"""Tasks of a bounded size, whatever the input's."""

from __future__ import annotations

from pyspark.sql import DataFrame

#: Rows of two or three short columns that a task gets.
ROWS = 500_000


def dealt(rows: DataFrame, *keys: str, each: int = ROWS) -> DataFrame:
    """``rows`` dealt out, by ``keys`` if given, to as many tasks as it takes for ``each`` rows a task; rows are counted first."""
    return rows.repartition(max(1, -(-rows.count() // each)), *keys)
