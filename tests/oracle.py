"""A query's rows beside those of its SQL in DuckDB."""

import math
import os
from pathlib import Path

DATA = Path(os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001"))


def cell(value):
    if value is None or (isinstance(value, float) and math.isnan(value)):
        return "null"
    if isinstance(value, bool):
        return str(value)
    if isinstance(value, (int, float)):
        return f"{float(value):.6f}"
    return str(value)


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted(tuple(cell(r[i]) for i in order) for r in rows)


def assert_same(spark, query, sql):
    import duckdb

    db = duckdb.connect()
    for path in sorted(DATA.glob("*.parquet")):
        files = f"{path}/*.parquet" if path.is_dir() else str(path)
        db.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM read_parquet('{files}')")
    got = query(spark, str(DATA))
    cursor = db.cursor()
    cursor.execute(sql)
    want = rows_of([d[0] for d in cursor.description], cursor.fetchall())
    assert rows_of(got.columns, got.collect()) == want
