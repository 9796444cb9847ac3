"""Runs a query and its SQL on one folder of tables and compares their rows."""

from __future__ import annotations

import math
from pathlib import Path

import duckdb

FOLDER = "/root/testdata/sf0.001"


def _cell(value):
    if hasattr(value, "as_integer_ratio") and not isinstance(value, (bool, int)):
        value = float(value)
        return None if math.isnan(value) else float(f"{value:.9g}")
    if isinstance(value, (list, tuple)):
        return tuple(map(_cell, value))
    return str(value)[:26] if hasattr(value, "isoformat") else value


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(_cell(r[i]) for i in order) for r in data), key=str)


def compare(spark, query, sql, folder=FOLDER):
    with duckdb.connect() as db:
        db.execute("SET TimeZone = 'UTC'")
        for file in Path(folder).glob("*.parquet"):
            db.execute(f"CREATE VIEW {file.stem} AS SELECT * FROM read_parquet('{file}')")
        found = db.execute(sql)
        names = [c[0] for c in found.description]
        want = rows(names, found.fetchall())
    got = query(spark, folder)
    assert sorted(got.columns) == sorted(names)
    assert rows(got.columns, [tuple(r) for r in got.collect()]) == want
