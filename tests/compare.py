"""Comparison of a Spark query with its SQL on the same Parquet tables, as multisets of rows with columns by name."""

from __future__ import annotations

import math
from pathlib import Path

import duckdb
from pyspark.sql import DataFrame

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def sql_rows(sql: str, sf_dir: str) -> tuple[list[str], list[tuple]]:
    with duckdb.connect() as con:
        for t in TABLES:
            at = Path(f"{sf_dir}/{t}.parquet")
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{at}{'/*.parquet' if at.is_dir() else ''}'")
        got = con.execute(sql)
        names = [x[0] for x in got.description]
        return names, got.fetchall()


def plain(value):
    if value is None:
        return None
    if isinstance(value, float):
        return None if math.isnan(value) else round(value, 6) + 0.0
    return value


def same(df: DataFrame, sql: str, sf_dir: str) -> str:
    """Empty if equal, else what differs."""
    names, rows = sql_rows(sql, sf_dir)
    if sorted(names) != sorted(df.columns):
        return f"columns {sorted(df.columns)} and {sorted(names)}"
    order = sorted(names)
    own = sorted((tuple(plain(r[c]) for c in order) for r in df.collect()), key=repr)
    other = sorted((tuple(plain(r[names.index(c)]) for c in order) for r in rows), key=repr)
    if len(own) != len(other):
        return f"{len(own)} and {len(other)} rows; e.g. {[x for x in own if x not in set(other)][:2]} and {[x for x in other if x not in set(own)][:2]}"
    bad = [(a, b) for a, b in zip(own, other, strict=True) if a != b and not all(x == y or isinstance(x, (int, float)) and isinstance(y, (int, float)) and abs(x - y) <= 2e-6 * max(1, abs(y)) for x, y in zip(a, b, strict=True))]
    return f"{len(bad)} rows: {order} {bad[0]}" if bad else ""
