"""Run a registered query and its SQL on the same tables and compare the rows."""

from __future__ import annotations

import math
from pathlib import Path

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def duck(root: str):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        if Path(f"{root}/{t}.parquet").exists():
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{root}/{t}.parquet')")
    return con


def key(value):
    if value is None:
        return (0, "")
    if isinstance(value, float):
        return (1, value) if not math.isnan(value) else (2, "")
    if isinstance(value, (int, bool)):
        return (1, float(value))
    return (3, str(value))


def normalise(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    out = [tuple(row[i] for i in order) for row in rows]
    return [columns[i] for i in order], sorted(out, key=lambda row: [key(v) for v in row])


def difference(spark_df, con, sql: str) -> str | None:
    """None if equal, else a description. Doubles must agree to the last bit: both sides round."""
    got_cols, got = normalise(spark_df.columns, [tuple(row) for row in spark_df.collect()])
    rel = con.sql(sql)
    want_cols, want = normalise(rel.columns, rel.fetchall())
    if got_cols != want_cols:
        return f"columns {got_cols} != {want_cols}"
    if len(got) != len(want):
        return f"rows {len(got)} != {len(want)}"
    kinds = dict(zip(rel.columns, [str(t) for t in rel.types]))
    spark_kinds = dict(spark_df.dtypes)
    names = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "date": "DATE", "boolean": "BOOLEAN"}
    for c in got_cols:
        if names.get(spark_kinds[c]) != kinds[c]:
            return f"type of {c}: {spark_kinds[c]} != {kinds[c]}"
    bad = [(g, w) for g, w in zip(got, want) if g != w]
    if bad:
        return f"{len(bad)} of {len(got)} rows differ, e.g. {got_cols}: {bad[:3]}"
    return None
