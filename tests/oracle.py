"""Runs a query and its SQL statement side by side and compares the results."""

from __future__ import annotations

import math

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def _cell(v):
    if v is None:
        return "<null>"
    if isinstance(v, bool):
        return str(v)
    if isinstance(v, float):
        return "nan" if math.isnan(v) else f"{v:.6f}"
    return str(v)


def rows_of(columns: list[str], rows) -> tuple[list[str], list[tuple]]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted(tuple(_cell(r[i]) for i in order) for r in rows)


KINDS = {
    "bigint": "BIGINT", "string": "VARCHAR", "double": "DOUBLE", "boolean": "BOOLEAN", "int": "INTEGER", "date": "DATE",
}


def compare(df, con, sql: str) -> str | None:
    """None when equal, else what differs."""
    spark_cols, spark_rows = rows_of(df.columns, [tuple(r) for r in df.collect()])
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    duck_types = {d[0]: str(d[1]) for d in cur.description}
    duck_cols, duck_rows = rows_of(names, cur.fetchall())
    if spark_cols != duck_cols:
        return f"columns {spark_cols} vs {duck_cols}"
    if len(spark_rows) != len(duck_rows):
        only_s = sorted(set(spark_rows) - set(duck_rows))[:2]
        only_d = sorted(set(duck_rows) - set(spark_rows))[:2]
        return f"rows {len(spark_rows)} vs {len(duck_rows)}: spark only {only_s}, sql only {only_d}"
    for s, d in zip(spark_rows, duck_rows):
        if s != d:
            return f"first difference\n  spark {s}\n  sql   {d}"
    spark_types = {c: KINDS.get(t, t) for c, t in df.dtypes}
    odd = {c: (t, duck_types[c]) for c, t in spark_types.items() if t != duck_types[c]}
    return f"types {odd}" if odd else None
