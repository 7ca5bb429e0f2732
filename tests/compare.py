"""Run a registered query and its SQL counterpart and compare them as row sets."""

from __future__ import annotations

import glob
import math
import os

import duckdb


def duck(sf_dir):
    connection = duckdb.connect()
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        name = os.path.basename(path).removesuffix(".parquet")
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{path}'")
    return connection


def _norm(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else round(value, 6) + 0.0
    return value


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted([tuple(_norm(row[i]) for i in order) for row in rows], key=repr)


def differences(spark, connection, query, sql, sf_dir):
    df = query(spark, sf_dir)
    got = rows_of(df.columns, df.collect())
    cursor = connection.execute(sql)
    columns = [item[0] for item in cursor.description]
    want = rows_of(columns, cursor.fetchall())
    if sorted(df.columns) != sorted(columns):
        return f"columns {sorted(df.columns)} against {sorted(columns)}"
    if len(got) != len(want):
        return f"{len(got)} rows against {len(want)}: {[r for r in got if r not in set(want)][:2]} / {[r for r in want if r not in set(got)][:2]}"
    if not got:
        return "no rows"
    wrong = [(a, b) for a, b in zip(got, want) if a != b]
    return f"{len(wrong)} rows differ, first: {wrong[0]}" if wrong else ""
