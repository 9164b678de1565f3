"""Rows of a Spark result and of its SQL twin, in one form."""

from __future__ import annotations

import datetime
import decimal

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def plain(value):
    if isinstance(value, (datetime.datetime, datetime.date)):
        return str(value)[:10] if str(value)[10:] in ("", " 00:00:00") else str(value)
    if isinstance(value, bool) or value is None:
        return str(value)
    if isinstance(value, (int, float, decimal.Decimal)):
        return repr(round(float(value), 7) + 0.0) if value == value else "None"
    return str(value)


def rows(names: list[str], data) -> list[tuple]:
    order = sorted(range(len(names)), key=names.__getitem__)
    return sorted(tuple(plain(r[i]) for i in order) for r in data)


def same(spark_df, con: duckdb.DuckDBPyConnection, sql: str) -> None:
    got = rows(spark_df.columns, spark_df.collect())
    found = con.execute(sql)
    names = [d[0] for d in found.description]
    assert sorted(names) == sorted(spark_df.columns)
    want = rows(names, found.fetchall())
    if got != want:
        ours, theirs = set(got), set(want)
        raise AssertionError((len(got), len(want), [x for x in got if x not in theirs][:2], [x for x in want if x not in ours][:2]))
