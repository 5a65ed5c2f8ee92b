"""Collects queries and their SQL, and the views that bind survey concepts to the tables.

A view's SQL runs in both engines; ``$t`` is a timestamp's seconds, which they write
differently.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}

VIEWS = {
    # a survey: dense row ids in acquisition order, lines that come back, sensors, a trajectory
    "survey": """SELECT event_id AS row_id, CAST(floor(event_id / 250e0) % 9 AS INT) AS line, CAST(user_id % 2 AS INT) AS sensor,
        $t AS t, CASE WHEN event_type = 'error' THEN NULL ELSE value END AS v, value AS raw,
        CAST(event_id % 97 AS DOUBLE) * 10e0 AS x, CAST(user_id AS DOUBLE) * 25e0 AS y, event_type AS kind FROM events""",
    # one flight per user: true time order within it
    "flights": """SELECT event_id AS row_id, user_id AS line, $t AS t, value AS v, CAST(event_id % 97 AS DOUBLE) * 10e0 AS x,
        value * 7e0 AS y, CAST(event_id % 41 AS DOUBLE) * 10e0 AS clearance FROM events""",
    # stations with three channels and a position
    "stations": """SELECT p_partkey AS id, CAST(p_partkey % 181 AS DOUBLE) - 90e0 AS lat, CAST(p_size AS DOUBLE) * 10e0 - 100e0 AS h,
        978000e0 + p_retailprice AS g, CAST(p_size AS DOUBLE) / 10e0 AS k, p_retailprice / 500e0 AS u, CAST(p_partkey % 50 AS DOUBLE) / 5e0 AS th,
        CAST(p_partkey % 360 AS DOUBLE) AS az, CAST(p_partkey % 37 AS DOUBLE) - 18e0 AS ve, CAST(p_partkey % 23 AS DOUBLE) - 11e0 AS vn,
        CAST(p_partkey % 300 AS DOUBLE) / 1000e0 AS wave, CAST(p_partkey % 17 AS DOUBLE) / 100e0 - 8e-2 AS ke, CAST(p_partkey % 19 AS DOUBLE) / 100e0 - 9e-2 AS kn FROM part""",
    # a lattice, 50 columns wide
    "cells": """SELECT CAST(floor(p_partkey / 50e0) AS INT) AS r, CAST(p_partkey % 50 AS INT) AS c,
        CASE WHEN p_partkey % 83 = 5 THEN NULL ELSE p_retailprice + CAST(p_size AS DOUBLE) * 3e0 END AS z, CAST(p_size AS DOUBLE) AS z2 FROM part""",
    "points": "SELECT p_partkey AS id, CAST(p_partkey % 211 AS DOUBLE) * 3e0 AS x, CAST(p_partkey % 157 AS DOUBLE) * 4e0 AS y, p_retailprice AS v, CAST(p_size AS DOUBLE) AS s FROM part",
    "quads": """SELECT CAST(l_suppkey % 7 AS INT) AS a, CAST(l_suppkey % 5 + 7 AS INT) AS b, CAST(l_partkey % 6 + 12 AS INT) AS m, CAST(l_linenumber + 17 AS INT) AS n,
        l_quantity AS resistance FROM lineitem UNION ALL SELECT CAST(l_partkey % 6 + 12 AS INT), CAST(l_linenumber + 17 AS INT), CAST(l_suppkey % 7 AS INT),
        CAST(l_suppkey % 5 + 7 AS INT), l_quantity * (1e0 + l_discount) FROM lineitem WHERE l_tax > 2e-2""",
    "crossings": "SELECT l_orderkey AS o, CAST(l_suppkey AS INT) AS traverse, CAST(l_partkey % 7 AS INT) AS tie, l_quantity - 25e0 AS residual FROM lineitem",
}
_SPARK_T = "unix_micros(CAST(ts AS TIMESTAMP)) / 1e6"
_DUCK_T = "epoch_us(ts) / 1e6"
TABLES = "region nation customer supplier part orders lineitem events embeddings".split()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    sql = VIEWS[name].replace("$t", _SPARK_T)
    used = {t: table(spark, sf_dir, t) for t in TABLES if re.search(rf"FROM {t}\b", sql)}
    for t in used:
        sql = re.sub(rf"FROM {t}\b", f"FROM {{{t}}}", sql)
    return spark.sql(sql, **used)


def duck(sql: str) -> str:
    """Puts the views that a SQL text names in front of it."""
    sql = re.sub(r", (\d)\) AS (?!BIGINT|INT\b|DOUBLE)", r", \1) + 0e0 AS ", sql)  # a rounded -0.0 is 0.0, as in Spark
    names = [n for n in VIEWS if re.search(rf"\b{n}\b", sql)]
    ctes = [f"{n} AS ({VIEWS[n].replace('$t', _DUCK_T)})" for n in names]
    if not ctes:
        return sql
    rest = re.sub(r"^\s*WITH\s+", ", ", sql, count=1, flags=re.I)
    return "WITH " + ", ".join(ctes) + (rest if rest != sql else " " + sql)


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles rounded; NaN and infinities as null."""
    return df.select([F.round(F.when(~F.isnan(c) & (F.abs(c) < float("inf")), F.col(c)), digits).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


def query(name: str, sql: str | None = None, *, digits: int = 6):
    """Registers ``f(spark, sf_dir)``; its doubles are rounded, and the SQL rounds its own."""

    def add(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[name] = lambda spark, sf_dir: rounded(f(spark, sf_dir), digits)
        if sql is not None:
            ORACLE[name] = duck(sql)
        return f

    return add


def scalar(name: str, of: str, key: str, columns: dict[str, tuple[Column | Callable[[], Column], str]]) -> None:
    """A query of row-wise expressions, each with its SQL."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return view(spark, sf_dir, of).select(key, *[(e() if callable(e) else e).cast("double").alias(c) for c, (e, _) in columns.items()])

    QUERIES[name] = lambda spark, sf_dir: rounded(run(spark, sf_dir))
    ORACLE[name] = duck(f"SELECT {key}, " + ", ".join(f"round(CAST({sql} AS DOUBLE), 6) AS {c}" for c, (_, sql) in columns.items()) + f" FROM {of}")
