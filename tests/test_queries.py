"""Every query with SQL against DuckDB on the smallest tables; the others (whose kernels other tests hold against plain versions)
have values and the same rows for any number of partitions."""

import math
import os

import duckdb
import pytest

from strataline.queries import ORACLE, QUERIES

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


def _rows(cursor_rows, names):
    order = sorted(range(len(names)), key=lambda k: names[k])
    clean = lambda v: None if v is None or v != v else float(v) if isinstance(v, (int, float)) and not isinstance(v, bool) else v
    return sorted((tuple(clean(r[k]) for k in order) for r in cursor_rows), key=repr)


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_against_sql(spark, duck, name):
    df = QUERIES[name](spark, SF)
    got = _rows(df.collect(), df.columns)
    cur = duck.execute(ORACLE[name])
    names = [d[0] for d in cur.description]
    assert sorted(names) == sorted(df.columns)
    want = _rows(cur.fetchall(), names)
    assert len(got) == len(want)
    for a, b in zip(got, want):
        assert all(x == y or isinstance(x, float) and isinstance(y, float) and abs(x - y) <= 2e-6 * max(1, abs(y)) for x, y in zip(a, b)), (a, b)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE)))
def test_without_sql(spark, name):
    """Rows with values, and the same ones however the work is dealt out."""
    df = QUERIES[name](spark, SF)
    got = _rows(df.collect(), df.columns)
    assert got
    for k, (column, kind) in enumerate(sorted(df.dtypes)):
        assert any(r[k] is not None for r in got), f"{column} has no value"
        if kind == "double":
            assert all(r[k] is None or math.isfinite(r[k]) for r in got), column
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "7")
    try:
        again = QUERIES[name](spark, SF)
        again = _rows(again.collect(), again.columns)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert len(got) == len(again)
    same = lambda x, y: x == y or isinstance(x, float) and isinstance(y, float) and abs(x - y) <= 1e-4 * max(1, abs(y))
    assert all(same(x, y) for a, b in zip(got, again) for x, y in zip(a, b))
