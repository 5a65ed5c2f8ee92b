"""Queries on surveys that the given tables don't have, against their SQL."""

import math
import time

import duckdb
import numpy as np
import pandas as pd
import pytest

from strataline.operators import fields as P, lines as L
from strataline.queries import ORACLE, QUERIES


def _same_as_sql(spark, folder, name, table):
    con = duckdb.connect()
    con.execute(f"create view {table} as select * from '{folder}/{table}.parquet'")
    want = con.execute(ORACLE[name]).df()
    got = QUERIES[name](spark, str(folder)).toPandas()
    assert sorted(got.columns) == sorted(want.columns) and len(got) == len(want) > 0
    rows = lambda df: sorted((tuple(None if pd.isna(v) else float(v) for v in r) for r in df[sorted(want.columns)].itertuples(index=False)), key=repr)
    for a, b in zip(rows(got), rows(want)):
        assert all(x == y or None not in (x, y) and math.isclose(x, y, rel_tol=2e-6, abs_tol=2e-5) for x, y in zip(a, b)), (a, b)


def _events(folder):
    """Copies of a survey whose clock starts again, stands still or goes back in the middle of a run."""
    n = 1200
    seconds = [(k % 90) * 7.0 if k < 400 else 500.0 if k < 800 else -float(k % 40) * 3 for k in range(n)]
    t = pd.Timestamp("2024-01-01") + pd.to_timedelta(seconds, "s")
    kind = ["error" if k % 37 == 5 else "view" for k in range(n)]
    pd.DataFrame({"event_id": range(n), "user_id": [k // 30 % 2 for k in range(n)], "ts": pd.Series(t).astype("datetime64[us]"), "event_type": kind, "value": [k % 23 * 1.5 for k in range(n)]}).to_parquet(folder / "events.parquet")


@pytest.mark.parametrize("name", ["segment_islands", "run_lengths", "detrend_segment"])
def test_runs_of_a_clock_that_does_not_increase(spark, tmp_path, name):
    _events(tmp_path)
    _same_as_sql(spark, tmp_path, name, "events")


_ODD_EVENTS = {
    "no time": lambda e: e.assign(ts=e["ts"].mask(e.index % 17 == 3)),
    "infinite": lambda e: e.assign(value=e["value"].mask(e.index % 17 == 3, np.inf)),
    "no id": lambda e: e.assign(event_id=e["event_id"].astype("Int64").mask(e.index % 170 == 3)),
    "listed twice": lambda e: pd.concat([e, e[e.index % 7 == 2]]),
}


@pytest.mark.parametrize("change", _ODD_EVENTS)
@pytest.mark.parametrize("name", ["segment_islands", "run_lengths", "detrend_segment"])
def test_runs_of_odd_rows(spark, tmp_path, name, change):
    """Rows without a time or an id, infinite values and ids that occur twice are in the runs that the SQL gives them."""
    _events(tmp_path)
    _ODD_EVENTS[change](pd.read_parquet(tmp_path / "events.parquet")).to_parquet(tmp_path / "events.parquet")
    _same_as_sql(spark, tmp_path, name, "events")


def test_an_axis_must_increase_unless_told(spark):
    df = spark.createDataFrame([(0, 1.0, 5.0), (1, 1.0, 5.0), (2, 1.0, 3.0), (3, 1.0, 9.0)], "row_id long, v double, t double").selectExpr("*", "1 AS line")
    with pytest.raises(Exception, match="does not increase"):
        L.add_segments(df, ["line"], "v", "t", 4.0).collect()
    assert [r["segment"] for r in L.add_segments(df, ["line"], "v", "t", 4.0, increasing=False).orderBy("row_id").collect()] == [1, 1, 1, 2]


@pytest.mark.parametrize("tile", [4, 7, 256])
def test_terrain_with_several_cells_at_a_place(spark, tile):
    """Tiles of any size, places below zero, holes, places twice: every pair within the radius once."""
    z = [(r, c, float((r * 7 + c * 3) % 11 * 40)) for r in range(-9, 10) for c in range(-5, 13) if (r * c) % 5 != 1]
    z += [(r, r, 77.0) for r in range(4)] + [(90, 90, 1.0), (4, 5, None)]
    want = {}
    for r, c, a in z:
        near = [(math.hypot(r - q, c - s) * 25, b) for q, s, b in z if b is not None and 0 < math.hypot(r - q, c - s) <= 3]
        if near and a is not None:
            want[r, c] = want.get((r, c), 0) + sum(1 / d - 1 / math.hypot(d, b - a) for d, b in near) * 6.67430e-6 * 2670 * 625
    cells = spark.createDataFrame(z, "r int, c int, z double").repartition(3)
    got = P.terrain_effect(cells.where("z is not null"), cells, 25.0, 3, 2670.0, tile=tile)
    assert [t for _, t in got.dtypes] == ["int", "int", "double"]
    got = {(r["r"], r["c"]): r["effect"] for r in got.collect()}
    assert got == pytest.approx(want, rel=1e-9) and (90, 90) not in got


def _crowded_part(folder, places, copies):
    i = np.array([n + 33127 * k for k in range(copies) for n in range(places)])  # 33127 = 211 * 157: the same place again
    pd.DataFrame({"p_partkey": i, "p_retailprice": 900 + i % 1013 / 10, "p_size": (i % 50).astype("int32")}).to_parquet(folder / "part.parquet")


SEARCHES = ["paired_flight_difference", "nearest_pair", "repeat_line_quality", "grid_idw"]


@pytest.mark.parametrize("name", SEARCHES)
def test_searches_of_shared_places(spark, tmp_path, name):
    _crowded_part(tmp_path, 150, 8)
    _same_as_sql(spark, tmp_path, name, "part")


@pytest.mark.parametrize("name", SEARCHES)
def test_searches_of_a_crowd(spark, tmp_path, name):
    """Two places of 50,000 points each, 5 apart: thousands of millions of pairs, and one answer for each point."""
    _crowded_part(tmp_path, 2, 50000)
    began = time.time()
    got = QUERIES[name](spark, str(tmp_path)).toPandas()
    assert time.time() - began < 60
    if name == "repeat_line_quality":
        assert sorted(got["line"]) == [1, 2, 3, 4] and list(got["matched"]) == [20000] * 4
    else:
        assert len(got) == got["id"].nunique() == 50000
        assert (got["n_near"] == 6).all() if name == "grid_idw" else (got["distance"] == 0).all()


@pytest.mark.parametrize("name", SEARCHES)
def test_searches_of_rows_listed_twice(spark, tmp_path, name):
    """An id that occurs twice has the answers its SQL gives it."""
    _crowded_part(tmp_path, 150, 3)
    p = pd.read_parquet(tmp_path / "part.parquet")
    pd.concat([p, p[p["p_partkey"] % 3 == 0], p[p["p_partkey"] % 7 == 1]]).to_parquet(tmp_path / "part.parquet")
    _same_as_sql(spark, tmp_path, name, "part")


@pytest.mark.parametrize("name", ["paired_flight_difference", "nearest_pair", "grid_idw"])
def test_searches_broadcast_nothing(spark, tmp_path, name):
    """A file's size, by which Spark chooses, tells little of its rows."""
    _crowded_part(tmp_path, 150, 3)
    plan = QUERIES[name](spark, str(tmp_path))._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "BroadcastExchange" not in plan


def _most_rows(spark, df):
    """Runs it. The most rows that any step of the plan put out."""
    df.write.format("noop").mode("overwrite").save()
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
    store = spark._jsparkSession.sharedState().statusStore()
    run = store.executionsList().last().executionId()
    nodes, seen = store.planGraph(run).allNodes(), store.executionMetrics(run)
    ids = [m.accumulatorId() for k in range(nodes.size()) for n in [nodes.apply(k).metrics()] for m in map(n.apply, range(n.size())) if m.name() == "number of output rows"]
    return max(int(seen.apply(i).replace(",", "")) for i in ids if seen.contains(i))


@pytest.mark.parametrize("name", ["nearest_pair", "grid_idw"])
def test_searches_meet_places_not_rows(spark, tmp_path, name):
    """A thousand rows at each of two places: a million pairs, which no step has."""
    _crowded_part(tmp_path, 2, 1000)
    assert 1000 <= _most_rows(spark, QUERIES[name](spark, str(tmp_path))) <= 20000


@pytest.mark.parametrize("name", ["run_lengths"])
def test_runs_of_copies_with_consecutive_ids(spark, tmp_path, name):
    """Each event six times in a row, under ids of its own, at one time."""
    _events(tmp_path)
    e = pd.read_parquet(tmp_path / "events.parquet")
    e = e.loc[e.index.repeat(6)].reset_index(drop=True)
    e.assign(event_id=e.index).to_parquet(tmp_path / "events.parquet")
    _same_as_sql(spark, tmp_path, name, "events")
