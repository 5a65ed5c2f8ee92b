"""Surveys with many rows at one place: pairs are met by place, never row by row, and none is lost."""

import math
import time

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from strataline.operators import joins as J, kernels as K
from strataline.queries import QUERIES, shapes


def _odd_points(n=300):
    """Shared places, ids that occur twice, and rows without a value, a place or an id."""
    i = np.arange(n)
    p = [(int(k) if k % 29 else None, float(k % 7 * 4), float(k % 5 * 3), float(k % 31) if k % 11 else None) for k in i]
    p += [(int(k), float(k % 6 * 5), 2.0, float(k)) for k in range(1, 40)]
    return p + [(901, math.nan, 1.0, 5.0), (902, math.inf, 1.0, 5.0), (903, None, 1.0, 5.0), (904, 1.0, math.nan, 5.0)]


def _crowd(spark, rows):
    return spark.range(rows).select("id", (F.col("id") % 3 * 4).cast("double").alias("x"), F.lit(0.0).alias("y"), (F.col("id") % 7).cast("double").alias("v"))


def test_variogram_has_every_pair_of_odd_points(spark):
    p = _odd_points()
    want = {}
    for a, x, y, v in p:
        for b, x2, y2, v2 in p:
            if None in (a, b, x, x2) or not a < b or not (h := math.hypot(x - x2, y - y2)) <= 12:
                continue
            bin_ = want.setdefault(min(int(h // 3), 3), ([], []))
            bin_[0].append(h)
            if v is not None and v2 is not None:
                bin_[1].append((v - v2) ** 2 / 2)
    got = J.variogram(spark.createDataFrame(p, "id long, x double, y double, v double").repartition(5), "id", "x", "y", "v", 3.0, 4).collect()
    assert len(got) == len(want) == 4
    for r in got:
        h, g = want[r["lag"]]
        assert (r["pairs"], r["mean_distance"], r["semivariance"]) == (len(h), pytest.approx(np.mean(h)), pytest.approx(np.mean(g)))


def test_variogram_of_a_crowd(spark):
    """Two thousand million pairs at three places."""
    began = time.time()
    got = {r["lag"]: r for r in J.variogram(_crowd(spark, 63000), "id", "x", "y", "v", 4.0, 3).collect()}
    assert time.time() - began < 60
    n = 21000
    assert {k: r["pairs"] for k, r in got.items()} == {0: 3 * n * (n - 1) // 2, 1: 2 * n * n, 2: n * n}
    assert got[1]["semivariance"] == pytest.approx(4.0) and got[2]["mean_distance"] == 8.0  # every place has each value 0 to 6 equally often


@pytest.mark.parametrize("k", [1, 4, 9])
def test_neighbours_of_odd_points(spark, k):
    p = [r for r in _odd_points() if r[0] is not None]
    left, right = [r for r in p if r[0] % 3 == 0], [r for r in p if r[0] % 3]
    want = []
    for i in {r[0] for r in left}:
        near = [(math.hypot(x - x2, y - y2), b) for a, x, y, _ in left if a == i and x is not None for b, x2, y2, _ in right if x2 is not None]
        want += [(i, n + 1, b, d) for n, (d, b) in enumerate(sorted(q for q in near if q[0] <= 9)[:k])]
    schema = "id long, x double, y double, v double"
    a, b = spark.createDataFrame(left, schema).repartition(3), spark.createDataFrame(right, schema).withColumnRenamed("id", "other")
    got = J.neighbours(a, b, "x", "y", "other", 9.0, k, left_id="id", carry=["v"])
    assert got.columns == ["id", "other", "distance", "rank", "v"]
    assert sorted((r["id"], r["rank"], r["other"], r["distance"]) for r in got.collect()) == sorted(want)


def test_neighbours_further_than_the_first_look(spark):
    """Few rows near, the rest as far as the radius; ties between places go by id."""
    left = spark.createDataFrame([(0, 0.0, 0.0), (1, 100.0, 0.0), (2, 500.0, 0.0)], "id long, x double, y double")
    right = spark.createDataFrame([(7, 0.0, 1.0), (5, 40.0, 0.0), (4, 0.0, 40.0), (9, 0.0, 40.0), (6, 100.0, 40.1)], "other long, x double, y double")
    got = J.neighbours(left, right, "x", "y", "other", 40.0, 3, left_id="id").collect()
    assert sorted((r["id"], r["rank"], r["other"], r["distance"]) for r in got) == [(0, 1, 7, 1.0), (0, 2, 4, 40.0), (0, 3, 5, 40.0)]


def test_neighbours_of_a_crowd(spark):
    """Every one of 60,000 rows has 60,000 within the radius."""
    p = _crowd(spark, 120000)
    began = time.time()
    got = J.neighbours(p.where("id % 2 = 0"), p.where("id % 2 = 1").withColumnRenamed("id", "other"), "x", "y", "other", 40.0, 4, left_id="id", carry=["v"])
    row = got.agg(F.count("*").alias("n"), F.max("distance").alias("d"), F.max("other").alias("other"), F.count_distinct("id").alias("ids")).first()
    assert time.time() - began < 60
    assert tuple(row) == (240000, 0.0, 23, 60000)


@pytest.mark.parametrize(("name", "k"), [("ordinary_kriging", 8), ("local_thin_plate", 12)])
def test_estimates_of_shared_places(spark, tmp_path, monkeypatch, name, k):
    """Points of one place share one estimate, solved once; every point gets its own row."""
    i = np.array([n + 33127 * copy for n in range(600) for copy in range(4)])
    pd.DataFrame({"p_partkey": i, "p_retailprice": 900 + np.sin(i / 7.0) * 50 + i % 13, "p_size": (i % 50).astype("int32")}).to_parquet(tmp_path / "part.parquet")
    calls, by_place = [], shapes._by_place
    monkeypatch.setattr(shapes, "_by_place", lambda asked, *rest: calls.append(asked.select("id").distinct()) or by_place(asked, *rest))
    got = QUERIES[name](spark, str(tmp_path)).toPandas().set_index("id")
    p = pd.DataFrame({"id": i, "x": i % 211 * 3.0, "y": i % 157 * 4.0, "v": 900 + np.sin(i / 7.0) * 50 + i % 13})
    left, right = p[p["id"] % 4 == 0], p[p["id"] % 4 != 0]
    assert calls[0].count() == len(left[["x", "y"]].drop_duplicates())
    n = 0
    for r in left.itertuples():
        near = right.assign(d=np.hypot(right["x"] - r.x, right["y"] - r.y)).query("d <= 60").sort_values(["d", "id"])[:k]
        xy, z, at = near[["x", "y"]].to_numpy(), near["v"].to_numpy(), np.array([r.x, r.y])
        if len(near):
            n += 1
            want = K.ordinary_kriging(xy, z, at, 3000.0, 80.0)[0] if k == 8 else K.thin_plate(xy, z, at[None])[0]
            assert got.loc[r.id, "estimate"] == pytest.approx(want, rel=1e-6)
    assert n == len(got) == 600


@pytest.mark.parametrize(("name", "k"), [("ordinary_kriging", 8), ("local_thin_plate", 12)])
def test_estimates_beside_points_without_a_value(spark, tmp_path, name, k):
    """Points that have no value are no neighbours: those that have one are taken instead."""
    i = np.arange(1200)
    v = np.where(i % 5 == 2, np.nan, np.where(i % 11 == 3, np.inf, 900 + np.sin(i / 7.0) * 50))
    pd.DataFrame({"p_partkey": i, "p_retailprice": v, "p_size": (i % 50).astype("int32")}).to_parquet(tmp_path / "part.parquet")
    got = QUERIES[name](spark, str(tmp_path)).toPandas().set_index("id")["estimate"]
    p = pd.DataFrame({"id": i, "x": i % 211 * 3.0, "y": i % 157 * 4.0, "v": v})
    left, right = p[p["id"] % 4 == 0], p[(p["id"] % 4 != 0) & np.isfinite(p["v"])]
    solved = 0
    for r in left.itertuples():
        near = right.assign(d=np.hypot(right["x"] - r.x, right["y"] - r.y)).query("d <= 60").sort_values(["d", "id"])[:k]
        if len(near) >= 3:
            solved += 1
            xy, z, at = near[["x", "y"]].to_numpy(), near["v"].to_numpy(), np.array([r.x, r.y])
            want = K.ordinary_kriging(xy, z, at, 3000.0, 80.0)[0] if k == 8 else K.thin_plate(xy, z, at[None])[0]
            assert got[r.id] == pytest.approx(want, rel=1e-6)
    assert solved > 250


@pytest.mark.parametrize("name", ["ordinary_kriging", "local_thin_plate"])
def test_a_point_without_neighbours_has_its_row(spark, tmp_path, name):
    pd.DataFrame({"p_partkey": [0, 1, 2, 3, 400], "p_retailprice": [1.0, 2.0, 3.0, 5.0, 4.0], "p_size": np.int32(1)}).to_parquet(tmp_path / "part.parquet")
    got = {r["id"]: r["estimate"] for r in QUERIES[name](spark, str(tmp_path)).collect()}
    assert got.keys() == {0, 400} and got[0] is not None and got[400] is None
