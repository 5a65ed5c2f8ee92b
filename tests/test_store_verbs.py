"""Store verbs, sectioned and spaced text, digests."""

import pytest
from pyspark.sql import functions as F

from strataline.functions.digest import table_digest, tree_digest
from strataline.functions.projection import TransverseMercator
from strataline.plans import recipes
from strataline.plans.store import StoreError, SurveyStore
from strataline.sources import text


@pytest.fixture(scope="module")
def store(spark, tmp_path_factory):
    rows = [("L1" if k < 20 else "L2", k * 1.0, 100.0 + (k % 20) + (50 if k == 7 else 0), 3.0 + k / 100, 45.0 + k / 100) for k in range(40)]
    s = SurveyStore(spark, f"file://{tmp_path_factory.mktemp('store')}/s")
    return s, s.import_table("a", spark.createDataFrame(rows, "line string, t double, mag double, lon double, lat double").repartition(7), order=["line"])


def test_rows_stay_together_where_the_order_has_ties(store):
    s, d = store
    rows = s.scan(d, ["line", "t", "mag", "lon", "lat"]).orderBy("row_id").collect()
    assert [r["row_id"] for r in rows] == list(range(40)) and [r["line"] for r in rows] == ["L1"] * 20 + ["L2"] * 20
    assert all(r["lon"] == 3.0 + r["t"] / 100 and r["lat"] == 45.0 + r["t"] / 100 for r in rows)
    assert s._fs.listStatus(s._path(f"{s.path}/aside")) is not None and len(list(s._fs.listStatus(s._path(f"{s.path}/aside")))) == 0


def test_import_refuses_repeated_row_ids(spark, store):
    with pytest.raises(StoreError):
        store[0].import_table("bad", spark.createDataFrame([(0, 1.0), (0, 2.0)], "row_id long, v double"))


def test_publish_checks_which_rows(spark, store):
    s, d = store
    with pytest.raises(StoreError):
        s.publish(d, "x", spark.range(100, 140).select(F.col("id").alias("row_id"), F.lit(1.0).alias("x")))


def test_filter_channel(spark, tmp_path):
    s = SurveyStore(spark, f"file://{tmp_path}/f")
    d = s.import_table("a", spark.createDataFrame([(k, "L", float(v)) for k, v in enumerate([1, 2, 99, 4, 5])], "row_id long, line string, v double"))
    s.filter_channel(d, "v", "mean", "mean", 3, line="line")
    s.filter_channel(d, "v", "median", "median", 3, line="line")
    got = s.scan(d, ["mean", "median"]).orderBy("row_id").collect()
    assert [r["mean"] for r in got] == [None, 34, 35, 36, None] and [r["median"] for r in got] == [None, 2, 4, 5, None]
    with pytest.raises(StoreError):
        s.filter_channel(d, "v", "mean", "mean", 3, line="line")
    assert s.lineage([r["version_id"] for r in s.channels(d).collect() if r["name"] == "mean"][0]).count() == 3


def test_correct_level_reproject_duplicate(spark, tmp_path):
    s = SurveyStore(spark, f"file://{tmp_path}/c")
    rows = [(k, "L1" if k < 5 else "T1", float(k % 5), 10.0 * (k % 5), 3.0 if k != 4 else None, 45.0) for k in range(10)]
    d = s.import_table("a", spark.createDataFrame(rows, "row_id long, line string, t double, v double, lon double, lat double"))
    base = spark.createDataFrame([(0.0, 50000.0), (10.0, 50010.0)], "t double, v double")
    s.correct_magnetic(d, "v", "t", "line", base=base, base_reference=50000.0, lag_seconds=1.0)
    got = s.scan(d, ["mag_base", "mag_lagged", "mag_corrected"]).where("row_id < 5").orderBy("row_id").collect()
    assert [r["mag_lagged"] for r in got] == [10, 20, 30, 40, None] and [r["mag_base"] for r in got] == [0, 1, 2, 3, 4] and [r["mag_corrected"] for r in got][:4] == [10, 19, 28, 37]
    x = spark.createDataFrame([("L1", "T1", 8.0), ("L1", "T1", 8.0)], "traverse string, tie string, residual double")
    s.level_lines(d, "v", "line", x, "shift", "flat")
    flat = s.scan(d, ["v", "shift", "flat"]).orderBy("row_id").collect()
    assert all(abs(r["flat"] - r["v"] - r["shift"]) < 1e-12 for r in flat) and abs(flat[0]["shift"] + 4) < 1e-9 and abs(flat[9]["shift"] - 4) < 1e-9
    s.reproject(d, "lon", "lat", None, TransverseMercator.utm(31), ("e", "n"))
    e = s.scan(d, ["e", "n"]).orderBy("row_id").collect()
    assert abs(e[0]["e"] - 500000) < 1e-6 and e[4]["e"] is None
    with pytest.raises(StoreError):
        s.reproject(d, "lon", "lat", None, TransverseMercator.utm(31), ("e", "other"))
    s.duplicate(d, "flat", "copy")
    paths = {r["name"]: r["path"] for r in s.channels(d).collect()}
    assert paths["copy"] == paths["flat"] and s.verify(d, ["copy"], s.scan(d, ["flat"]).withColumnRenamed("flat", "copy")) == 0
    s.set_geometry(d, "e", "n", "EPSG:32631", "line")
    s.rename(d, "e", "east")
    assert s.geometry(d)["crs"] == "EPSG:32631" and s.geometry(d)["x"] == [r["channel_id"] for r in s.channels(d).collect() if r["name"] == "east"][0]


def test_text_files(spark, tmp_path):
    (tmp_path / "a.txt").write_text("made by hand\n 1  2.5e1 x\n\n3 * y\n")
    got = text.read_spaced(spark, f"{tmp_path}/a.txt", ["p", "q", "name"], skip=1, text=("name",)).collect()
    assert sorted(tuple(r) for r in got) == [(1.0, 25.0, "x"), (3.0, None, "y")]
    (tmp_path / "b.txt").write_text("  12 3.5AB\n   7-1.0CD\n")
    got = text.read_fixed_width(spark, f"{tmp_path}/b.txt", [("n", 0, 4), ("v", 4, 4), ("s", 8, 2)], text=("s",)).collect()
    assert sorted(tuple(r) for r in got) == [(7.0, -1.0, "CD"), (12.0, 3.5, "AB")]
    lines = ["/ remarks", "Line 10"] + [f"{k} {k * 2}.5" for k in range(30)] + ["TIE 7:0"] + [f"{k} *" for k in range(30, 40)] + ["line 11", "50 1"]
    (tmp_path / "c.xyz").write_text("\n".join(lines) + "\n")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "64")
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    try:
        df = text.read_sections(spark, f"{tmp_path}/c.xyz", ["x", "y"])
        got = sorted(tuple(r) for r in df.collect())
        assert spark.read.text(f"{tmp_path}/c.xyz").rdd.getNumPartitions() > 3
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
        spark.conf.unset("spark.sql.files.openCostInBytes")
    want = [("LINE", "10", float(k), k * 2 + 0.5) for k in range(30)] + [("LINE", "11", 50.0, 1.0)] + [("TIE", "7:0", float(k), None) for k in range(30, 40)]
    assert got == sorted(want, key=lambda r: r[:3])


def test_digests_and_recipe_versions(spark):
    assert len({tree_digest(v) for v in (1, 1.0, True, "1", None, [1], {"a": 1})}) == 7
    assert tree_digest({"a": 1, "b": [2, None]}) == tree_digest({"b": [2, None], "a": 1})
    with pytest.raises(ValueError):
        tree_digest({"a": float("nan")})
    df = spark.range(100).selectExpr("id", "if(id % 7 = 0, null, id * 0.5) AS v")
    one, two = (table_digest(x, ["id", "v"]).first() for x in (df, df.repartition(9).orderBy(F.desc("id"))))
    assert one == two and table_digest(df.where("id > 0"), ["id", "v"]).first()["digest"] != one["digest"]
    cells = spark.createDataFrame([(0, 0, 1.0)], "r int, c int, z double")
    steps = [{"operation": "grids.nine_point", "parameters": {"cells": {"$input": "cells"}}}]
    assert recipes.run(steps, {"cells": cells}, versions={"cells": "v2"}, expected={"cells": "v2"}).count() == 1
    with pytest.raises(ValueError):
        recipes.run(steps, {"cells": cells}, versions={"cells": "v3"}, expected={"cells": "v2"})
    assert recipes.provenance(steps, {"cells": "v2"})["digest"] != recipes.provenance(steps, {"cells": "v3"})["digest"]
