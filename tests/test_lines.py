import math

from pyspark.sql import functions as F

from strataline.operators import joins as J, lines as L, stats


def table(spark, rows, schema):
    return spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "row_id long, " + schema).repartition(3)


def by_row(df, column):
    return [r[0] for r in df.orderBy("row_id").select(column).collect()]


def test_runs_break_at_nulls_gaps_and_other_lines(spark):
    v = [1, 2, None, 3, 4, 5, 6, 7, 8, 9, 10, 11, 12]
    line = ["a"] * 4 + ["b"] * 2 + ["a"] * 7
    axis = [0, 1, 2, 3, 4, 5, 6, 7, 8, 20, 21, 22, 23]
    df = table(spark, list(zip(map(lambda x: None if x is None else float(x), v), line, map(float, axis))), "v double, line string, s double")
    out = L.add_segments(df, ["line"], "v", "s", 2.0)
    assert by_row(out, "segment") == [1, 1, None, 2, 1, 1, 3, 3, 3, 4, 4, 4, 4]
    smooth = out.withColumn("m", L.moving_mean("v", ["line", "segment"], 3))
    assert by_row(smooth, "m") == [None, None, None, None, None, None, None, 7.0, None, None, 10.0, 11.0, None]


def test_windows(spark):
    df = table(spark, [(float(x), "a") for x in (1, 2, 99, 4, 5)], "v double, line string")
    assert by_row(df.withColumn("m", L.moving_mean("v", ["line"], 3)), "m") == [None, 34, 35, 36, None]
    assert by_row(df.withColumn("m", L.moving_median("v", ["line"], 3)), "m") == [None, 2, 4, 5, None]
    spike = table(spark, [(50.0 if i == 7 else 0.0, "a") for i in range(15)], "v double, line string")
    out = L.hampel(spike, "v", ["line"], 2, 3.0, complete=True)
    assert by_row(out, "filtered") == [None, None] + [0.0] * 11 + [None, None] and sum(by_row(out, "replaced")) == 1
    trend = table(spark, [(3 * (s + 1e9) + 100, s + 1e9, "a") for s in (0.0, 1.0, 3.0, 7.0, 12.0)], "v double, s double, line string")
    assert max(map(abs, by_row(trend.withColumn("d", L.detrend("v", "s", ["line"])), "d"))) < 1e-4


def test_flight_checks(spark):
    df = table(spark, list(zip([0.0, 10.0, 40.0, 40.0], [0.0, 0.0, 0.0, 10.0], [0.0, 1.0, 4.0, 5.0], [0.0, 2.0, 20.0, 21.0], [100.0, 100.0, 300.0, 100.0], ["a"] * 4)), "x double, y double, t double, v double, c double, line string")
    m = L.flight_metrics(df, ["line"], "x", "y", "t", "v")
    f = m.withColumn("flags", L.flight_flags(m, ["line"], "t", clearance="c", max_gap=2, max_spacing=20, max_speed=9.5, max_turn=45, max_clearance=200, max_rate=5))
    assert by_row(f, "flags") == [0, 8, 2 | 4 | 8 | 32 | 64, 8 | 16]
    s = L.line_summary(f, ["line"]).first()
    assert (s["samples"], s["failed"], s["pass_pct"]) == (4, 3, 25.0)
    t = table(spark, [(86399.0, "a"), (0.0, "a"), (1.0, "a")], "t double, line string")
    assert by_row(L.unwrap_time(t, "t", ["line"]), "unwrapped") == [86399, 86400, 86401]


def test_base_checks(spark):
    v = [0.2 * i + (20 if i == 10 else 0) for i in range(20)]
    df = table(spark, [(float(i), x, "a") for i, x in enumerate(v)], "t double, v double, line string")
    out = L.base_quality(df, ["line"], "t", "v", spike_sigma=4, max_drift=0.1)
    flags = by_row(out, "flags")
    assert flags[10] & L.BASE_SPIKE and all(f & L.BASE_DRIFT for f in flags)


def test_trajectory_is_straight_down(spark):
    df = table(spark, [(10.0 * i, 0.0, 0.0, "h") for i in range(4)], "md double, inc double, azi double, hole string")
    last = L.trajectory(df, "hole", "md", "inc", "azi").orderBy("md").collect()[-1]
    assert (last["north"], last["east"], last["tvd"]) == (0, 0, 30)


def test_interpolation(spark):
    left = spark.createDataFrame([(i, t) for i, t in enumerate([-1.0, 0.0, 5.0, 10.0, 11.0])], "row_id long, t double")
    base = spark.createDataFrame([(0.0, 49999.0), (0.0, 50001.0), (10.0, 50010.0), (None, 1.0)], "bt double, bv double")
    assert by_row(J.interpolate(left, base, "t", "bt", "bv", 3.0), "interpolated") == [None, 50000, 50005, 50010, None]


def test_neighbours_and_weights(spark):
    a = spark.createDataFrame([(0, 0.0, 0.0), (1, 50.0, 50.0)], "id long, x double, y double")
    b = spark.createDataFrame([(10, 3.0, 4.0, 1.0), (11, -3.0, 4.0, 3.0), (12, 0.0, 9.0, 5.0), (13, 20.0, 0.0, 7.0)], "k long, x double, y double, v double")
    near = J.neighbours(a, b, "x", "y", "k", 9.0, 2, left_id="id", carry=["v"])
    assert [(r["id"], r["k"], r["distance"]) for r in near.orderBy("rank").collect()] == [(0, 10, 5.0), (0, 11, 5.0)]
    assert J.inverse_distance(near, "id", "v").first()["estimate"] == 2.0


def test_overlaps_pair_once(spark):
    a = spark.createDataFrame([(i, float(i), i + 1.0) for i in range(20)], "i long, a0 double, a1 double")
    b = spark.createDataFrame([(j, 2.5 * j, 2.5 * (j + 1)) for j in range(8)], "j long, b0 double, b1 double")
    got = J.overlaps(a, b, ("a0", "a1"), ("b0", "b1"), 4.0)
    assert abs(got.agg(F.sum("overlap")).first()[0] - 20) < 1e-9 and got.groupBy("i", "j").count().where("count > 1").count() == 0


def test_reciprocals(spark):
    q = spark.createDataFrame([(0, 1, 2, 3, 10.0), (3, 2, 0, 1, -11.0), (1, 0, 2, 3, -10.0), (4, 5, 6, 7, 1.0)], "a int, b int, m int, n int, r double")
    got = J.reciprocal_errors(q, "a", "b", "m", "n", "r").collect()
    assert len(got) == 1 and abs(got[0]["error_percent"] - 200 / 21) < 1e-9 and got[0]["repeats"] == 2


def test_stats(spark):
    df = spark.createDataFrame([(float(i),) for i in range(10)], "v double")
    assert [r["n"] for r in stats.histogram(df, "v", 0.0, 3.0, 3).orderBy("bin").collect()] == [3, 3, 4]
    az = spark.createDataFrame([(179.0,), (1.0,)], "a double").agg(stats.axial_mean(F.col("a"))).first()[0]
    assert min(az, 180 - az) < 1e-9
    line = spark.createDataFrame([(float(i), 2.0 * i) for i in range(5)], "x double, y double")
    assert abs(stats.axis_of_points(line, [], "x", "y").first()["azimuth"] - math.degrees(math.atan(0.5))) < 1e-9
    edges = spark.createDataFrame([(i, i + 1) for i in range(12) if i != 6], "a long, b long")
    assert {(r["node"], r["component"]) for r in stats.components(edges, "a", "b").collect()} == {(i, 0 if i < 7 else 7) for i in range(13)}


def test_runs_in_blocks_do_not_hang_on_the_blocks(spark):
    """The fixture with a null, a change of line and a gap in the axis, and random lines in blocks of 4 and of 10**6 rows."""
    rows = [(0, 1.0, 0.0, "a"), (1, 2.0, 1.0, "a"), (2, 3.0, 2.0, "a"), (3, None, 3.0, "a"), (4, 100.0, 4.0, "a"), (5, 100.0, 5.0, "a"), (6, 100.0, 6.0, "a"), (7, 8.0, 20.0, "a"), (8, 8.0, 21.0, "a"), (9, 8.0, 22.0, "a"), (10, 10.0, 23.0, "b"), (11, 11.0, 24.0, "b"), (12, 12.0, 25.0, "b")]
    df = spark.createDataFrame(rows, "row_id long, v double, t double, line string")
    got = [r["filtered"] for r in L.filter_runs(df, "v", ["line"], 3, axis="t", max_gap=2.0, size=3).orderBy("row_id").collect()]
    assert got == [None, 2, None, None, None, 100, None, None, 8, None, None, 11, None]
    import random

    r = random.Random(4)
    many = spark.createDataFrame([(k, r.choice([None, r.random(), r.random(), r.random(), r.random()]), r.choice("ab") if k % 9 == 0 else "a") for k in range(500)], "row_id long, v double, line string").repartition(5)
    for kind in ("mean", "median"):
        small, large = ([x["filtered"] for x in L.filter_runs(many, "v", ["line"], 3, kind, size=n).orderBy("row_id").collect()] for n in (4, 10**6))
        assert small == large and any(x is not None for x in small)
