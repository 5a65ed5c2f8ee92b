"""Windows and runs of survey lines."""

from __future__ import annotations

from pyspark.sql import Window, functions as F

from ..operators import lines as L, stats
from .registry import query, view

_SEG = """segs AS (SELECT *, CASE WHEN v IS NOT NULL THEN sum(CASE WHEN v IS NOT NULL AND (pid IS NULL OR row_id - pid <> 1 OR pv IS NULL OR t - pt > 600) THEN 1 ELSE 0 END)
  OVER (PARTITION BY line, sensor ORDER BY row_id) END AS segment FROM (SELECT *, lag(row_id) OVER w AS pid, lag(v) OVER w AS pv, lag(t) OVER w AS pt FROM survey WINDOW w AS (PARTITION BY line, sensor ORDER BY row_id)))"""


def _segments(spark, sf, keys=("line", "sensor"), gap=600.0):
    return L.add_segments(view(spark, sf, "survey"), list(keys), "v", "t", gap, increasing=False, finite_only=False)


@query("segment_islands", f"WITH {_SEG} SELECT row_id, CAST(segment AS BIGINT) AS segment FROM segs")
def _(spark, sf):
    return _segments(spark, sf).select("row_id", F.col("segment").cast("long"))


@query("run_lengths", f"WITH {_SEG} SELECT line, sensor, CAST(segment AS BIGINT) AS segment, min(row_id) AS first_row, max(row_id) AS last_row, count(*) AS n, round(max(t) - min(t), 6) AS seconds FROM segs WHERE segment IS NOT NULL GROUP BY 1, 2, 3")
def _(spark, sf):
    s = _segments(spark, sf).where("segment is not null")
    return s.groupBy("line", "sensor", F.col("segment").cast("long").alias("segment")).agg(F.min("row_id").alias("first_row"), F.max("row_id").alias("last_row"), F.count("*").alias("n"), (F.max("t") - F.min("t")).alias("seconds"))


_FRAME = "(PARTITION BY line, sensor ORDER BY row_id ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING)"


@query("moving_mean_complete", f"SELECT row_id, round(CASE WHEN count(v) OVER {_FRAME} = 5 THEN avg(v) OVER {_FRAME} END, 6) AS smooth FROM survey")
def _(spark, sf):
    return view(spark, sf, "survey").select("row_id", L.moving_mean("v", ["line", "sensor"], 5).alias("smooth"))


@query("moving_median_complete", f"SELECT row_id, round(CASE WHEN count(v) OVER {_FRAME} = 5 THEN median(v) OVER {_FRAME} END, 6) AS smooth FROM survey")
def _(spark, sf):
    return view(spark, sf, "survey").select("row_id", L.moving_median("v", ["line", "sensor"], 5).alias("smooth"))


def _hampel_sql(half, enough, limit, out):
    frame = f"(PARTITION BY line, sensor ORDER BY row_id ROWS BETWEEN {half} PRECEDING AND {half} FOLLOWING)"
    return f"""WITH w AS (SELECT row_id, v, list_filter(list(v) OVER {frame}, lambda z: z IS NOT NULL) AS f FROM survey),
      m AS (SELECT *, len(f) AS n, list_median(f) AS med FROM w), s AS (SELECT *, 1.4826 * list_median(list_transform(f, lambda z: abs(z - med))) AS sig FROM m)
      SELECT row_id, round({out}, 6) AS filtered, coalesce(v IS NOT NULL AND {enough} AND abs(v - med) > {limit}, false) AS replaced FROM s"""


@query("hampel_truncated", _hampel_sql(3, "n >= 3", "3 * greatest(sig, greatest(abs(med), 1e0) * 2.220446049250313e-16)", "CASE WHEN v IS NOT NULL AND n >= 3 AND abs(v - med) > 3 * greatest(sig, greatest(abs(med), 1e0) * 2.220446049250313e-16) THEN med ELSE v END"))
def _(spark, sf):
    return L.hampel(view(spark, sf, "survey"), "v", ["line", "sensor"], 3, 3.0).select("row_id", "filtered", "replaced")


@query("hampel_complete", _hampel_sql(2, "n = 5", "3 * sig", "CASE WHEN n = 5 THEN CASE WHEN abs(v - med) > 3 * sig THEN med ELSE v END END"))
def _(spark, sf):
    return L.hampel(view(spark, sf, "survey"), "v", ["line", "sensor"], 2, 3.0, complete=True).select("row_id", "filtered", "replaced")


@query("detrend_segment", f"WITH {_SEG}, z AS (SELECT *, t - min(t) OVER (PARTITION BY line, sensor, segment) AS axis FROM segs WHERE segment IS NOT NULL) SELECT row_id, round(v - (regr_intercept(v, axis) OVER g + regr_slope(v, axis) OVER g * axis), 5) AS detrended FROM z WINDOW g AS (PARTITION BY line, sensor, segment)", digits=5)
def _(spark, sf):
    run = ["line", "sensor", "segment"]
    s = _segments(spark, sf).where("segment is not null").withColumn("axis", F.col("t") - F.min("t").over(Window.partitionBy(*run)))
    return s.select("row_id", L.detrend("v", "axis", run).alias("detrended"))


_FM = """m AS (SELECT *, t - lag(t) OVER w AS interval, sqrt(pow(x - lag(x) OVER w, 2) + pow(y - lag(y) OVER w, 2)) AS spacing,
  ((degrees(atan2(x - lag(x) OVER w, y - lag(y) OVER w)) % 360) + 360) % 360 AS azimuth, abs(v - lag(v) OVER w) AS dv FROM flights WINDOW w AS (PARTITION BY line ORDER BY t, row_id)),
 mm AS (SELECT *, CASE WHEN interval > 0 THEN spacing / interval END AS speed, CASE WHEN interval > 0 THEN dv / interval END AS value_rate,
  abs((((azimuth - lag(azimuth) OVER w + 180) % 360) + 360) % 360 - 180) AS turn FROM m WINDOW w AS (PARTITION BY line ORDER BY t, row_id)),
 ff AS (SELECT *, CASE WHEN lag(row_id) OVER w IS NOT NULL AND NOT coalesce(interval > 0, false) THEN 1 ELSE 0 END | CASE WHEN interval > 900 THEN 2 ELSE 0 END | CASE WHEN spacing > 700 THEN 4 ELSE 0 END
  | CASE WHEN speed > 2 THEN 8 ELSE 0 END | CASE WHEN turn > 120 THEN 16 ELSE 0 END | CASE WHEN clearance < 30 OR clearance > 370 THEN 32 ELSE 0 END | CASE WHEN value_rate > 0.5 THEN 64 ELSE 0 END AS flags
  FROM mm WINDOW w AS (PARTITION BY line ORDER BY t, row_id))"""


@query("flight_metrics", f"WITH {_FM} SELECT row_id, round(interval, 6) AS interval, round(spacing, 6) AS spacing, round(speed, 6) AS speed, round(azimuth, 6) AS azimuth, round(turn, 6) AS turn, round(value_rate, 6) AS value_rate FROM mm")
def _(spark, sf):
    return L.flight_metrics(view(spark, sf, "flights"), ["line"], "x", "y", "t", "v").select("row_id", "interval", "spacing", "speed", "azimuth", "turn", "value_rate")


def flagged_flights(spark, sf):
    m = L.flight_metrics(view(spark, sf, "flights"), ["line"], "x", "y", "t", "v")
    return m.withColumn("flags", L.flight_flags(m, ["line"], "t", clearance="clearance", max_gap=900, max_spacing=700, max_speed=2, max_turn=120, min_clearance=30, max_clearance=370, max_rate=0.5))


@query("flight_flags", f"WITH {_FM} SELECT row_id, CAST(flags AS INT) AS flags FROM ff")
def _(spark, sf):
    return flagged_flights(spark, sf).select("row_id", "flags")


@query("flight_summary", f"WITH {_FM} SELECT line, count(*) AS samples, count(*) FILTER (flags <> 0) AS failed, round(100e0 * count(*) FILTER (flags = 0) / count(*), 6) AS pass_pct, round(avg(speed), 6) AS mean_speed, round(max(interval), 6) AS max_gap, round(max(spacing), 6) AS max_space FROM ff GROUP BY line")
def _(spark, sf):
    return L.line_summary(flagged_flights(spark, sf), ["line"])


@query(
    "base_station_quality",
    """WITH b AS (SELECT *, t - lag(t) OVER w AS interval, abs(v - lag(v) OVER w) AS dv, lag(row_id) OVER w AS pid, list(v) OVER (PARTITION BY line ORDER BY row_id ROWS BETWEEN 5 PRECEDING AND 5 FOLLOWING) AS f,
      regr_slope(v, t) OVER (PARTITION BY line) AS drift, median(v) OVER (PARTITION BY line) AS mid FROM flights WINDOW w AS (PARTITION BY line ORDER BY t, row_id)),
     s AS (SELECT *, list_median(f) AS med, median(abs(v - mid)) OVER (PARTITION BY line) AS mad FROM b), q AS (SELECT *, 1.4826 * list_median(list_transform(f, lambda z: abs(z - med))) AS sig, CASE WHEN interval > 0 THEN dv / interval END AS rate FROM s)
     SELECT row_id, round(rate, 6) AS rate, round(v - med, 6) AS residual, CAST(CASE WHEN pid IS NOT NULL AND NOT coalesce(interval > 0, false) THEN 1 ELSE 0 END | CASE WHEN interval > 900 THEN 2 ELSE 0 END
      | CASE WHEN (CASE WHEN sig > 0 THEN sig ELSE mad * 1.4826 END) > 0 AND abs(v - med) > 4 * (CASE WHEN sig > 0 THEN sig ELSE mad * 1.4826 END) THEN 4 ELSE 0 END | CASE WHEN rate > 0.5 THEN 8 ELSE 0 END AS INT) AS flags FROM q""",
)
def _(spark, sf):
    return L.base_quality(view(spark, sf, "flights"), ["line"], "t", "v", max_gap=900, spike_sigma=4, max_rate=0.5).select("row_id", "rate", "residual", "flags")


@query("unwrap_time", """WITH d AS (SELECT row_id, line, t % 86400 AS tod FROM flights), b AS (SELECT *, CASE WHEN tod < lag(tod) OVER w - 43200 THEN 1 ELSE 0 END AS back FROM d WINDOW w AS (PARTITION BY line ORDER BY row_id))
  SELECT row_id, round(tod + sum(back) OVER (PARTITION BY line ORDER BY row_id) * 86400, 3) AS unwrapped FROM b""", digits=3)
def _(spark, sf):
    return L.unwrap_time(view(spark, sf, "flights").withColumn("tod", F.pmod("t", F.lit(86400.0))), "tod", ["line"]).select("row_id", "unwrapped")


@query("cumulative_distance", "WITH s AS (SELECT *, coalesce(sqrt(pow(x - lag(x) OVER w, 2) + pow(y - lag(y) OVER w, 2)), 0) AS step FROM flights WINDOW w AS (PARTITION BY line ORDER BY row_id)) SELECT row_id, round(sum(step) OVER (PARTITION BY line ORDER BY row_id ROWS UNBOUNDED PRECEDING), 4) AS distance FROM s", digits=4)
def _(spark, sf):
    return L.add_distance(view(spark, sf, "flights"), ["line"], "x", "y").select("row_id", "distance")


@query("gradient_velocity", """SELECT row_id, round(CASE WHEN lag(row_id) OVER w IS NULL AND lead(row_id) OVER w IS NULL THEN NULL WHEN lag(row_id) OVER w IS NULL THEN lead(x) OVER w - x WHEN lead(row_id) OVER w IS NULL THEN x - lag(x) OVER w ELSE (lead(x) OVER w - lag(x) OVER w) / 2 END
  / nullif(CASE WHEN lag(row_id) OVER w IS NULL AND lead(row_id) OVER w IS NULL THEN NULL WHEN lag(row_id) OVER w IS NULL THEN lead(t) OVER w - t WHEN lead(row_id) OVER w IS NULL THEN t - lag(t) OVER w ELSE (lead(t) OVER w - lag(t) OVER w) / 2 END, 0), 6) AS vx FROM flights WINDOW w AS (PARTITION BY line ORDER BY row_id)""")
def _(spark, sf):
    return view(spark, sf, "flights").select("row_id", F.try_divide(L.gradient("x", ["line"]), L.gradient("t", ["line"])).alias("vx"))


@query("fourth_difference", "SELECT row_id, round(lag(v, 2) OVER w - 4 * lag(v) OVER w + 6 * v - 4 * lead(v) OVER w + lead(v, 2) OVER w, 6) AS d4 FROM flights WINDOW w AS (PARTITION BY line ORDER BY row_id)")
def _(spark, sf):
    return view(spark, sf, "flights").select("row_id", L.fourth_difference("v", ["line"]).alias("d4"))


_STA = "s AS (SELECT row_id, line, CASE WHEN count(v) OVER (PARTITION BY line ORDER BY row_id ROWS BETWEEN 9 PRECEDING AND CURRENT ROW) = 10 THEN avg(v * v) OVER (PARTITION BY line ORDER BY row_id ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) / nullif(avg(v * v) OVER (PARTITION BY line ORDER BY row_id ROWS BETWEEN 9 PRECEDING AND CURRENT ROW), 0) END AS ratio FROM flights)"


@query("sta_lta_ratio", f"WITH {_STA} SELECT row_id, round(ratio, 6) AS ratio FROM s")
def _(spark, sf):
    return view(spark, sf, "flights").select("row_id", L.sta_lta("v", ["line"], 3, 10).alias("ratio"))


@query("sta_lta_picks", f"WITH {_STA} SELECT line, min(row_id) FILTER (ratio >= 2.5) AS pick FROM s GROUP BY line")
def _(spark, sf):
    f = view(spark, sf, "flights").withColumn("ratio", L.sta_lta("v", ["line"], 3, 10))
    return L.first_crossing(f, ["line"], "ratio", 2.5)


_AXIS = """ax AS (SELECT line, avg(x) AS cx, avg(y) AS cy, count(*) AS n, var_pop(x) AS xx, var_pop(y) AS yy, covar_pop(x, y) AS xy FROM flights GROUP BY line),
 al AS (SELECT line, cx, cy, n, ((degrees(atan2(2 * xy, yy - xx)) / 2 % 180) + 180) % 180 AS azimuth, (xx + yy + sqrt(pow(xx - yy, 2) + 4 * xy * xy)) / 2 AS major, (xx + yy - sqrt(pow(xx - yy, 2) + 4 * xy * xy)) / 2 AS minor FROM ax)"""


@query("line_axis_pca", f"WITH {_AXIS} SELECT line, n, round(cx, 4) AS cx, round(cy, 4) AS cy, round(azimuth, 4) AS azimuth, round(major, 4) AS major, round(minor, 4) AS minor FROM al", digits=4)
def _(spark, sf):
    return stats.axis_of_points(view(spark, sf, "flights"), ["line"], "x", "y")


@query("interline_spacing", f"""WITH {_AXIS}, sv AS (SELECT ((degrees(atan2(avg(sin(radians(2 * azimuth))), avg(cos(radians(2 * azimuth))))) / 2 % 180) + 180) % 180 AS sa FROM al),
  o AS (SELECT line, cx * cos(radians(sa)) - cy * sin(radians(sa)) AS off FROM al, sv), p AS (SELECT *, off - lag(off) OVER (ORDER BY off) AS spacing FROM o), q AS (SELECT *, median(spacing) FILTER (spacing > 0) OVER () AS nominal FROM p)
  SELECT line, round(off, 4) AS "offset", round(spacing, 4) AS spacing, coalesce(abs(spacing - nominal) > 0.25 * nominal, false) AS flag FROM q""", digits=4)
def _(spark, sf):
    axes = stats.axis_of_points(view(spark, sf, "flights"), ["line"], "x", "y")
    return L.line_spacing(axes, "cx", "cy", "azimuth").select("line", "offset", "spacing", "flag")


@query("axial_mean_azimuth", "SELECT floor(id / 100) AS part, round(((degrees(atan2(avg(sin(radians(2 * az))), avg(cos(radians(2 * az))))) / 2 % 180) + 180) % 180, 4) AS azimuth FROM stations GROUP BY 1", digits=4)
def _(spark, sf):
    return view(spark, sf, "stations").groupBy(F.floor(F.col("id") / 100).cast("double").alias("part")).agg(stats.axial_mean(F.col("az")).alias("azimuth"))


@query("sensor_median_level", "SELECT row_id, round(v - median(v) OVER (PARTITION BY sensor), 6) AS leveled FROM survey")
def _(spark, sf):
    return view(spark, sf, "survey").select("row_id", L.level_by_median("v", ["sensor"]).alias("leveled"))


@query("sensor_track_median_level", "SELECT row_id, round(v - median(v) OVER (PARTITION BY sensor, line) + 5, 6) AS leveled FROM survey")
def _(spark, sf):
    return view(spark, sf, "survey").select("row_id", L.level_by_median("v", ["sensor", "line"], 5.0).alias("leveled"))


@query("zero_traverse_mean", "SELECT row_id, round(v - avg(CASE WHEN v BETWEEN 5 AND 60 THEN v END) OVER (PARTITION BY line), 6) AS zeroed FROM survey")
def _(spark, sf):
    return view(spark, sf, "survey").select("row_id", L.level_by_background("v", ["line"], 5, 60).alias("zeroed"))


@query("zero_traverse_median", "SELECT row_id, round(v - median(CASE WHEN v BETWEEN 5 AND 60 THEN v END) OVER (PARTITION BY line), 6) AS zeroed FROM survey")
def _(spark, sf):
    return view(spark, sf, "survey").select("row_id", L.level_by_background("v", ["line"], 5, 60, "median").alias("zeroed"))


@query("profile_stats", "SELECT line, sensor, count(v) AS n, min(v) AS low, max(v) AS high, round(avg(v), 6) AS mean, round(stddev_pop(v), 6) AS sd, round(quantile_cont(v, 0.98), 6) AS p98 FROM survey GROUP BY 1, 2")
def _(spark, sf):
    return view(spark, sf, "survey").groupBy("line", "sensor").agg(F.count("v").alias("n"), F.min("v").alias("low"), F.max("v").alias("high"), F.avg("v").alias("mean"), F.stddev_pop("v").alias("sd"), F.percentile("v", F.lit(0.98)).alias("p98"))


@query("growing_window_ratio", """WITH s AS (SELECT row_id, line, v, """ + ", ".join(f"sum(v) OVER (PARTITION BY line ORDER BY row_id ROWS BETWEEN {r} PRECEDING AND {r} FOLLOWING) AS s{r}, count(*) OVER (PARTITION BY line ORDER BY row_id ROWS BETWEEN {r} PRECEDING AND {r} FOLLOWING) AS n{r}" for r in range(4)) + " FROM flights) SELECT row_id, CAST(CASE " + " ".join(f"WHEN s{r} >= 60 THEN {r}" for r in range(4)) + " END AS INT) AS radius, CASE " + " ".join(f"WHEN s{r} >= 60 THEN n{r}" for r in range(4)) + " END AS samples, round(CASE " + " ".join(f"WHEN s{r} >= 60 THEN s{r}" for r in range(4)) + " END, 6) AS total FROM s")
def _(spark, sf):
    return L.growing_ratio(view(spark, sf, "flights"), ["line"], ["v"], [60.0], 3).select("row_id", "radius", "samples", F.col("sum_v").alias("total"))


@query("survey_minimum_curvature", """WITH h AS (SELECT row_id, line, 10e0 * row_number() OVER (PARTITION BY line ORDER BY row_id) AS md, radians(row_id % 60) AS i, radians(row_id * 7 % 360) AS a FROM flights),
  p AS (SELECT *, lag(md) OVER w AS md1, lag(i) OVER w AS i1, lag(a) OVER w AS a1 FROM h WINDOW w AS (PARTITION BY line ORDER BY md)),
  b AS (SELECT *, acos(greatest(-1e0, least(1e0, cos(i - i1) - sin(i1) * sin(i) * (1 - cos(a - a1))))) AS be FROM p), f AS (SELECT *, (md - md1) / 2 * CASE WHEN be <= 1e-7 THEN 1 ELSE 2 * tan(be / 2) / be END AS hf FROM b)
  SELECT row_id, round(sum(coalesce(hf * (sin(i1) * cos(a1) + sin(i) * cos(a)), 0)) OVER w, 4) AS north, round(sum(coalesce(hf * (sin(i1) * sin(a1) + sin(i) * sin(a)), 0)) OVER w, 4) AS east, round(sum(coalesce(hf * (cos(i1) + cos(i)), 0)) OVER w, 4) AS tvd
  FROM f WINDOW w AS (PARTITION BY line ORDER BY md ROWS UNBOUNDED PRECEDING)""", digits=4)
def _(spark, sf):
    h = view(spark, sf, "flights").withColumn("md", F.row_number().over(Window.partitionBy("line").orderBy("row_id")) * 10.0)
    h = h.withColumn("inc", (F.col("row_id") % 60).cast("double")).withColumn("azi", (F.col("row_id") * 7 % 360).cast("double"))
    return L.trajectory(h, "line", "md", "inc", "azi").select("row_id", "north", "east", "tvd")


@query("depth_quality", """SELECT row_id, CAST(CASE WHEN x < lag(x) OVER w THEN 4 WHEN x = lag(x) OVER w THEN 1 WHEN x - lag(x) OVER w > 200 THEN 2 ELSE 0 END AS INT) AS flag FROM flights WINDOW w AS (PARTITION BY line ORDER BY row_id)""")
def _(spark, sf):
    step = F.col("x") - F.lag("x").over(Window.partitionBy("line").orderBy("row_id"))
    return view(spark, sf, "flights").select("row_id", F.when(step < 0, 4).when(step == 0, 1).when(step > 200, 2).otherwise(0).alias("flag"))
