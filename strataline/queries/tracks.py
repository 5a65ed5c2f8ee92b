"""Tracks, crossovers, filters of rows and windows by distance."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.digest import table_digest
from ..operators import lines as L, tracks as T
from .registry import query, view

c = F.col
# flown lines: the first 1,200 m of a user's flight in steps, ties across them; both have a value at each row
_TRACK = """tr AS (SELECT row_id, line, x + 1e0 * (row_id % 7) AS x, line * 4e0 + 1e0 * (row_id % 3) AS y, v FROM flights),
  s AS (SELECT line, row_id, x AS x0, y AS y0, v AS v0, lead(x) OVER w AS x1, lead(y) OVER w AS y1, lead(v) OVER w AS v1 FROM tr WINDOW w AS (PARTITION BY line ORDER BY row_id)),
  d AS (SELECT *, sqrt((x1 - x0) * (x1 - x0) + (y1 - y0) * (y1 - y0)) AS len FROM s), e AS (SELECT *, coalesce(sum(len) OVER (PARTITION BY line ORDER BY row_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS s0 FROM d)"""
_CROSS = f"""{_TRACK}, a AS (SELECT * FROM e WHERE line % 2 = 0 AND len > 0 AND len <= 60), b AS (SELECT line, row_id, y0 AS x0, x0 AS y0, y1 AS x1, x1 AS y1, v0, v1, s0 FROM e WHERE line % 2 = 1 AND len > 0 AND len <= 60),
  j AS (SELECT a.line AS traverse, b.line AS tie, a.x0 AS ax, a.y0 AS ay, a.x1 - a.x0 AS adx, a.y1 - a.y0 AS ady, b.x1 - b.x0 AS bdx, b.y1 - b.y0 AS bdy, b.x0 - a.x0 AS dx, b.y0 - a.y0 AS dy, a.s0 AS sa, b.s0 AS sb, a.v0 AS va, a.v1 - a.v0 AS dva, b.v0 AS vb, b.v1 - b.v0 AS dvb
    FROM a JOIN b ON least(a.x0, a.x1) <= greatest(b.x0, b.x1) AND least(b.x0, b.x1) <= greatest(a.x0, a.x1) AND least(a.y0, a.y1) <= greatest(b.y0, b.y1) AND least(b.y0, b.y1) <= greatest(a.y0, a.y1)),
  k AS (SELECT *, (dx * bdy - dy * bdx) / nullif(adx * bdy - ady * bdx, 0) AS p, (dx * ady - dy * adx) / nullif(adx * bdy - ady * bdx, 0) AS q FROM j),
  x AS (SELECT traverse, tie, ax + adx * p AS x, ay + ady * p AS y, sa + sqrt(adx * adx + ady * ady) * p AS ts, sb + sqrt(bdx * bdx + bdy * bdy) * q AS us, va + dva * p AS tv, vb + dvb * q AS uv FROM k WHERE p >= 0 AND p < 1 AND q >= 0 AND q < 1)"""


def _tracks(spark, sf):
    f = view(spark, sf, "flights")
    return f.select("row_id", "line", (c("x") + (c("row_id") % 7) * 1.0).alias("x"), (c("line") * 4.0 + (c("row_id") % 3) * 1.0).alias("y"), "v")


def _crossings(spark, sf):
    t = _tracks(spark, sf)
    s = T.segments(t, "line", "x", "y", "v")
    length = F.hypot(c("x1") - c("x0"), c("y1") - c("y0"))
    s = s.where(length <= 60)
    ties = s.where("line % 2 = 1").select("line", "row_id", c("y0").alias("x0"), c("x0").alias("y0"), c("y1").alias("x1"), c("x1").alias("y1"), "s0", "v0", "v1")
    return T.crossovers(s.where("line % 2 = 0"), ties, 60.0)


@query("line_crossovers", f"WITH {_CROSS} SELECT traverse, tie, round(x, 4) AS x, round(y, 4) AS y, round(ts, 4) AS traverse_distance, round(us, 4) AS tie_distance, round(tv, 4) AS traverse_value, round(uv, 4) AS tie_value, round(tv - uv, 4) AS residual FROM x", digits=4)
def _(spark, sf):
    return _crossings(spark, sf)


@query("crossover_adjacency", f"WITH {_CROSS} SELECT traverse, tie, round(ts, 4) AS distance, round(ts - lag(ts) OVER w, 4) AS back, round(lead(ts) OVER w - ts, 4) AS ahead FROM x WINDOW w AS (PARTITION BY traverse ORDER BY ts, tie, us)", digits=4)
def _(spark, sf):
    return T.adjacency(_crossings(spark, sf)).select("traverse", "tie", c("traverse_distance").alias("distance"), "back", "ahead")


_RING = ((100.0, 50.0), (500.0, 100.0), (400.0, 500.0), (150.0, 400.0))


def _ring_sql() -> str:
    odd, edge = [], []
    for (x0, y0), (x1, y1) in zip(_RING, [*_RING[1:], _RING[0]]):
        edge.append(f"((x - {x0}) * {y1 - y0} - (y - {y0}) * {x1 - x0} = 0 AND x BETWEEN {min(x0, x1)} AND {max(x0, x1)} AND y BETWEEN {min(y0, y1)} AND {max(y0, y1)})")
        odd.append(f"CASE WHEN y >= {min(y0, y1)} AND y < {max(y0, y1)} AND x < {x0} + (y - {y0}) * {x1 - x0} / {y1 - y0} THEN 1 ELSE 0 END")
    return f"({' OR '.join(edge)} OR ({' + '.join(odd)}) % 2 = 1)"


@query("polygon_clip", f"SELECT id, CASE WHEN {_ring_sql()} THEN v END AS v FROM points")
def _(spark, sf):
    return T.clip(view(spark, sf, "points"), "x", "y", [_RING], ["v"]).select("id", "v")


@query("sensor_exclusion", "SELECT row_id, sensor, CASE WHEN sensor <> 1 THEN raw END AS raw FROM survey")
def _(spark, sf):
    s = view(spark, sf, "survey").withColumn("id", F.concat(c("sensor").cast("string"), F.lit(".0")))
    return T.exclude_sensors(s, "id", [1.0], ["raw"]).select("row_id", "sensor", "raw")


@query("dummy_values", "SELECT id, CASE WHEN s <> 7 AND s <> 11 THEN s END AS s FROM points")
def _(spark, sf):
    return T.without_dummies(view(spark, sf, "points"), ["s"], [7.0, 11.0]).select("id", "s")


@query("repeated_filters", "SELECT id, s FROM points WHERE s IN (5, 9, 20) AND s IN (9, 20, 31)")
def _(spark, sf):
    one = T.accepted([("s", [5.0, 9.0, 20.0]), ("s", [9.0, 20.0, 31.0])])
    return view(spark, sf, "points").where(c("s").isin(one["s"])).select("id", "s")


@query("metre_median_residual", "WITH a AS (SELECT row_id, line, CAST(round(1000 * (x + 1e-3 * row_id)) AS BIGINT) AS d, v FROM flights), m AS (SELECT *, median(v) OVER (PARTITION BY line ORDER BY d RANGE BETWEEN 120000 PRECEDING AND 120000 FOLLOWING) AS m, min(d) OVER (PARTITION BY line) AS lo, max(d) OVER (PARTITION BY line) AS hi FROM a) SELECT row_id, round(CASE WHEN d - 120000 >= lo AND d + 120000 <= hi THEN v - m END, 6) AS residual FROM m")
def _(spark, sf):
    f = view(spark, sf, "flights").withColumn("d", c("x") + c("row_id") * 1e-3)
    return T.metre_median_residual(f, ["line"], "d", "v", 120.0).select("row_id", "residual")


@query("threshold_despike", "WITH n AS (SELECT row_id, v, lag(v) OVER w AS b, lead(v) OVER w AS a FROM flights WINDOW w AS (PARTITION BY line ORDER BY row_id)), s AS (SELECT *, coalesce(abs(v - (a + b) / 2) > 40 AND (v - a) * (v - b) > 0, FALSE) AS spike FROM n) SELECT row_id, spike, round(CASE WHEN spike THEN (a + b) / 2 ELSE v END, 6) AS despiked FROM s")
def _(spark, sf):
    return T.threshold_despike(view(spark, sf, "flights"), ["line"], "v", 40.0).select("row_id", "spike", "despiked")


@query("default_gaps", "WITH s AS (SELECT line, t - lag(t) OVER (PARTITION BY line ORDER BY row_id) AS step FROM flights) SELECT line, round(2 * median(step), 6) AS max_gap FROM s WHERE step > 0 GROUP BY line")
def _(spark, sf):
    return T.default_gaps(view(spark, sf, "flights"), ["line"], "t")


@query("profile_parity", "WITH f AS (SELECT sensor, line AS profile, min(row_id) AS f FROM survey GROUP BY 1, 2) SELECT sensor, profile, CAST(row_number() OVER w AS INT) AS number, CAST(row_number() OVER w % 2 AS INT) AS parity FROM f WINDOW w AS (PARTITION BY sensor ORDER BY f)")
def _(spark, sf):
    return T.profile_parity(view(spark, sf, "survey").withColumnRenamed("line", "profile"), "sensor", "profile")


@query("display_envelope", "WITH n AS (SELECT line, count(*) AS n, min(row_id) AS lo, max(row_id) AS hi FROM flights GROUP BY 1), b AS (SELECT *, CAST(greatest(1, floor(1000 * n / sum(n) OVER ())) AS INT) AS bins FROM n) SELECT f.line, CAST(least(floor(coalesce((row_id - lo) / nullif(hi - lo, 0), 0) * bins), bins - 1) AS INT) AS bin, min(v) AS low, max(v) AS high, count(v) AS n FROM flights f JOIN b ON b.line = f.line GROUP BY 1, 2")
def _(spark, sf):
    return T.envelope(view(spark, sf, "flights"), "line", "row_id", "v", 2000)


@query("grid_despike", "WITH o AS (SELECT a.r, a.c, a.z, CASE WHEN a.r + i < 0 THEN -(a.r + i) ELSE a.r + i END AS r2, CASE WHEN a.c + j < 0 THEN -(a.c + j) WHEN a.c + j > 49 THEN 98 - (a.c + j) ELSE a.c + j END AS c2 FROM cells a, range(-1, 2) x(i), range(-1, 2) y(j)), q AS (SELECT o.*, b.z AS zn FROM o JOIN cells b ON b.r = r2 AND b.c = c2 WHERE b.z IS NOT NULL), m AS (SELECT r, c, any_value(z) AS z, median(zn) AS m FROM q GROUP BY 1, 2), d AS (SELECT q.r, q.c, median(abs(zn - m.m)) AS mad FROM q JOIN m ON m.r = q.r AND m.c = q.c GROUP BY 1, 2), s AS (SELECT m.*, coalesce(abs(z - m) > greatest(mad * 1.4826 * 3, 1e-12), FALSE) AS spike FROM m JOIN d ON d.r = m.r AND d.c = m.c) SELECT r, c, spike, round(CASE WHEN spike THEN m ELSE z END, 6) AS despiked FROM s")
def _(spark, sf):
    return T.grid_despike(view(spark, sf, "cells"), 1, 3.0, 10**9, 50)


@query("distance_bin_visits", "SELECT line, CAST(floor(x / 130) AS BIGINT) AS bin, min(row_id) AS row_id FROM flights GROUP BY 1, 2")
def _(spark, sf):
    return T.bin_visits(view(spark, sf, "flights"), ["line"], "x", 130.0)


@query("along_distance_join", """WITH b AS (SELECT line, x AS t0, avg(y) AS v0 FROM flights WHERE row_id % 2 = 0 GROUP BY 1, 2), n AS (SELECT *, lead(t0) OVER w AS t1, lead(v0) OVER w AS v1 FROM b WINDOW w AS (PARTITION BY line ORDER BY t0))
  SELECT f.row_id, round(CASE WHEN t1 IS NULL THEN v0 ELSE v0 + (v1 - v0) * (f.x - t0) / (t1 - t0) END, 6) AS tie_value FROM flights f LEFT JOIN n ON n.line = f.line AND f.x >= t0 AND (f.x < t1 OR t1 IS NULL AND f.x = t0) WHERE f.row_id % 2 = 1""")
def _(spark, sf):
    f = view(spark, sf, "flights")
    return T.along_distance(f.where("row_id % 2 = 1"), f.where("row_id % 2 = 0").select("line", c("x").alias("d"), "y"), ["line"], "x", "d", "y", 50.0, "tie_value").select("row_id", "tie_value")


_RUNS = "n AS (SELECT *, coalesce(row_id - lag(row_id) OVER w = 1 AND v IS NOT NULL AND lag(v) OVER w IS NOT NULL, FALSE) AS same FROM survey WINDOW w AS (PARTITION BY line ORDER BY row_id)), k AS (SELECT *, sum(CASE WHEN same THEN 0 ELSE 1 END) OVER (PARTITION BY line ORDER BY row_id) AS run FROM n)"


@query("moving_mean_runs", f"WITH {_RUNS} SELECT row_id, round(CASE WHEN count(v) OVER f = 5 THEN avg(v) OVER f END, 6) AS filtered FROM k WINDOW f AS (PARTITION BY line, run ORDER BY row_id ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING)")
def _(spark, sf):
    return L.filter_runs(view(spark, sf, "survey"), "v", ["line"], 5).select("row_id", "filtered")


@query("moving_median_runs", f"WITH {_RUNS} SELECT row_id, round(CASE WHEN count(v) OVER f = 7 THEN median(v) OVER f END, 6) AS filtered FROM k WINDOW f AS (PARTITION BY line, run ORDER BY row_id ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING)")
def _(spark, sf):
    return L.filter_runs(view(spark, sf, "survey"), "v", ["line"], 7, "median", size=1000).select("row_id", "filtered")


@query("table_digest", "SELECT line, count(*) AS rows, bit_xor(CAST('0x' || substr(md5(concat_ws(chr(31), CAST(row_id AS VARCHAR), coalesce(kind, chr(0)))), 1, 15) AS BIGINT)) AS digest FROM survey GROUP BY line")
def _(spark, sf):
    return table_digest(view(spark, sf, "survey"), ["row_id", "kind"], ["line"])
