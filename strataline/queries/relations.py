"""Joins, aggregations, sets and event windows."""

from __future__ import annotations

from pyspark.sql import Window, functions as F

from ..functions.numbers import is_finite
from ..operators import joins as J, stats
from .registry import query, table, view

# as-of interpolation: rovers against the base readings of the same sensor
_BASE = "base AS (SELECT t0, v0, lead(t0) OVER (ORDER BY t0) AS t1, lead(v0) OVER (ORDER BY t0) AS v1 FROM (SELECT t AS t0, avg(v) AS v0 FROM survey WHERE kind = 'view' AND v IS NOT NULL GROUP BY t))"


def _interpolated(spark, sf):
    s = view(spark, sf, "survey")
    base = s.where("kind = 'view'").select(F.col("t").alias("bt"), F.col("v").alias("bv"))
    return J.interpolate(s.where("kind <> 'view'").select("row_id", "t", "v"), base, "t", "bt", "bv", 3600.0)


@query("interpolate_base", f"WITH {_BASE}, r AS (SELECT row_id, t FROM survey WHERE kind <> 'view') SELECT row_id, round(CASE WHEN t1 IS NULL THEN CASE WHEN t = t0 THEN v0 END ELSE v0 + (v1 - v0) * (t - t0) / (t1 - t0) END, 5) AS interpolated FROM r ASOF LEFT JOIN base ON r.t >= base.t0", digits=5)
def _(spark, sf):
    return _interpolated(spark, sf).select("row_id", "interpolated")


@query("diurnal_correction", f"""WITH {_BASE}, r AS (SELECT row_id, t, v FROM survey WHERE kind <> 'view'), i AS (SELECT row_id, v, CASE WHEN t1 IS NULL THEN CASE WHEN t = t0 THEN v0 END ELSE v0 + (v1 - v0) * (t - t0) / (t1 - t0) END AS b FROM r ASOF LEFT JOIN base ON r.t >= base.t0)
  SELECT row_id, round(v - (b - (SELECT median(v0) FROM base)), 5) AS corrected FROM i""", digits=5)
def _(spark, sf):
    s = view(spark, sf, "survey").where("kind = 'view' and v is not null").groupBy("t").agg(F.avg("v").alias("v"))
    reference = s.agg(F.percentile("v", F.lit(0.5)).alias("reference"))
    i = _interpolated(spark, sf).crossJoin(F.broadcast(reference))
    return i.select("row_id", (F.col("v") - (F.col("interpolated") - F.col("reference"))).alias("corrected"))


@query("lag_shift", """WITH f AS (SELECT line, t AS t0, v AS v0, lead(t) OVER w AS t1, lead(v) OVER w AS v1 FROM flights WINDOW w AS (PARTITION BY line ORDER BY t)), q AS (SELECT row_id, line, t + 300 AS tq FROM flights)
  SELECT row_id, round(CASE WHEN t1 IS NOT NULL THEN v0 + (v1 - v0) * (tq - t0) / (t1 - t0) WHEN tq = t0 THEN v0 END, 5) AS shifted FROM q ASOF LEFT JOIN f ON q.line = f.line AND q.tq >= f.t0""", digits=5)
def _(spark, sf):
    f = view(spark, sf, "flights")
    own = f.select("line", F.col("t").alias("bt"), F.col("v").alias("bv"))
    return J.interpolate(f.select("row_id", "line", (F.col("t") + 300).alias("tq")), own, "tq", "bt", "bv", 86400.0, ["line"], into="shifted").select("row_id", "shifted")


_NEAR = "n AS (SELECT a.id, b.id AS other, sqrt(pow(a.x - b.x, 2) + pow(a.y - b.y, 2)) AS d, b.v, row_number() OVER (PARTITION BY a.id ORDER BY sqrt(pow(a.x - b.x, 2) + pow(a.y - b.y, 2)), b.id) AS rk FROM points a JOIN points b ON a.id % 2 = 0 AND b.id % 2 = 1 AND sqrt(pow(a.x - b.x, 2) + pow(a.y - b.y, 2)) <= 40)"


def _near(spark, sf, k):
    p = view(spark, sf, "points")
    return J.neighbours(p.where("id % 2 = 0"), p.where("id % 2 = 1").withColumnRenamed("id", "other"), "x", "y", "other", 40.0, k, left_id="id", carry=["v"])


@query("nearest_pair", f"WITH {_NEAR} SELECT id, other, round(d, 6) AS distance FROM n WHERE rk = 1")
def _(spark, sf):
    return _near(spark, sf, 1).select("id", "other", "distance")


@query("nearest_neighbours_k", f"WITH {_NEAR} SELECT id, other, round(d, 6) AS distance, CAST(rk AS INT) AS rank FROM n WHERE rk <= 4")
def _(spark, sf):
    return _near(spark, sf, 4).select("id", "other", "distance", "rank")


@query("grid_idw", f"WITH {_NEAR} SELECT id, round(coalesce(avg(v) FILTER (d <= 1e-12), sum(v * pow(nullif(d, 0), -2)) / sum(pow(nullif(d, 0), -2))), 6) AS estimate, count(*) AS n_near FROM n WHERE rk <= 6 GROUP BY id")
def _(spark, sf):
    return J.inverse_distance(_near(spark, sf, 6), "id", "v")


@query("repeat_line_quality", """WITH l AS (SELECT CAST(id % 5 AS INT) AS line, id, x, y, v FROM points), ref AS (SELECT * FROM l WHERE line = 0), n AS (SELECT a.line, a.id, a.v - b.v AS residual, row_number() OVER (PARTITION BY a.id ORDER BY sqrt(pow(a.x - b.x, 2) + pow(a.y - b.y, 2)), b.id) AS rk FROM l a JOIN ref b ON a.line <> 0 AND sqrt(pow(a.x - b.x, 2) + pow(a.y - b.y, 2)) <= 60),
  m AS (SELECT line, count(*) AS matched, median(residual) AS med FROM n WHERE rk = 1 GROUP BY line), r AS (SELECT n.line, abs(residual - med) AS off, residual - med AS res FROM n JOIN m USING (line) WHERE rk = 1)
  SELECT r.line, any_value(matched) AS matched, round(any_value(med), 6) AS median, round(1.4826 * median(off), 6) AS mad_sigma, round(sqrt(avg(res * res)), 6) AS rms_after FROM r JOIN m ON r.line = m.line GROUP BY r.line""")
def _(spark, sf):
    p = view(spark, sf, "points").withColumn("line", (F.col("id") % 5).cast("int"))
    ref = p.where("line = 0").select(F.col("id").alias("ref_id"), "x", "y", F.col("v").alias("ref_v"))
    near = J.neighbours(p.where("line <> 0"), ref, "x", "y", "ref_id", 60.0, 1, left_id="id", carry=["ref_v"], keep=["line", "v"])
    r = near.withColumn("residual", F.col("v") - F.col("ref_v"))
    w = Window.partitionBy("line")
    r = r.withColumn("median", F.percentile("residual", F.lit(0.5)).over(w)).withColumn("res", F.col("residual") - F.col("median"))
    return r.groupBy("line").agg(F.count("*").alias("matched"), F.first("median").alias("median"), (F.percentile(F.abs("res"), F.lit(0.5)) * 1.4826).alias("mad_sigma"), F.sqrt(F.avg(F.col("res") * F.col("res"))).alias("rms_after"))


@query("reciprocal_quality", """WITH k AS (SELECT least(a, b) AS a, greatest(a, b) AS b, least(m, n) AS m, greatest(m, n) AS n, (CASE WHEN a < b THEN 1 ELSE -1 END) * (CASE WHEN m < n THEN 1 ELSE -1 END) * resistance AS r FROM quads),
  g AS (SELECT a, b, m, n, avg(r) AS r, count(*) AS repeats FROM k GROUP BY ALL) SELECT f.a, f.b, f.m, f.n, f.repeats, o.repeats AS repeats_back, round(200 * abs(f.r - o.r) / nullif(abs(f.r) + abs(o.r), 0), 6) AS error_percent FROM g f JOIN g o ON f.a = o.m AND f.b = o.n AND f.m = o.a AND f.n = o.b WHERE (f.a, f.b) < (f.m, f.n)""")
def _(spark, sf):
    return J.reciprocal_errors(view(spark, sf, "quads"), "a", "b", "m", "n", "resistance").select("a", "b", "m", "n", "repeats", "repeats_back", "error_percent")


_VG = "v AS (SELECT sqrt(pow(a.x - b.x, 2) + pow(a.y - b.y, 2)) AS h, pow(a.v - b.v, 2) / 2 AS g FROM points a JOIN points b ON a.id < b.id AND abs(a.x - b.x) <= 60 AND abs(a.y - b.y) <= 60)"


@query("empirical_variogram", f"WITH {_VG} SELECT CAST(least(floor(h / 10), 5) AS INT) AS lag, count(*) AS pairs, round(avg(h), 4) AS mean_distance, round(avg(g), 4) AS semivariance FROM v WHERE h <= 60 GROUP BY 1", digits=4)
def _(spark, sf):
    return J.variogram(view(spark, sf, "points"), "id", "x", "y", "v", 10.0, 6)


# detectors: the embeddings as spectra of 64 bins
_SPEC = "sp AS (SELECT vec_id, i - 1 AS bin, abs(CAST(embedding[i] AS DOUBLE)) * 100 AS counts FROM embeddings, range(1, 65) r(i))"


def _spectra(spark, sf):
    return table(spark, sf, "embeddings").select("vec_id", F.posexplode("embedding").alias("bin", "e")).select("vec_id", "bin", (F.abs(F.col("e").cast("double")) * 100).alias("counts"))


@query("energy_rebin", f"WITH {_SPEC}, e AS (SELECT vec_id, counts, bin * 3e0 AS lo, (bin + 1) * 3e0 AS hi FROM sp), o AS (SELECT k, k * 7e0 AS olo, (k + 1) * 7e0 AS ohi FROM range(0, 28) r(k)) SELECT vec_id, CAST(k AS INT) AS k, round(sum(counts * (least(hi, ohi) - greatest(lo, olo)) / (hi - lo)), 5) AS counts FROM e JOIN o ON least(hi, ohi) > greatest(lo, olo) GROUP BY 1, 2", digits=5)
def _(spark, sf):
    e = _spectra(spark, sf).select("vec_id", "counts", (F.col("bin") * 3.0).alias("lo"), ((F.col("bin") + 1) * 3.0).alias("hi"))
    o = spark.range(28).select(F.col("id").cast("int").alias("k"), (F.col("id") * 7.0).alias("olo"), ((F.col("id") + 1) * 7.0).alias("ohi"))
    met = J.overlaps(e, o, ("lo", "hi"), ("olo", "ohi"), 21.0)
    return met.groupBy("vec_id", "k").agg(F.sum(F.col("counts") * F.col("overlap") / (F.col("hi") - F.col("lo"))).alias("counts"))


@query("integrate_windows", f"WITH {_SPEC}, w AS (SELECT * FROM (VALUES ('k', 10e0, 22e0), ('u', 22e0, 30e0), ('th', 41e0, 60e0)) t(name, a, b)) SELECT vec_id, name, round(sum(counts * (least(bin + 1e0, b) - greatest(bin + 0e0, a))), 5) AS counts FROM sp JOIN w ON least(bin + 1e0, b) > greatest(bin + 0e0, a) GROUP BY 1, 2", digits=5)
def _(spark, sf):
    e = _spectra(spark, sf).select("vec_id", "counts", F.col("bin").cast("double").alias("lo"), (F.col("bin") + 1.0).alias("hi"))
    w = spark.sql("SELECT * FROM VALUES ('k', 10D, 22D), ('u', 22D, 30D), ('th', 41D, 60D) AS t(name, a, b)")
    return J.overlaps(e, w, ("lo", "hi"), ("a", "b"), 16.0).groupBy("vec_id", "name").agg(F.sum(F.col("counts") * F.col("overlap")).alias("counts"))


@query("stack_transients", f"WITH {_SPEC} SELECT label, CAST(bin AS INT) AS sample, count(*) AS n, round(avg(counts * CASE WHEN sp.vec_id % 2 = 0 THEN 1 ELSE -1 END), 6) AS mean, round(stddev_samp(counts * CASE WHEN sp.vec_id % 2 = 0 THEN 1 ELSE -1 END) / sqrt(count(*)), 6) AS standard_error FROM sp JOIN embeddings USING (vec_id) WHERE isfinite(counts) GROUP BY 1, 2")
def _(spark, sf):
    s = _spectra(spark, sf).join(table(spark, sf, "embeddings").select("vec_id", "label"), "vec_id").where(is_finite(F.col("counts")))  # what is finite is accepted
    v = F.col("counts") * F.when(F.col("vec_id") % 2 == 0, 1).otherwise(-1)
    return s.groupBy("label", F.col("bin").alias("sample")).agg(F.count("*").alias("n"), F.avg(v).alias("mean"), F.try_divide(F.stddev_samp(v), F.sqrt(F.count("*"))).alias("standard_error"))


@query("integrated_chargeability", f"""WITH {_SPEC}, p AS (SELECT vec_id, bin * 0.1 AS t0, counts AS v0, lead(bin * 0.1) OVER w AS t1, lead(counts) OVER w AS v1 FROM sp WINDOW w AS (PARTITION BY vec_id ORDER BY bin)), c AS (SELECT *, greatest(t0, 0.55) AS a, least(t1, 2.35) AS b FROM p WHERE t1 IS NOT NULL)
  SELECT vec_id, round(1000 * sum((b - a) * ((v0 + (v1 - v0) * (a - t0) / (t1 - t0)) + (v0 + (v1 - v0) * (b - t0) / (t1 - t0))) / 2) / 1.8 / 50, 5) AS chargeability FROM c WHERE b > a GROUP BY vec_id""", digits=5)
def _(spark, sf):
    w = Window.partitionBy("vec_id").orderBy("bin")
    p = _spectra(spark, sf).select("vec_id", (F.col("bin") * 0.1).alias("t0"), F.col("counts").alias("v0"), F.lead(F.col("bin") * 0.1).over(w).alias("t1"), F.lead("counts").over(w).alias("v1")).where("t1 is not null")
    p = p.withColumn("a", F.greatest("t0", F.lit(0.55))).withColumn("b", F.least("t1", F.lit(2.35))).where("b > a")
    at = lambda q: F.col("v0") + (F.col("v1") - F.col("v0")) * (F.col(q) - F.col("t0")) / (F.col("t1") - F.col("t0"))
    return p.groupBy("vec_id").agg((F.sum((F.col("b") - F.col("a")) * (at("a") + at("b")) / 2) * 1000 / 1.8 / 50).alias("chargeability"))


@query("trace_background", f"WITH {_SPEC} SELECT vec_id, CAST(bin AS INT) AS sample, round(counts - avg(counts) OVER (PARTITION BY bin), 6) AS residual FROM sp")
def _(spark, sf):
    return _spectra(spark, sf).select("vec_id", F.col("bin").alias("sample"), (F.col("counts") - F.avg("counts").over(Window.partitionBy("bin"))).alias("residual"))


@query("dewow", f"WITH {_SPEC} SELECT vec_id, CAST(bin AS INT) AS sample, round(counts - avg(counts) OVER (PARTITION BY vec_id ORDER BY bin ROWS BETWEEN 4 PRECEDING AND 4 FOLLOWING), 6) AS residual FROM sp")
def _(spark, sf):
    w = Window.partitionBy("vec_id").orderBy("bin").rowsBetween(-4, 4)
    return _spectra(spark, sf).select("vec_id", F.col("bin").alias("sample"), (F.col("counts") - F.avg("counts").over(w)).alias("residual"))


@query("normal_moveout_stack", f"""WITH {_SPEC}, o AS (SELECT vec_id, (vec_id % 12) * 0.2 AS off, bin, counts FROM sp), q AS (SELECT vec_id, bin AS t0, sqrt(bin * bin + off * off) AS tt FROM o WHERE bin > 0), s AS (SELECT q.vec_id, q.t0, a.counts + (b.counts - a.counts) * (tt - floor(tt)) AS v FROM q JOIN sp a ON a.vec_id = q.vec_id AND a.bin = floor(tt) JOIN sp b ON b.vec_id = q.vec_id AND b.bin = floor(tt) + 1 WHERE tt / t0 <= 1.5)
  SELECT CAST(t0 AS INT) AS sample, count(*) AS fold, round(avg(v), 5) AS stacked FROM s GROUP BY 1 HAVING count(*) >= 3""", digits=5)
def _(spark, sf):
    s = _spectra(spark, sf)
    q = s.where("bin > 0").select("vec_id", F.col("bin").alias("t0"), F.sqrt(F.col("bin") * F.col("bin") + F.pow((F.col("vec_id") % 12) * 0.2, F.lit(2.0))).alias("tt"))
    q = q.where("tt / t0 <= 1.5").withColumn("bin", F.floor("tt").cast("int"))
    nxt = s.select("vec_id", (F.col("bin") - 1).alias("bin"), F.col("counts").alias("after"))
    v = F.col("counts") + (F.col("after") - F.col("counts")) * (F.col("tt") - F.floor("tt"))
    return q.join(s, ["vec_id", "bin"]).join(nxt, ["vec_id", "bin"]).groupBy(F.col("t0").alias("sample")).agg(F.count("*").alias("fold"), F.avg(v).alias("stacked")).where("fold >= 3")


# channels and statistics
@query("channel_quality", "SELECT line, count(*) AS cells, count(v) AS finite_cells, count(*) - count(v) AS missing_cells, count(*) FILTER (v < 3) AS negative_cells, min(v) AS minimum, max(v) AS maximum, round(avg(v), 6) AS mean, round(stddev_pop(v), 6) AS standard_deviation, round(quantile_cont(v, 0.02), 6) AS p02, round(median(v), 6) AS median, round(quantile_cont(v, 0.98), 6) AS p98 FROM survey GROUP BY line")
def _(spark, sf):
    return stats.channel_quality(view(spark, sf, "survey"), "v", ["line"], 3.0)


_STRETCH = "b AS (SELECT " + ", ".join(f"quantile_cont({c}, 0.02) AS {c}l, quantile_cont({c}, 0.98) AS {c}h" for c in ("k", "u", "th")) + " FROM stations)"


def _stretches(spark, sf):
    s = view(spark, sf, "stations")
    return s.crossJoin(F.broadcast(stats.stretch_bounds(s, ["k", "u", "th"])))


@query("robust_stretch", f"WITH {_STRETCH} SELECT id, round(greatest(0, least(1, (u - ul) / (uh - ul))), 6) AS stretched FROM stations, b")
def _(spark, sf):
    return _stretches(spark, sf).select("id", stats.stretched("u").alias("stretched"))


@query("radiometry_ternary", f"WITH {_STRETCH} SELECT id, " + ", ".join(f"round_even(greatest(0, least(1, ({c} - {c}l) / ({c}h - {c}l))) * 255, 0) AS {n}" for c, n in (("k", "red"), ("th", "green"), ("u", "blue"))) + " FROM stations, b")
def _(spark, sf):
    return _stretches(spark, sf).select("id", *[F.rint(stats.stretched(c) * 255).alias(n) for c, n in (("k", "red"), ("th", "green"), ("u", "blue"))])


@query("value_histogram", "SELECT line, CAST(least(floor(v / 25), 9) AS INT) AS bin, count(*) AS n FROM survey WHERE v BETWEEN 0 AND 250 GROUP BY 1, 2")
def _(spark, sf):
    return stats.histogram(view(spark, sf, "survey"), "v", 0.0, 25.0, 10, ["line"])


@query("orientation_entropy", "WITH c AS (SELECT CAST(id % 11 AS INT) AS part, floor(az / 20) AS b, count(*) AS n FROM stations GROUP BY 1, 2), p AS (SELECT part, n / sum(n) OVER (PARTITION BY part) AS p FROM c) SELECT part, round(-sum(p * log2(p)), 6) AS entropy, count(*) AS categories FROM p GROUP BY part")
def _(spark, sf):
    s = view(spark, sf, "stations").select((F.col("id") % 11).cast("int").alias("part"), F.floor(F.col("az") / 20).alias("b"))
    return stats.entropy(s, ["part"], "b")


@query("length_weighted_median", "WITH r AS (SELECT line, v, sum(clearance) OVER (PARTITION BY line ORDER BY v) AS run, sum(clearance) OVER (PARTITION BY line) AS total FROM flights) SELECT line, min(v) AS weighted_median FROM r WHERE run >= total / 2 GROUP BY line")
def _(spark, sf):
    return stats.weighted_median(view(spark, sf, "flights"), ["line"], "v", "clearance")


@query("weighted_centroid", "SELECT line, round(sum(x * v) / sum(v), 6) AS cx, round(sum(y * v) / sum(v), 6) AS cy FROM flights GROUP BY line")
def _(spark, sf):
    v = F.sum("v")
    return view(spark, sf, "flights").groupBy("line").agg((F.sum(F.col("x") * F.col("v")) / v).alias("cx"), (F.sum(F.col("y") * F.col("v")) / v).alias("cy"))


@query("pearson_and_regression", "SELECT line, round(corr(v, x), 6) AS r, round(regr_slope(v, x), 6) AS slope, round(regr_intercept(v, x), 6) AS level FROM flights GROUP BY line")
def _(spark, sf):
    return view(spark, sf, "flights").groupBy("line").agg(F.corr("v", "x").alias("r"), F.regr_slope("v", "x").alias("slope"), F.regr_intercept("v", "x").alias("level"))


@query("covariance_pca", "SELECT CAST(id % 4 AS INT) AS part, round(covar_samp(k, u), 6) AS ku, round(covar_samp(k, th), 6) AS kth, round(var_samp(k), 6) AS kk, round((var_samp(k) + var_samp(u) + sqrt(pow(var_samp(k) - var_samp(u), 2) + 4 * pow(covar_samp(k, u), 2))) / 2, 6) AS major FROM stations GROUP BY 1")
def _(spark, sf):
    kk, uu, ku = F.var_samp("k"), F.var_samp("u"), F.covar_samp("k", "u")
    return view(spark, sf, "stations").groupBy((F.col("id") % 4).cast("int").alias("part")).agg(ku.alias("ku"), F.covar_samp("k", "th").alias("kth"), kk.alias("kk"), ((kk + uu + F.sqrt(F.pow(kk - uu, F.lit(2.0)) + F.pow(ku, F.lit(2.0)) * 4)) / 2).alias("major"))


@query("argmax_by_line", "SELECT line, max(v) AS peak, min(row_id) FILTER (v = m) AS at_row FROM (SELECT *, max(v) OVER (PARTITION BY line) AS m FROM flights) GROUP BY line")
def _(spark, sf):
    return view(spark, sf, "flights").groupBy("line").agg(F.max("v").alias("peak"), F.max_by("row_id", F.struct("v", -F.col("row_id"))).alias("at_row"))


@query("approx_distinct_bound", "SELECT kind, count(DISTINCT line) AS lines, count(DISTINCT y) AS tracks FROM survey GROUP BY kind")
def _(spark, sf):
    return view(spark, sf, "survey").groupBy("kind").agg(F.countDistinct("line").alias("lines"), F.countDistinct("y").alias("tracks"))


for _name, _clause in (("cube", "CUBE (kind, sensor)"), ("rollup", "ROLLUP (kind, sensor)"), ("grouping_sets", "GROUPING SETS ((kind), (sensor), ())")):

    @query(f"{_name}_quality", f"SELECT kind, sensor, count(*) AS n, round(avg(v), 6) AS mean, max(v) AS high FROM survey GROUP BY {_clause}")
    def _(spark, sf, how=_name):
        s = view(spark, sf, "survey")
        aggs = (F.count("*").alias("n"), F.avg("v").alias("mean"), F.max("v").alias("high"))
        if how == "cube":
            return s.cube("kind", "sensor").agg(*aggs)
        if how == "rollup":
            return s.rollup("kind", "sensor").agg(*aggs)
        return s.groupingSets([["kind"], ["sensor"], []], "kind", "sensor").agg(*aggs)


@query("tolerance_matrix", "SELECT a, b, count(*) FILTER (abs(x - 300) <= a AND abs(y - 300) <= b) AS n, round(avg(v) FILTER (abs(x - 300) <= a AND abs(y - 300) <= b), 6) AS mean FROM points, (VALUES (50e0), (120e0), (240e0)) s(a), (VALUES (40e0), (160e0)) t(b) GROUP BY a, b")
def _(spark, sf):
    tries = F.explode(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a in (50.0, 120.0, 240.0) for b in (40.0, 160.0)]))
    p = view(spark, sf, "points").withColumn("s", tries).select("v", "s.*", ((F.abs(F.col("x") - 300) <= F.col("s.a")) & (F.abs(F.col("y") - 300) <= F.col("s.b"))).alias("inside"))
    return p.groupBy("a", "b").agg(F.count_if("inside").alias("n"), F.avg(F.when(F.col("inside"), F.col("v"))).alias("mean"))


# crossovers
_CROSS = "m AS (SELECT median(residual) AS med FROM crossings), d AS (SELECT median(abs(residual - med)) AS mad FROM crossings, m), k AS (SELECT c.*, mad = 0 OR abs(residual - med) <= 1.2 * 1.4826 * mad AS accepted FROM crossings c, m, d)"


@query("crossover_outliers", f"WITH {_CROSS} SELECT tie, count(*) AS n, count(*) FILTER (accepted) AS kept, round(avg(residual) FILTER (accepted), 6) AS mean_kept FROM k GROUP BY tie")
def _(spark, sf):
    k = stats.robust_keep(view(spark, sf, "crossings"), "residual", 1.2)
    return k.groupBy("tie").agg(F.count("*").alias("n"), F.count_if("accepted").alias("kept"), F.avg(F.when(F.col("accepted"), F.col("residual"))).alias("mean_kept"))


@query("level_ties_order0", "WITH m AS (SELECT traverse, avg(residual) AS mean FROM crossings GROUP BY traverse) SELECT traverse, round(-mean, 6) AS correction, round(sqrt(avg(residual * residual)), 6) AS rms_before, round(sqrt(avg(pow(residual - mean, 2))), 6) AS rms_after FROM crossings JOIN m USING (traverse) GROUP BY traverse, mean")
def _(spark, sf):
    c = view(spark, sf, "crossings").withColumn("mean", F.avg("residual").over(Window.partitionBy("traverse")))
    return c.groupBy("traverse").agg((-F.first("mean")).alias("correction"), F.sqrt(F.avg(F.col("residual") * F.col("residual"))).alias("rms_before"), F.sqrt(F.avg(F.pow(F.col("residual") - F.col("mean"), F.lit(2.0)))).alias("rms_after"))


@query("residual_statistics", "SELECT tie, count(*) AS n, round(sqrt(avg(residual * residual)), 6) AS rms, round(avg(abs(residual)), 6) AS mae, round(quantile_cont(abs(residual), 0.95), 6) AS p95, max(abs(residual)) AS worst FROM crossings GROUP BY tie")
def _(spark, sf):
    r = F.col("residual")
    return view(spark, sf, "crossings").groupBy("tie").agg(F.count("*").alias("n"), F.sqrt(F.avg(r * r)).alias("rms"), F.avg(F.abs(r)).alias("mae"), F.percentile(F.abs(r), F.lit(0.95)).alias("p95"), F.max(F.abs(r)).alias("worst"))


@query("normal_equations", "SELECT traverse AS i, tie AS j, count(*) AS ata, round(sum(residual), 4) AS atb FROM crossings GROUP BY 1, 2", digits=4)
def _(spark, sf):
    return view(spark, sf, "crossings").groupBy(F.col("traverse").alias("i"), F.col("tie").alias("j")).agg(F.count("*").alias("ata"), F.sum("residual").alias("atb"))


# lookups and guards
@query("line_constant_lookup", "SELECT row_id, round(v + coalesce(c, 0), 6) AS corrected FROM survey LEFT JOIN (VALUES (0, 1.5e0), (3, -2.25e0), (7, 0.5e0)) k(line, c) USING (line)")
def _(spark, sf):
    k = spark.sql("SELECT * FROM VALUES (0, 1.5D), (3, -2.25D), (7, 0.5D) AS k(line, c)")
    return J.lookup(view(spark, sf, "survey"), k, "line", "c", 0.0).select("row_id", (F.col("v") + F.col("c")).alias("corrected"))


@query("missing_line_guard", "SELECT DISTINCT line FROM survey WHERE line NOT IN (0, 3, 7)")
def _(spark, sf):
    return J.missing_keys(view(spark, sf, "survey"), spark.sql("SELECT * FROM VALUES (0), (3), (7) AS k(line)"), "line")


@query("semi_join_labels", "SELECT o_orderkey, o_totalprice FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')")
def _(spark, sf):
    building = table(spark, sf, "customer").where("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("o_custkey"))
    return table(spark, sf, "orders").join(building, "o_custkey", "left_semi").select("o_orderkey", "o_totalprice")


@query("positional_join", "SELECT a.event_id AS row_id, a.value AS mag, b.value * 2 AS doubled, a.value - b.value * 2 AS difference FROM events a JOIN events b USING (event_id)")
def _(spark, sf):
    e = table(spark, sf, "events")
    a, b = e.select(F.col("event_id").alias("row_id"), F.col("value").alias("mag")), e.select(F.col("event_id").alias("row_id"), (F.col("value") * 2).alias("doubled"))
    return a.join(b, "row_id").select("row_id", "mag", "doubled", (F.col("mag") - F.col("doubled")).alias("difference"))


@query("membership_filter", "SELECT row_id, line, v FROM survey WHERE line IN (1, 4) AND kind IN ('view', 'click')")
def _(spark, sf):
    return view(spark, sf, "survey").where(F.col("line").isin(1, 4) & F.col("kind").isin("view", "click")).select("row_id", "line", "v")


@query("page_offset_limit", "SELECT row_id, v FROM survey ORDER BY row_id LIMIT 51 OFFSET 200")
def _(spark, sf):
    return view(spark, sf, "survey").select("row_id", "v").orderBy("row_id").offset(200).limit(51)


@query("distinct_group_values", "SELECT DISTINCT kind, sensor FROM survey")
def _(spark, sf):
    return view(spark, sf, "survey").select("kind", "sensor").distinct()


@query("top_features", "SELECT line, row_id, v FROM (SELECT *, row_number() OVER (PARTITION BY line ORDER BY v DESC, row_id) AS k FROM flights) WHERE k <= 3")
def _(spark, sf):
    k = F.row_number().over(Window.partitionBy("line").orderBy(F.desc("v"), "row_id"))
    return view(spark, sf, "flights").withColumn("k", k).where("k <= 3").select("line", "row_id", "v")


@query("first_sample_per_bin", "WITH b AS (SELECT *, row_number() OVER (PARTITION BY line, floor(x / 100) ORDER BY row_id) AS k FROM flights) SELECT line, floor(x / 100) AS bin, v FROM b WHERE k = 1")
def _(spark, sf):
    f = view(spark, sf, "flights").withColumn("bin", F.floor(F.col("x") / 100).cast("double"))
    return f.withColumn("k", F.row_number().over(Window.partitionBy("line", "bin").orderBy("row_id"))).where("k = 1").select("line", "bin", "v")


# sets
@query("union_layers", "SELECT line, count(*) AS n FROM (SELECT line, v FROM survey WHERE sensor = 0 UNION ALL SELECT line, v FROM survey WHERE sensor = 1) GROUP BY line")
def _(spark, sf):
    s = view(spark, sf, "survey")
    return s.where("sensor = 0").select("line", "v").unionByName(s.where("sensor = 1").select("line", "v")).groupBy("line").agg(F.count("*").alias("n"))


@query("intersect_support", "SELECT line, kind FROM survey WHERE v > 200 INTERSECT SELECT line, kind FROM survey WHERE v < 1")
def _(spark, sf):
    s = view(spark, sf, "survey")
    return s.where("v > 200").select("line", "kind").intersect(s.where("v < 1").select("line", "kind"))


@query("except_support", "SELECT line, kind FROM survey WHERE v < 1 EXCEPT SELECT line, kind FROM survey WHERE v > 200")
def _(spark, sf):
    s = view(spark, sf, "survey")
    return s.where("v < 1").select("line", "kind").subtract(s.where("v > 200").select("line", "kind"))


@query("archive_verify", "SELECT count(*) AS differences FROM ((SELECT event_id, value FROM events EXCEPT ALL SELECT event_id, CASE WHEN event_id % 500 = 7 THEN value + 1 ELSE value END FROM events) UNION ALL (SELECT event_id, CASE WHEN event_id % 500 = 7 THEN value + 1 ELSE value END FROM events EXCEPT ALL SELECT event_id, value FROM events))")
def _(spark, sf):
    e = table(spark, sf, "events").select("event_id", "value")
    other = e.select("event_id", F.when(F.col("event_id") % 500 == 7, F.col("value") + 1).otherwise(F.col("value")).alias("value"))
    return e.exceptAll(other).unionAll(other.exceptAll(e)).agg(F.count("*").alias("differences"))


@query("deduplicate_crossings", "SELECT DISTINCT traverse, tie, round(residual, 0) AS residual FROM crossings")
def _(spark, sf):
    return view(spark, sf, "crossings").select("traverse", "tie", F.round("residual", 0).alias("residual")).dropDuplicates()


# catalogue shapes
@query("latest_version", "SELECT user_id AS channel, event_id AS version, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS k FROM events) WHERE k = 1")
def _(spark, sf):
    return table(spark, sf, "events").groupBy(F.col("user_id").alias("channel")).agg(F.max("event_id").alias("version"), F.max_by("value", "event_id").alias("value"))


@query("lineage_recursive", "WITH RECURSIVE up(id, depth) AS (SELECT CAST(1999 AS BIGINT), 0 UNION ALL SELECT id // 3, depth + 1 FROM up WHERE id > 0) SELECT id, depth, p_retailprice AS price FROM up JOIN part ON p_partkey = id")
def _(spark, sf):
    part = table(spark, sf, "part")
    walk = spark.sql("WITH RECURSIVE up(id, depth) AS (SELECT CAST(1999 AS BIGINT), 0 UNION ALL SELECT id div 3, depth + 1 FROM up WHERE id > 0) SELECT * FROM up")
    return walk.join(part.select(F.col("p_partkey").alias("id"), F.col("p_retailprice").alias("price")), "id").select("id", "depth", "price")


@query("regional_dimension_join", "SELECT r_name, n_name, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY 1, 2", digits=2)
def _(spark, sf):
    j = table(spark, sf, "orders").join(table(spark, sf, "customer"), F.col("o_custkey") == F.col("c_custkey")).join(table(spark, sf, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).join(table(spark, sf, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return j.groupBy("r_name", "n_name").agg(F.count("*").alias("n"), F.sum("o_totalprice").alias("total"))


# text keys and JSON
@query("string_role_key", "SELECT DISTINCT p_brand AS name, regexp_replace(lower(p_brand), '[^a-z0-9]', '', 'g') AS role_key FROM part")
def _(spark, sf):
    from ..functions.text import role_key

    return table(spark, sf, "part").select(F.col("p_brand").alias("name"), role_key(F.col("p_brand")).alias("role_key")).distinct()


@query("line_kind_from_name", "SELECT id, name, CASE WHEN name LIKE 'TL%' THEN 'tie' WHEN name LIKE 'T%' THEN 'tie' WHEN name LIKE 'FL%' OR name LIKE 'L%' THEN 'traverse' ELSE 'other' END AS kind, TRY_CAST(regexp_extract(name, '([0-9]+)$', 1) AS BIGINT) AS number FROM (SELECT p_partkey AS id, CASE p_partkey % 5 WHEN 0 THEN 'L' WHEN 1 THEN 'FL' WHEN 2 THEN 'T' WHEN 3 THEN 'TL' ELSE 'x' END || CAST(p_size AS VARCHAR) AS name FROM part)")
def _(spark, sf):
    from ..functions.text import line_kind, trailing_number

    names = table(spark, sf, "part").select(F.col("p_partkey").alias("id"), F.concat(F.element_at(F.array(*map(F.lit, ("L", "FL", "T", "TL", "x"))), (F.col("p_partkey") % 5 + 1).cast("int")), F.col("p_size").cast("string")).alias("name"))
    return names.select("id", "name", line_kind(F.col("name")).alias("kind"), trailing_number(F.col("name")).alias("number"))


@query("strict_numbers", "SELECT DISTINCT text, CASE WHEN regexp_full_match(text, '[+-]?[0-9]+') THEN TRY_CAST(text AS BIGINT) END AS whole, CASE WHEN regexp_full_match(text, '[+-]?([0-9]+[.]?[0-9]*|[.][0-9]+)') THEN TRY_CAST(text AS DOUBLE) END AS number FROM (SELECT CASE p_partkey % 4 WHEN 0 THEN CAST(p_size AS VARCHAR) WHEN 1 THEN '-' || CAST(p_size AS VARCHAR) || '.5' WHEN 2 THEN '1,5' ELSE p_brand END AS text FROM part)")
def _(spark, sf):
    from ..functions.text import strict_double, strict_long

    size = F.col("p_size").cast("string")
    t = F.when(F.col("p_partkey") % 4 == 0, size).when(F.col("p_partkey") % 4 == 1, F.concat(F.lit("-"), size, F.lit(".5"))).when(F.col("p_partkey") % 4 == 2, "1,5").otherwise(F.col("p_brand"))
    return table(spark, sf, "part").select(t.alias("text")).distinct().select("text", strict_long(F.col("text")).alias("whole"), strict_double(F.col("text")).alias("number"))


@query("json_properties", "SELECT CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1", digits=4)
def _(spark, sf):
    return table(spark, sf, "events").groupBy(F.get_json_object("props", "$.k").cast("long").alias("k")).agg(F.count("*").alias("n"), F.sum("value").alias("total"))


# event-time windows
@query("tumbling_windows", "SELECT epoch_us(time_bucket(INTERVAL 1 HOUR, ts)) // 1000000 AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2", digits=4)
def _(spark, sf):
    return table(spark, sf, "events").groupBy(F.window(F.col("ts").cast("timestamp"), "1 hour").alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.unix_seconds("w.start").alias("start"), "event_type", "n", "total")


@query("sliding_windows", "SELECT s AS start, count(*) AS n, round(avg(value), 6) AS mean FROM events, (SELECT unnest([0, 1]) AS k), LATERAL (SELECT (epoch_us(ts) // 3600000000 - k) * 3600 AS s) GROUP BY 1")
def _(spark, sf):
    w = F.window(F.col("ts").cast("timestamp"), "2 hours", "1 hour").alias("w")
    return table(spark, sf, "events").groupBy(w).agg(F.count("*").alias("n"), F.avg("value").alias("mean")).select(F.unix_seconds("w.start").alias("start"), "n", "mean")


@query("session_gap", "WITH g AS (SELECT *, CASE WHEN epoch_us(ts) - lag(epoch_us(ts)) OVER w < 7200000000 THEN 0 ELSE 1 END AS fresh FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)), s AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts) AS k FROM g) SELECT user_id, min(epoch_us(ts)) AS start_us, count(*) AS n, max(value) AS high FROM s GROUP BY user_id, k")
def _(spark, sf):
    w = F.session_window(F.col("ts").cast("timestamp"), "2 hours").alias("w")
    return table(spark, sf, "events").groupBy("user_id", w).agg(F.count("*").alias("n"), F.max("value").alias("high")).select("user_id", F.unix_micros("w.start").alias("start_us"), "n", "high")


# kernel sums over a few sources, which every observation meets by explode, not by a cross join
@query("dipole_forward", "SELECT id, round(sum(1e5 * m * (2 * dz * dz - dx * dx - dy * dy) / pow(dx * dx + dy * dy + dz * dz, 2.5)), 6) AS field FROM (SELECT id, x - sx AS dx, y - sy AS dy, 50e0 AS dz, m FROM points, (VALUES (100e0, 200e0, 3e0), (400e0, 300e0, -2e0)) s(sx, sy, m)) GROUP BY id")
def _(spark, sf):
    sources = F.inline(F.array(*[F.struct(F.lit(a).alias("sx"), F.lit(b).alias("sy"), F.lit(m).alias("m")) for a, b, m in ((100.0, 200.0, 3.0), (400.0, 300.0, -2.0))]))
    p = view(spark, sf, "points").select("id", "x", "y", sources)
    dx, dy, dz = F.col("x") - F.col("sx"), F.col("y") - F.col("sy"), F.lit(50.0)
    field = F.col("m") * 1e5 * (dz * dz * 2 - dx * dx - dy * dy) / F.pow(dx * dx + dy * dy + dz * dz, F.lit(2.5))
    return p.groupBy("id").agg(F.sum(field).alias("field"))


@query("source_potential", "SELECT id, round(sum(i / (2 * pi() * 0.01 * sqrt(pow(x - sx, 2) + pow(y - sy, 2) + 400))), 6) AS potential FROM points, (VALUES (100e0, 200e0, 1e0), (400e0, 300e0, -1e0)) s(sx, sy, i) GROUP BY id")
def _(spark, sf):
    sources = F.inline(F.array(*[F.struct(F.lit(a).alias("sx"), F.lit(b).alias("sy"), F.lit(i).alias("i")) for a, b, i in ((100.0, 200.0, 1.0), (400.0, 300.0, -1.0))]))
    p = view(spark, sf, "points").select("id", "x", "y", sources)
    r = F.sqrt(F.pow(F.col("x") - F.col("sx"), F.lit(2.0)) + F.pow(F.col("y") - F.col("sy"), F.lit(2.0)) + 400)
    return p.groupBy("id").agg(F.sum(F.col("i") / (r * (2 * 3.141592653589793 * 0.01))).alias("potential"))


@query("matched_layers", "WITH p AS (SELECT id, wave, 100e0 * exp(-2 * 60 * wave) AS p1, 10e0 * exp(-2 * 10 * wave) AS p2 FROM stations) SELECT id, round(p1 / (p1 + p2 + 0.01), 6) AS deep, round(p2 / (p1 + p2 + 0.01), 6) AS shallow FROM p")
def _(spark, sf):
    w = F.col("wave")
    s = view(spark, sf, "stations").select("id", (F.exp(w * -120) * 100).alias("p1"), (F.exp(w * -20) * 10).alias("p2"))
    total = F.col("p1") + F.col("p2") + 0.01
    return s.select("id", (F.col("p1") / total).alias("deep"), (F.col("p2") / total).alias("shallow"))


@query("validate_abmn", "SELECT a, b, m, n, a <> b AND a <> m AND a <> n AND b <> m AND b <> n AND m <> n AND a >= 0 AND m >= 0 AS valid, count(*) AS n_rows FROM quads GROUP BY ALL")
def _(spark, sf):
    q = [F.col(c) for c in ("a", "b", "m", "n")]
    valid = (q[0] >= 0) & (q[2] >= 0)
    for i in range(4):
        for j in range(i):
            valid = valid & (q[i] != q[j])
    return view(spark, sf, "quads").groupBy("a", "b", "m", "n").agg(F.count("*").alias("n_rows")).withColumn("valid", valid)


@query("lag_estimate", """WITH b AS (SELECT line, row_number() OVER (PARTITION BY line ORDER BY row_id) AS i, v, x FROM flights), k AS (SELECT a.line, l AS lag, corr(a.v, b.x) AS r, count(*) AS n FROM b a, range(-3, 4) g(l), b WHERE b.line = a.line AND b.i = a.i - l GROUP BY 1, 2 HAVING count(*) >= 3)
  SELECT line, CAST(lag AS INT) AS lag, round(r, 6) AS r FROM (SELECT *, row_number() OVER (PARTITION BY line ORDER BY round(abs(r), 9) DESC, lag) AS rk FROM k WHERE r IS NOT NULL AND NOT isnan(r)) WHERE rk = 1""")
def _(spark, sf):
    b = view(spark, sf, "flights").withColumn("i", F.row_number().over(Window.partitionBy("line").orderBy("row_id")))
    a = b.select("line", "i", "v").withColumn("lag", F.explode(F.sequence(F.lit(-3), F.lit(3)))).withColumn("i", F.col("i") - F.col("lag"))
    k = a.join(b.select("line", "i", "x"), ["line", "i"]).groupBy("line", "lag").agg(F.corr("v", "x").alias("r"), F.count("*").alias("n")).where("n >= 3 and r is not null and not isnan(r)")
    best = F.row_number().over(Window.partitionBy("line").orderBy(F.round(F.abs("r"), 9).desc(), "lag"))
    return k.withColumn("k", best).where("k = 1").select("line", "lag", "r")
