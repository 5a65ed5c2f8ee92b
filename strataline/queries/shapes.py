"""Rasters, and kernels that SQL can't express (rows only)."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from ..functions.numbers import is_finite
from ..operators import grids as G, joins as J, kernels as K, lines as L, solve as S, spectra as X, stats
from .registry import query, table, view


def _cells(spark, sf):
    return view(spark, sf, "cells")


_NINE = "SELECT a.r, a.c, sum(b.z * (2 - abs(a.r - b.r)) * (2 - abs(a.c - b.c))) / sum((2 - abs(a.r - b.r)) * (2 - abs(a.c - b.c))) AS s FROM cells a JOIN cells b ON abs(a.r - b.r) <= 1 AND abs(a.c - b.c) <= 1 AND b.z IS NOT NULL GROUP BY 1, 2"


@query("smooth_nine_point", f"SELECT cells.r, cells.c, round(CASE WHEN z IS NOT NULL THEN s END, 6) AS smooth FROM cells LEFT JOIN ({_NINE}) n ON n.r = cells.r AND n.c = cells.c")
def _(spark, sf):
    return G.nine_point(_cells(spark, sf)).select("r", "c", "smooth")


@query("circular_median", "SELECT cells.r, cells.c, round(CASE WHEN z IS NOT NULL THEN m END, 6) AS median FROM cells LEFT JOIN (SELECT a.r, a.c, median(b.z) AS m FROM cells a JOIN cells b ON pow(a.r - b.r, 2) + pow(a.c - b.c, 2) <= 4 GROUP BY 1, 2) n ON n.r = cells.r AND n.c = cells.c")
def _(spark, sf):
    return G.disk_median(_cells(spark, sf), 2).select("r", "c", "median")


@query("automatic_gain_control", "WITH g AS (SELECT sqrt(avg(z * z)) AS rms FROM cells), l AS (SELECT a.r, a.c, sqrt(avg(b.z * b.z)) AS loc FROM cells a JOIN cells b ON abs(a.r - b.r) <= 2 AND abs(a.c - b.c) <= 2 GROUP BY 1, 2) SELECT cells.r, cells.c, round(z * least(rms / greatest(loc, rms * 0.05), 10), 6) AS gained FROM cells JOIN l ON l.r = cells.r AND l.c = cells.c, g")
def _(spark, sf):
    return G.automatic_gain(_cells(spark, sf), 5).select("r", "c", "gained")


_GRAD = "g AS (SELECT a.r, a.c, a.z, (e.z - w.z) / 50 AS gx, (n.z - s.z) / 50 AS gy FROM cells a LEFT JOIN cells e ON e.r = a.r AND e.c = a.c + 1 LEFT JOIN cells w ON w.r = a.r AND w.c = a.c - 1 LEFT JOIN cells n ON n.c = a.c AND n.r = a.r + 1 LEFT JOIN cells s ON s.c = a.c AND s.r = a.r - 1)"


@query("grid_gradients", f"WITH {_GRAD} SELECT r, c, round(gx, 6) AS gx, round(gy, 6) AS gy, round(sqrt(gx * gx + gy * gy), 6) AS thdr FROM g")
def _(spark, sf):
    return G.gradients(_cells(spark, sf), 25.0, 25.0).select("r", "c", "gx", "gy", "thdr")


@query("hillshade", f"WITH {_GRAD} SELECT r, c, round(greatest(0e0, ((-gx * sin(radians(315)) - gy * cos(radians(315))) * cos(radians(45)) + sin(radians(45))) / sqrt(gx * gx + gy * gy + 1)), 6) AS shade FROM g WHERE gx IS NOT NULL AND gy IS NOT NULL")
def _(spark, sf):
    return G.hillshade(_cells(spark, sf), 315.0, 45.0, 25.0, 25.0).where("gx is not null and gy is not null").select("r", "c", "shade")


@query("local_relief", "WITH l AS (SELECT a.r, a.c, avg(b.z) AS m, stddev_pop(b.z) AS sd FROM cells a JOIN cells b ON abs(a.r - b.r) <= 3 AND abs(a.c - b.c) <= 3 GROUP BY 1, 2) SELECT cells.r, cells.c, round(z - m, 6) AS relief FROM cells JOIN l ON l.r = cells.r AND l.c = cells.c")
def _(spark, sf):
    b = G.box_sums(_cells(spark, sf), 3, "z")
    return b.select("r", "c", (F.col("z") - F.try_divide("total", "n")).alias("relief"))


@query("raster_shift", "SELECT a.r, a.c, a.z, b.z AS shifted FROM cells a LEFT JOIN cells b ON b.r = a.r - 1 AND b.c = a.c - 2")
def _(spark, sf):
    return G.shifted(_cells(spark, sf), 1, 2).select("r", "c", "z", "shifted")


@query("raster_compare", "SELECT count(*) FILTER (a.z IS NOT NULL AND b.z IS NULL) AS before_only, count(*) FILTER (a.z IS NULL AND b.z IS NOT NULL) AS after_only, count(a.z - b.z) AS common, round(sqrt(avg(pow(a.z - b.z, 2))), 6) AS rms, round(avg(abs(a.z - b.z)), 6) AS mae, round(max(abs(a.z - b.z)), 6) AS worst, round(quantile_cont(abs(a.z - b.z), 0.95), 6) AS p95 FROM cells a FULL JOIN (SELECT r, c, z2 AS z FROM cells WHERE c < 45) b ON a.r = b.r AND a.c = b.c")
def _(spark, sf):
    c = _cells(spark, sf)
    return G.compare(c, c.where("c < 45").select("r", "c", F.col("z2").alias("z")))


@query("zonal_statistics", "SELECT CAST(floor(r / 7e0) AS INT) AS zone, count(*) AS cells, count(z) AS valid, round(avg(z), 6) AS mean, min(z) AS low, max(z) AS high FROM cells GROUP BY 1")
def _(spark, sf):
    return G.zonal(_cells(spark, sf).withColumn("zone", F.floor(F.col("r") / 7).cast("int")), "zone")


@query("block_mean_grid", "SELECT CAST(floor(y / 40 + 0.5) AS INT) AS r, CAST(floor(x / 40 + 0.5) AS INT) AS c, round(avg(x), 6) AS x, round(avg(y), 6) AS y, round(avg(v), 6) AS z, count(*) AS n FROM points GROUP BY 1, 2")
def _(spark, sf):
    return G.block_mean(view(spark, sf, "points"), "x", "y", "v", 0.0, 0.0, 40.0)


@query("mosaic_overlap", "SELECT r, c, round(avg(z), 6) AS z, count(z) AS layers FROM (SELECT r, c, z FROM cells WHERE c < 30 UNION ALL SELECT r, c, z2 FROM cells WHERE c >= 20) GROUP BY 1, 2")
def _(spark, sf):
    c = _cells(spark, sf)
    return G.mosaic([c.where("c < 30"), c.where("c >= 20").select("r", "c", F.col("z2").alias("z"))])


@query("raster_sample", "SELECT id, z FROM points JOIN cells ON r = floor(y / 16) AND c = floor(x / 13)")
def _(spark, sf):
    p = view(spark, sf, "points").select("id", F.floor(F.col("y") / 16).cast("int").alias("r"), F.floor(F.col("x") / 13).cast("int").alias("c"))
    return p.join(_cells(spark, sf), ["r", "c"]).select("id", "z")


@query("anomaly_coincidence", "WITH b AS (SELECT quantile_cont(z, 0.9) AS za, quantile_cont(z2, 0.9) AS zb FROM cells) SELECT r, c, CAST(CASE WHEN z >= za THEN 1 ELSE 0 END | CASE WHEN z2 >= zb THEN 2 ELSE 0 END AS INT) AS class FROM cells, b")
def _(spark, sf):
    c = _cells(spark, sf)
    b = c.agg(F.percentile("z", F.lit(0.9)).alias("za"), F.percentile("z2", F.lit(0.9)).alias("zb"))
    one = F.when(F.col("z") >= F.col("za"), 1).otherwise(0)
    return c.crossJoin(F.broadcast(b)).select("r", "c", one.bitwiseOR(F.when(F.col("z2") >= F.col("zb"), 2).otherwise(0)).alias("class"))


@query("texture_entropy", "WITH q AS (SELECT a.r, a.c, CAST(least(floor((b.z - 900) / 50), 7) AS INT) AS b, count(*) AS n FROM cells a JOIN cells b ON abs(a.r - b.r) <= 1 AND abs(a.c - b.c) <= 1 AND b.z IS NOT NULL GROUP BY ALL), p AS (SELECT r, c, n / sum(n) OVER (PARTITION BY r, c) AS p FROM q) SELECT r, c, round(-sum(p * log2(p)), 6) AS entropy FROM p GROUP BY 1, 2")
def _(spark, sf):
    near = F.inline(F.array(*[F.struct((F.col("r") + i).alias("r2"), (F.col("c") + j).alias("c2")) for i in (-1, 0, 1) for j in (-1, 0, 1)]))
    c = _cells(spark, sf)
    b = c.where("z is not null").select(F.least(F.floor((F.col("z") - 900) / 50), F.lit(7)).cast("int").alias("b"), near).select(F.col("r2").alias("r"), F.col("c2").alias("c"), "b")
    return stats.entropy(b.join(c.select("r", "c"), ["r", "c"], "left_semi"), ["r", "c"], "b").select("r", "c", "entropy")


@query("tile_membership", "SELECT tr AS tile_r, tc AS tile_c, count(*) AS cells, count(*) FILTER (floor(r / 16) = tr AND floor(c / 16) = tc) AS core FROM cells, range(0, 40) a(tr), range(0, 40) b(tc) WHERE r BETWEEN tr * 16 - 3 AND tr * 16 + 18 AND c BETWEEN tc * 16 - 3 AND tc * 16 + 18 GROUP BY 1, 2 HAVING count(*) FILTER (floor(r / 16) = tr AND floor(c / 16) = tc) > 0")
def _(spark, sf):
    return G.tiles(_cells(spark, sf), 16, 3).groupBy("tile_r", "tile_c").agg(F.count("*").alias("cells"), F.count_if("core").alias("core"))


# Fourier filters: one grid per call
def _grid(spark, sf):
    return _cells(spark, sf).withColumn("grid", F.lit(0))


_FILTERS = {
    "fft_derivative_easting": [G.derivative("east")],
    "fft_derivative_northing": [G.derivative("north")],
    "fft_derivative_upward": [G.derivative("up")],
    "fft_second_vertical_derivative": [G.derivative("up", 2)],
    "fft_directional_gradient": [G.directional_derivative(30.0)],
    "fft_upward_continuation": [G.continuation(50.0)],
    "fft_downward_continuation": [G.downward(20.0, 120.0)],
    "fft_butterworth_lowpass": [G.butterworth(150.0, 4)],
    "fft_butterworth_highpass": [G.butterworth(150.0, 4, high=True)],
    "fft_butterworth_bandpass": [G.butterworth(400.0, 2, high=True), G.butterworth(100.0, 2)],
    "fft_gaussian_lowpass": [G.gaussian(150.0)],
    "fft_gaussian_highpass": [G.gaussian(150.0, high=True)],
    "fft_ideal_bandpass": [G.ideal(400.0, 100.0)],
    "fft_ideal_band_reject": [G.ideal(400.0, 100.0, reject=True)],
    "fft_cosine_rolloff": [G.cosine_rolloff(400.0, 100.0)],
    "fft_directional_pass": [G.directional(30.0)],
    "fft_directional_reject": [G.directional(30.0, reject=True)],
    "fft_integration_easting": [G.integration("east")],
    "fft_integration_northing": [G.integration("north")],
    "fft_vertical_integration": [G.integration("up")],
    "microlevel_grid": [G.microlevel(0.0, 200.0, 400.0)],
    "reduction_to_pole": [G.field_transform((60.0, 5.0))],
    "reduction_to_equator": [G.field_transform((60.0, 5.0), (0.0, 5.0))],
    "field_direction_transform": [G.field_transform((60.0, 5.0), (75.0, -3.0))],
    "magnetic_pseudogravity": [G.pseudogravity(60.0, 5.0)],
    "elastic_flexure": [G.airy_flexure(2000.0)],
}
for _name, _transfers in _FILTERS.items():

    @query(_name)
    def _(spark, sf, transfers=_transfers):
        return G.fft_filter(_grid(spark, sf), transfers, 25.0, 25.0).select("r", "c", "filtered")


@query("magnetic_products")
def _(spark, sf):
    return G.products(_grid(spark, sf), 25.0, 25.0, inclination=60.0, declination=5.0)


@query("grid_power_spectrum")
def _(spark, sf):
    return G.block_spectra(_grid(spark, sf), 25.0, 25.0, 20)


# lines
def _flights(spark, sf):
    return view(spark, sf, "flights").select("line", "row_id", "t", "v", "x", "y")


@query("butterworth_line_filter")
def _(spark, sf):
    sections = K.butterworth_sections(4, 0.1)
    return K.by_group(_flights(spark, sf), ["line"], lambda p: p.assign(filtered=K.zero_phase(sections, p["v"].to_numpy()))[["line", "row_id", "filtered"]], "line long, row_id long, filtered double")


@query("notch_line_filter")
def _(spark, sf):
    section = K.notch_section(0.2, 5.0)
    return K.by_group(_flights(spark, sf), ["line"], lambda p: p.assign(filtered=K.zero_phase(section, p["v"].to_numpy()))[["line", "row_id", "filtered"]], "line long, row_id long, filtered double")


# segments of the flights with their means taken off and Hann weights, for plain Fourier sums
def _segments_sql(columns: str, size: int) -> str:
    rows = f"f AS (SELECT line, {columns}, row_number() OVER (PARTITION BY line ORDER BY row_id) - 1 AS i, count(*) OVER (PARTITION BY line) AS len FROM flights), n AS (SELECT DISTINCT line, len, least({size}, len) AS n FROM f), st AS (SELECT line, n, unnest(range(0, len - n + 1, greatest(1, n // 2))) AS s FROM n)"
    parts = ", ".join(f"({c} - avg({c}) OVER (PARTITION BY st.line, s)) * (0.5 - 0.5 * cos(2 * pi() * (i - s) / n)) AS d{c}" for c in columns.split(", "))
    return f"{rows}, m AS (SELECT st.line, s, n, i - s AS j, 0.5 - 0.5 * cos(2 * pi() * (i - s) / n) AS w, {parts} FROM st JOIN f ON f.line = st.line AND i >= s AND i < s + n), q AS (SELECT unnest(range(0, {size // 2 + 1})) AS q)"


@query("welch_spectrum", f"WITH {_segments_sql('v', 32)}, k AS (SELECT line, s, n, q, sum(dv * cos(2 * pi() * q * j / n)) AS re, sum(dv * sin(2 * pi() * q * j / n)) AS im, sum(w * w) AS ww FROM m, q WHERE q <= n // 2 GROUP BY 1, 2, 3, 4) SELECT line, round(q / n, 6) AS frequency, round(avg(re * re + im * im) / any_value(ww) * CASE WHEN q = 0 OR 2 * q = n THEN 1 ELSE 2 END, 6) AS power FROM k GROUP BY line, q, n")
def _(spark, sf):
    def run(p):
        f, power = K.welch(p["v"].to_numpy(), 1.0, 32)
        return pd.DataFrame({"line": p["line"].iloc[0], "frequency": f, "power": power})

    return K.by_group(_flights(spark, sf), ["line"], run, "line long, frequency double, power double")


@query(
    "admittance_coherence",
    f"WITH {_segments_sql('x, v', 16)}, k AS (SELECT line, s, n, q, sum(dx * cos(2 * pi() * q * j / n)) AS xr, -sum(dx * sin(2 * pi() * q * j / n)) AS xi, sum(dv * cos(2 * pi() * q * j / n)) AS vr, -sum(dv * sin(2 * pi() * q * j / n)) AS vi FROM m, q WHERE q <= n // 2 GROUP BY 1, 2, 3, 4), t AS (SELECT line, n, q, sum(xr * xr + xi * xi) AS xx, sum(vr * vr + vi * vi) AS yy, sum(xr * vr + xi * vi) AS re, sum(xr * vi - xi * vr) AS im FROM k GROUP BY 1, 2, 3), u AS (SELECT *, 1e-12 * max(xx) OVER (PARTITION BY line) AS least_xx FROM t) SELECT line, round(q / n, 6) AS frequency, round(CASE WHEN xx > least_xx THEN re / xx END, 6) AS admittance, round((re * re + im * im) / greatest(xx * yy, 1e-300), 6) AS coherence FROM u",
)
def _(spark, sf):
    def run(p):
        f, a, c = K.admittance(p["x"].to_numpy(), p["v"].to_numpy(), 1.0, 16)
        return pd.DataFrame({"line": p["line"].iloc[0], "frequency": f, "admittance": a, "coherence": c})

    return K.by_group(_flights(spark, sf), ["line"], run, "line long, frequency double, admittance double, coherence double")


@query("werner_profile")
def _(spark, sf):
    def run(p):
        f = p["v"].to_numpy()
        s = np.arange(len(f)) * 10.0
        found = [(p["line"].iloc[0], *w) for w in K.werner_profile(s, f)]
        return pd.DataFrame(found, columns=["line", "position", "depth"])

    return K.by_group(_flights(spark, sf), ["line"], run, "line long, position double, depth double")


@query("euler_grid")
def _(spark, sf):
    p = G.products(_grid(spark, sf), 25.0, 25.0).withColumn("gz", -F.col("gz"))
    return G.euler_solutions(p, 25.0, 25.0, 1.0).drop("grid")


# gridding
def _by_place(asked, kernel, names):
    """The kernel for each id's neighbours (px, py, v, qx, qy); 256 ids share a group, as a group costs more than a kernel."""

    def run(p):
        p = p.sort_values(["id", "rank"])
        values, ids = p[["px", "py", "v", "qx", "qy"]].to_numpy(), p["id"].to_numpy()
        cuts = [0, *(np.flatnonzero(np.diff(ids)) + 1), len(ids)]
        rows = [(int(ids[a]), *kernel(values[a:b])) for a, b in zip(cuts, cuts[1:])]
        return pd.DataFrame(rows, columns=["id", *names])

    grouped = asked.withColumn("part", F.floor(F.col("id") / 256)).groupBy("part")
    return grouped.applyInPandas(run, "id long, " + ", ".join(f"{n} double" for n in names))


def _from_neighbours(spark, sf, k, kernel, names):
    """The kernel at every point whose id is divisible by four, from its k nearest others that have a value; once for the points of one
    place, which share them. A point with too few near it has no estimate."""
    p = view(spark, sf, "points")
    asked = p.where("id % 4 = 0")
    places = asked.groupBy("x", "y").agg(F.min("id").alias("id"))
    others = p.where("id % 4 <> 0").where(is_finite(F.col("v"))).select(F.col("id").alias("other"), "x", "y", "v", F.col("x").alias("px"), F.col("y").alias("py"))
    near = J.neighbours(places, others, "x", "y", "other", 60.0, k, left_id="id", carry=["v", "px", "py"])
    solved = _by_place(near.join(places.select("id", F.col("x").alias("qx"), F.col("y").alias("qy")), "id"), kernel, names)
    return asked.select("id", "x", "y").join(places.withColumnRenamed("id", "place"), ["x", "y"]).join(solved.withColumnRenamed("id", "place"), "place", "left").select("id", *names)


@query("ordinary_kriging")
def _(spark, sf):
    def one(q):
        return K.ordinary_kriging(q[:, :2], q[:, 2], q[0, 3:], 3000.0, 80.0)

    return _from_neighbours(spark, sf, 8, one, ("estimate", "variance"))


@query("local_thin_plate")
def _(spark, sf):
    def one(q):
        return (K.thin_plate(q[:, :2], q[:, 2], q[:1, 3:])[0] if len(q) >= 3 else math.nan,)

    return _from_neighbours(spark, sf, 12, one, ("estimate",))


@query("minimum_curvature_grid")
def _(spark, sf):
    p = G.block_mean(view(spark, sf, "points"), "x", "y", "v", 0.0, 0.0, 20.0)
    return G.minimum_curvature_tiles(p, tolerance=0.01, rounds=300)


@query("sinc_resample")
def _(spark, sf):
    c = _grid(spark, sf).select("r", "c", "z")

    def run(q):
        q = q.sort_values("c")
        v = q["z"].interpolate(limit_direction="both").to_numpy()
        at = np.arange(0, len(v) - 1, 0.5)
        return pd.DataFrame({"r": q["r"].iloc[0], "at": at, "z": K.lanczos(v, at)})

    return c.groupBy("r").applyInPandas(run, "r int, at double, z double")


# solves
@query("line_leveling_solution")
def _(spark, sf):
    return S.line_corrections(view(spark, sf, "crossings").withColumn("tie", F.concat(F.lit("t"), "tie")), "traverse", "tie", "residual")


@query("polynomial_leveling")
def _(spark, sf):
    c = view(spark, sf, "crossings").withColumn("p", (F.col("o") % 201) / 100 - 1)
    return S.polynomial_corrections(c, "traverse", "p", "residual", 2)


@query("gravity_network_adjustment")
def _(spark, sf):
    e = view(spark, sf, "crossings").select(F.col("traverse").alias("a"), (F.col("traverse") % 13 + F.col("tie") + 1).alias("b"), F.col("residual").alias("d"))
    return S.network(e.where("a <> b"), "a", "b", "d", None, {"1": 0.0})


@query("bouguer_density_fit", "SELECT '1' AS term, round(regr_intercept(g, h), 3) AS value FROM stations UNION ALL SELECT 'h', round(regr_slope(g, h), 3) FROM stations", digits=3)
def _(spark, sf):
    x = S.least_squares(view(spark, sf, "stations"), ["h"], "g")
    return spark.createDataFrame([(k, float(v)) for k, v in x.items()], "term string, value double")


@query("connected_components", "SELECT p_partkey AS node, p_partkey - p_partkey % 7 AS component FROM part")
def _(spark, sf):
    e = table(spark, sf, "part").select(F.col("p_partkey").alias("a"), (F.col("p_partkey") - F.col("p_partkey") % 7).alias("b"))
    if not spark.sparkContext._jsc.sc().getCheckpointDir().isDefined():
        import tempfile

        shared = spark.conf.get("spark.checkpoint.dir", None)
        if not shared and not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir(shared or tempfile.mkdtemp())
    return stats.components(e, "a", "b")


@query("tolles_lawson_compensation")
def _(spark, sf):
    f = view(spark, sf, "flights").withColumn("bx", F.sin("row_id") * 100 + 20000).withColumn("by", F.cos("row_id") * 100 + 3000).withColumn("bz", F.col("x") + 40000)
    return S.compensation(f.select("line", "row_id", "v", "bx", "by", "bz"), ["bx", "by", "bz"], "v", ["line"])


# spectra
@query("full_spectrum_fit")
def _(spark, sf):
    basis = np.stack([np.exp(-0.5 * ((np.arange(64) - m) / w) ** 2) for m, w in ((12, 4), (30, 5), (50, 6))], axis=1)

    def run(batches):
        for p in batches:
            x = np.array([K.nnls(basis, np.abs(np.asarray(e, float)) * 100) for e in p["embedding"]]).reshape(-1, 3)
            yield pd.DataFrame({"vec_id": p["vec_id"], "k": x[:, 0], "u": x[:, 1], "th": x[:, 2]})

    return table(spark, sf, "embeddings").select("vec_id", "embedding").mapInPandas(run, "vec_id long, k double, u double, th double")


@query("nasvd_denoise")
def _(spark, sf):
    e = table(spark, sf, "embeddings").select("vec_id", "label", F.transform("embedding", lambda x: F.abs(x.cast("double")) * 100).alias("counts"))
    total = lambda x: F.aggregate(x, F.lit(0.0), lambda a, b: a + b)
    return X.nasvd(e, "vec_id", "label", "counts", 4).select("vec_id", total("counts").alias("before"), total("rebuilt").alias("after"))


@query("mt_layered_forward")
def _(spark, sf):
    def run(batches):
        for p in batches:
            z = K.layered_impedance(p["frequency"].to_numpy(), [100.0, 10.0, 500.0], [300.0, 800.0])
            yield p.assign(re=z.real, im=z.imag)

    return view(spark, sf, "stations").select("id", (F.col("u") + 0.01).alias("frequency")).mapInPandas(run, "id long, frequency double, re double, im double")


@query("cole_cole_fit")
def _(spark, sf):
    def run(batches):
        w = 2j * np.pi * np.logspace(-2, 3, 12)

        def model(x):
            z = x[0] * (1 - x[1] + x[1] / (1 + (w * 10 ** x[2]) ** x[3]))
            return np.concatenate([z.real, z.imag])

        truth = np.array([100.0, 0.3, -1.0, 0.5])
        start, low, high = np.array([80.0, 0.2, -0.5, 0.4]), np.array([1, 0, -4, 0.1]), np.array([1e4, 0.95, 3, 1.0])
        for p in batches:
            rows = []
            for i, e in zip(p["vec_id"], p["first"]):
                rng = np.abs(np.asarray(e, float)) * 0.02
                x, rms = K.fit_bounded(model, model(truth) * (1 + np.tile(rng, 2) * 0.01), start, low, high)
                rows.append((i, *x, rms))
            yield pd.DataFrame(rows, columns=["vec_id", "rho0", "m", "log_tau", "c", "rms"])

    # dealt out, as a fit costs far more than its row
    e = table(spark, sf, "embeddings").select("vec_id", F.slice("embedding", 1, 12).alias("first")).repartition("vec_id")
    return e.mapInPandas(run, "vec_id long, rho0 double, m double, log_tau double, c double, rms double")


@query("polygon_gravity_forward")
def _(spark, sf):
    ring = np.array([[200.0, 50.0], [400.0, 50.0], [400.0, 150.0], [200.0, 150.0]])

    def run(batches):
        for p in batches:
            yield p.assign(g=K.polygon_gravity(np.column_stack([p["x"], np.zeros(len(p))]), ring, 300.0))

    return view(spark, sf, "points").select("id", "x").mapInPandas(run, "id long, x double, g double")


@query("spi_profile", """WITH s AS (SELECT row_id, line, v, (lead(v) OVER w - lag(v) OVER w) / 2 AS gx, lead(v) OVER w - 2 * v + lag(v) OVER w AS gxx FROM flights WINDOW w AS (PARTITION BY line ORDER BY row_id)), k AS (SELECT *, abs(gx * gx - v * gxx) / nullif(gx * gx + v * v, 0) AS k FROM s),
  p AS (SELECT *, lag(k) OVER w AS kb, lead(k) OVER w AS ka FROM k WINDOW w AS (PARTITION BY line ORDER BY row_id)) SELECT row_id, round(k, 6) AS wavenumber, round(1 / nullif(k, 0), 5) AS depth FROM p WHERE k > kb AND k > ka AND k > 0.5""", digits=6)
def _(spark, sf):
    w = L.along(["line"])
    s = _flights(spark, sf).withColumn("gx", (F.lead("v").over(w) - F.lag("v").over(w)) / 2).withColumn("gxx", F.lead("v").over(w) - F.col("v") * 2 + F.lag("v").over(w))
    s = s.withColumn("k", F.try_divide(F.abs(F.col("gx") * F.col("gx") - F.col("v") * F.col("gxx")), F.col("gx") * F.col("gx") + F.col("v") * F.col("v")))
    s = s.withColumn("kb", F.lag("k").over(w)).withColumn("ka", F.lead("k").over(w)).where("k > kb and k > ka and k > 0.5")
    return s.select("row_id", F.col("k").alias("wavenumber"), F.round(F.try_divide(F.lit(1.0), F.col("k")), 5).alias("depth"))
