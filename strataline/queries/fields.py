"""Sources, calibrations, waveforms and further grid transforms."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Window, functions as F

from ..operators import fields as P, grids as G, kernels as K, solve as S, spectra as X
from .registry import query, scalar, table, view
from .relations import _SPEC, _spectra
from .shapes import _grid

c = F.col
scalar("upward_window_radon", "stations", "id", {"radon": (lambda: P.upward_radon(c("u"), c("th"), F.lit(0.2), F.lit(0.1), c("k"), 0.05, 0.02, 0.4, 0.1), "(k - 0.05 * u - 0.02 * th + 0.02 * 0.2 - 0.1) / (0.4 - 0.05 - 0.02 * 0.1)")})
scalar(
    "apply_complex_response",
    "stations",
    "id",
    {"re": (lambda: P.complex_response(c("ve"), c("vn"), (2.0, 1.0), (0.5, -0.5))[0], "((ve - 0.5) * 2 + (vn + 0.5) * 1) / 5"), "im": (lambda: P.complex_response(c("ve"), c("vn"), (2.0, 1.0), (0.5, -0.5))[1], "((vn + 0.5) * 2 - (ve - 0.5) * 1) / 5")},
)
_C = lambda: [[c("k"), c("u")], [c("u"), c("th")]]
_A = [[1.0, 2.0], [0.0, -1.0]]
scalar(
    "covariance_transform",
    "stations",
    "id",
    {"xx": (lambda: P.covariance_transform(_C(), _A)[0][0], "k + 2 * u + 2 * u + 4 * th"), "xy": (lambda: P.covariance_transform(_C(), _A)[0][1], "-u - 2 * th"), "yy": (lambda: P.covariance_transform(_C(), _A)[1][1], "th")},
)
scalar("reference_model_doi", "stations", "id", {"doi": (lambda: P.depth_of_investigation(c("k"), c("u"), 3.0, 1.0), "(k - u) / 2")})
scalar("orthometric_drape_flag", "stations", "id", {"clearance": (lambda: c("g") - 978000 - c("h"), "g - 978000 - h"), "low": (lambda: F.when(c("g") - 978000 - c("h") < 600, 1.0).otherwise(0.0), "CASE WHEN g - 978000 - h < 600 THEN 1 ELSE 0 END")})

_PRISMS = ((100.0, 300.0, 50.0, 250.0, 40.0, 160.0, 300.0), (350.0, 500.0, 300.0, 450.0, 30.0, 90.0, -200.0))


def _prism_sql() -> str:
    terms = []
    for i in (0, 1):
        for j in (0, 1):
            for k in (0, 1):
                x, y, z = f"(x{i + 1} - x)", f"(y{j + 1} - y)", f"z{k + 1}"
                r = f"sqrt({x} * {x} + {y} * {y} + {z} * {z})"
                terms.append(f"{'+' if (i + j + k) % 2 else '-'} ({x} * ln({y} + {r}) + {y} * ln({x} + {r}) - {z} * atan2({x} * {y}, {z} * {r}))")
    rows = ", ".join("(" + ", ".join(f"{v!r}::DOUBLE" for v in p) + ")" for p in _PRISMS)
    return f"SELECT id, round(sum(6.67430e-6 * rho * ({' '.join(terms)})), 6) AS gravity FROM points, (VALUES {rows}) s(x1, x2, y1, y2, z1, z2, rho) GROUP BY id"


@query("prism_gravity_forward", _prism_sql())
def _(spark, sf):
    p = view(spark, sf, "points").select("id", "x", "y", P.literal_rows(("x1", "x2", "y1", "y2", "z1", "z2", "rho"), _PRISMS))
    g = P.prism_gravity(c("x"), c("y"), F.lit(0.0), [c(n) for n in ("x1", "x2", "y1", "y2", "z1", "z2")], c("rho"))
    return p.groupBy("id").agg(F.sum(g).alias("gravity"))


@query("terrain_correction", "SELECT a.r, a.c, round(sum(6.67430e-6 * 2670 * 625 * (1 / (25 * sqrt(pow(a.r - b.r, 2) + pow(a.c - b.c, 2))) - 1 / sqrt(625 * (pow(a.r - b.r, 2) + pow(a.c - b.c, 2)) + pow(b.z - a.z, 2)))), 6) AS effect FROM cells a JOIN cells b ON pow(a.r - b.r, 2) + pow(a.c - b.c, 2) BETWEEN 1 AND 9 AND b.z IS NOT NULL WHERE a.z IS NOT NULL GROUP BY 1, 2")
def _(spark, sf):
    cells = view(spark, sf, "cells")
    return P.terrain_effect(cells.where("z is not null"), cells, 25.0, 3, 2670.0)


@query("recorded_gate_average", f"WITH {_SPEC}, p AS (SELECT vec_id, bin * 0.5 AS t0, counts AS v0, lead(bin * 0.5) OVER w AS t1, lead(counts) OVER w AS v1 FROM sp WINDOW w AS (PARTITION BY vec_id ORDER BY bin)), g AS (SELECT *, greatest(t0, 1.3) AS a, least(t1, 9.9) AS b FROM p WHERE t1 IS NOT NULL) SELECT vec_id, round(sum((b - a) * ((v0 + (v1 - v0) * (a - t0) / (t1 - t0)) + (v0 + (v1 - v0) * (b - t0) / (t1 - t0))) / 2) / 8.6, 5) AS gate_mean FROM g WHERE b > a GROUP BY vec_id", digits=5)
def _(spark, sf):
    return P.piecewise_mean(_spectra(spark, sf).withColumn("t", c("bin") * 0.5), ["vec_id"], "t", "counts", 1.3, 9.9)


@query("energy_calibration_fit", f"WITH {_SPEC} SELECT vec_id, round(regr_slope(bin * 12.5 + 3, counts), 6) AS gain, round(regr_intercept(bin * 12.5 + 3, counts), 6) AS start, round(regr_r2(bin * 12.5 + 3, counts), 6) AS r2 FROM sp GROUP BY vec_id")
def _(spark, sf):
    e = c("bin") * 12.5 + 3
    return _spectra(spark, sf).groupBy("vec_id").agg(F.regr_slope(e, c("counts")).alias("gain"), F.regr_intercept(e, c("counts")).alias("start"), F.regr_r2(e, c("counts")).alias("r2"))


@query("spectral_depth_fit", f"WITH {_SPEC} SELECT vec_id, round(regr_slope(ln(counts + 1), bin * 0.01) / -2, 6) AS depth FROM sp GROUP BY vec_id")
def _(spark, sf):
    return _spectra(spark, sf).groupBy("vec_id").agg((F.regr_slope(F.ln(c("counts") + 1), c("bin") * 0.01) / -2).alias("depth"))


@query("time_zero_shift", f"WITH {_SPEC}, n AS (SELECT vec_id, bin, counts, lead(counts) OVER (PARTITION BY vec_id ORDER BY bin) AS n FROM sp) SELECT vec_id, CAST(bin AS INT) AS sample, round(counts + (n - counts) * 0.4, 6) AS shifted FROM n WHERE n IS NOT NULL")
def _(spark, sf):
    nxt = F.lead("counts").over(Window.partitionBy("vec_id").orderBy("bin"))
    return _spectra(spark, sf).withColumn("n", nxt).where("n is not null").select("vec_id", c("bin").alias("sample"), (c("counts") + (c("n") - c("counts")) * 0.4).alias("shifted"))


_BOXES = ((0.0, 200.0, 0.0, 300.0, "west"), (150.0, 400.0, 100.0, 500.0, "centre"), (350.0, 700.0, 0.0, 700.0, "east"))


@query("spatial_constraints", "SELECT id, box FROM points JOIN (VALUES (0e0, 200e0, 0e0, 300e0, 'west'), (150e0, 400e0, 100e0, 500e0, 'centre'), (350e0, 700e0, 0e0, 700e0, 'east')) b(x0, x1, y0, y1, box) ON x BETWEEN x0 AND x1 AND y BETWEEN y0 AND y1")
def _(spark, sf):
    return P.inside_boxes(view(spark, sf, "points"), _BOXES, "x", "y").select("id", "box")


@query("recovery_metrics", "SELECT CAST(floor(r / 10e0) AS INT) AS zone, count(*) FILTER (z >= 1000 AND z2 >= 25) AS hit, count(*) FILTER (z >= 1000 AND NOT z2 >= 25) AS missed, count(*) FILTER (NOT z >= 1000 AND z2 >= 25) AS false_alarm, round(corr(z, z2), 6) AS r, round(sqrt(avg(pow(z - z2, 2))), 6) AS rms FROM cells GROUP BY 1")
def _(spark, sf):
    t, e = c("z") >= 1000, c("z2") >= 25
    d = c("z") - c("z2")
    return view(spark, sf, "cells").groupBy(F.floor(c("r") / 10).cast("int").alias("zone")).agg(F.count_if(t & e).alias("hit"), F.count_if(t & ~e).alias("missed"), F.count_if(~t & e).alias("false_alarm"), F.corr("z", "z2").alias("r"), F.sqrt(F.avg(d * d)).alias("rms"))


@query("spatial_holdout", "SELECT CAST(floor(x / 100) AS INT) AS bx, CAST(floor(y / 100) AS INT) AS by_, CAST((CAST(floor(x / 100) AS INT) + 3 * CAST(floor(y / 100) AS INT)) % 5 AS INT) AS fold, count(*) AS n, round(avg(v), 6) AS mean FROM points GROUP BY 1, 2, 3")
def _(spark, sf):
    bx, by = F.floor(c("x") / 100).cast("int"), F.floor(c("y") / 100).cast("int")
    return view(spark, sf, "points").groupBy(bx.alias("bx"), by.alias("by_"), ((bx + by * 3) % 5).alias("fold")).agg(F.count("*").alias("n"), F.avg("v").alias("mean"))


@query("paired_flight_difference", "WITH u AS (SELECT id, x, y, v FROM points WHERE id % 2 = 0), l AS (SELECT id AS other, x, y, v FROM points WHERE id % 2 = 1), n AS (SELECT u.id, other, sqrt(pow(u.x - l.x, 2) + pow(u.y - l.y, 2)) AS d, u.v - l.v AS difference, row_number() OVER (PARTITION BY u.id ORDER BY sqrt(pow(u.x - l.x, 2) + pow(u.y - l.y, 2)), other) AS k FROM u JOIN l ON sqrt(pow(u.x - l.x, 2) + pow(u.y - l.y, 2)) <= 30) SELECT u.id, other, round(d, 6) AS distance, round(difference, 6) AS difference, CAST(CASE WHEN other IS NULL THEN 1 WHEN d > 15 THEN 2 ELSE 0 END AS INT) AS reason FROM u LEFT JOIN n ON n.id = u.id AND k = 1")
def _(spark, sf):
    from ..operators import joins as J

    p = view(spark, sf, "points")
    u, lo = p.where("id % 2 = 0"), p.where("id % 2 = 1").select(c("id").alias("other"), "x", "y", c("v").alias("low"))
    near = J.neighbours(u, lo, "x", "y", "other", 30.0, 1, left_id="id", carry=["low"])
    out = u.select("id", "v").join(near, "id", "left")
    return out.select("id", "other", "distance", (c("v") - c("low")).alias("difference"), F.when(c("other").isNull(), 1).when(c("distance") > 15, 2).otherwise(0).alias("reason"))


# grids
for _name, _t in {
    "layer_property_response": [P.layer_response(50.0, 200.0)],
    "apparent_layer_property": [P.apparent_property(50.0, 200.0)],
    "tabulated_radial_filter": [P.tabulated([0.0, 0.02, 0.05, 0.12], [1.0, 1.0, 0.4, 0.0])],
    "convert_field_component": [P.component("up", "east")],
}.items():

    @query(_name)
    def _(spark, sf, transfers=_t):
        return G.fft_filter(_grid(spark, sf), transfers, 25.0, 25.0).select("r", "c", "filtered")


@query("airy_isostatic_fft")
def _(spark, sf):
    go = P.parker_root(25000.0, 400.0)

    def run(pdf):
        z, r0, c0 = G.dense(pdf)
        out = go(np.where(np.isnan(z), 0, z) * (2670 / 400), 25.0, 25.0)
        return pdf.assign(root_effect=out[pdf["r"] - r0, pdf["c"] - c0])

    return G.by_tile(_grid(spark, sf), run, ["root_effect"]).select("r", "c", "root_effect")


@query("monogenic_phase")
def _(spark, sf):
    def run(pdf):
        z, r0, c0 = G.dense(pdf)
        a, p = P.monogenic(np.where(np.isnan(z), np.nanmean(z), z), 25.0, (100.0, 200.0, 400.0))
        at = pdf["r"] - r0, pdf["c"] - c0
        return pdf.assign(amplitude=a[at], phase=p[at])

    return G.by_tile(_grid(spark, sf), run, ["amplitude", "phase"]).select("r", "c", "amplitude", "phase")


@query("equivalent_source_continuation")
def _(spark, sf):
    return P.equivalent_source_tiles(view(spark, sf, "points"), "id", "x", "y", "v", 40.0, 25.0, tile=80, halo=60, cell=20, reach=400)


# waveforms: ten traces a gather
@query("phase_velocity_image")
def _(spark, sf):
    def run(q):
        q = q.sort_values("vec_id")
        v = np.linspace(50, 500, 10)
        f, p = P.phase_velocity(np.stack(q["embedding"].to_numpy()).astype(float), np.arange(len(q)) * 2.0, 0.004, v)
        return pd.DataFrame({"gather": q["gather"].iloc[0], "velocity": np.repeat(v, len(f)), "frequency": np.tile(f, len(v)), "power": p.ravel()})

    e = table(spark, sf, "embeddings").select("vec_id", F.floor(c("vec_id") / 10).alias("gather"), "embedding")
    return e.groupBy("gather").applyInPandas(run, "gather long, velocity double, frequency double, power double")


# three components a station, each by its place; a station without one of them has null ratios
@query(
    "hvsr_windows",
    "WITH e AS (SELECT vec_id, vec_id // 3 AS station, vec_id % 3 AS part, generate_subscripts(embedding, 1) - 1 AS i, CAST(unnest(embedding) AS DOUBLE) AS x FROM embeddings), m AS (SELECT *, (x - avg(x) OVER (PARTITION BY vec_id)) * (0.5 - 0.5 * cos(2 * pi() * (i + 1) / 65)) AS d FROM e), a AS (SELECT station, part, q, sqrt(pow(sum(d * cos(2 * pi() * q * i / 64)), 2) + pow(sum(d * sin(2 * pi() * q * i / 64)), 2)) AS a FROM m, (SELECT unnest(range(1, 33)) AS q) GROUP BY 1, 2, 3), p AS (SELECT station, q, max(CASE WHEN part = 0 THEN a END) AS e, max(CASE WHEN part = 1 THEN a END) AS n, max(CASE WHEN part = 2 THEN a END) AS u FROM a GROUP BY 1, 2) SELECT station, round(q / 0.64, 6) AS frequency, round(sqrt((e * e + n * n) / 2) / CASE WHEN u > 1e-12 THEN u WHEN u IS NOT NULL THEN 1e-12 END, 6) AS ratio FROM p",
)
def _(spark, sf):
    def run(q):
        parts = dict(zip(q["vec_id"] % 3, q["embedding"]))
        e, n, u = (np.asarray(parts[k], float) if k in parts else np.full(64, np.nan) for k in range(3))
        f, r = P.hvsr(e, n, u, 0.01)
        return pd.DataFrame({"station": q["station"].iloc[0], "frequency": f, "ratio": r})

    e = table(spark, sf, "embeddings").select("vec_id", F.floor(c("vec_id") / 3).alias("station"), "embedding")
    return e.groupBy("station").applyInPandas(run, "station long, frequency double, ratio double")


@query("mnf_denoise")
def _(spark, sf):
    e = table(spark, sf, "embeddings").select("vec_id", "label", F.transform("embedding", lambda x: F.abs(x.cast("double"))).alias("counts"))
    return X.mnf(e, "vec_id", "label", "counts", 5).select("vec_id", F.aggregate("rebuilt", F.lit(0.0), lambda a, b: a + b).alias("kept"))


@query("polygon_density_fit")
def _(spark, sf):
    rings = [np.array([[100.0, 40.0], [250.0, 40.0], [250.0, 140.0], [100.0, 140.0]]), np.array([[350.0, 60.0], [520.0, 60.0], [520.0, 120.0], [350.0, 120.0]])]

    def run(batches):
        for p in batches:
            at = np.column_stack([p["x"], np.zeros(len(p))])
            yield pd.DataFrame({"a": K.polygon_gravity(at, rings[0], 1.0), "b": K.polygon_gravity(at, rings[1], 1.0), "v": p["v"]})

    kernels = view(spark, sf, "points").select("x", "v").mapInPandas(run, "a double, b double, v double")
    return spark.createDataFrame(sorted(S.least_squares(kernels, ["a", "b"], "v").items()), "term string, value double")
