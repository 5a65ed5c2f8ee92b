"""Soundings, decays, radon, dipoles, prisms and projections on the given tables."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from ..functions.projection import TransverseMercator, reproject
from ..operators import fields as P, grids as G, kernels as K, models as M, soundings as S
from .registry import query, scalar, table, view
from .shapes import _grid

c = F.col


# layers and properties of a station, from its columns
def _stations(spark, sf):
    return view(spark, sf, "stations")


def _by_model(stations, names, run, schema):
    """Each distinct model is computed once, dealt out by itself as it costs far more than its row, and joined back."""
    asked = stations.select("id", *[F.round(n, 1).alias(n) for n in names])
    return asked.join(S.batched(asked.select(*names).distinct(), run, names, schema), list(names))


@query("dc_layered_sounding")
def _(spark, sf):
    half = np.geomspace(2.0, 200.0, 6)
    xyz = np.array([[x, 0.0, 0.0] for x in (*-half, *half, -0.5, 0.5)])
    abmn = np.array([[i, i + 6, 12, 13] for i in range(6)])

    def run(p):
        rho = [S.layered_resistance(xyz, abmn, [50.0 + 40 * k, 5.0 + 10 * t, 300.0], [4.0, 16.0])[1] for k, t in zip(p["k"], p["th"])]
        return {"k": p["k"], "th": p["th"], "rho_a": np.array(rho)}

    rows = _by_model(_stations(spark, sf), ["k", "th"], run, "k double, th double, rho_a array<double>")
    return rows.select("id", F.posexplode("rho_a").alias("spacing", "rho_a"))


@query("fdem_layered_response")
def _(spark, sf):
    f = np.array([400.0, 3200.0, 25600.0])

    def run(p):
        s = [S.fdem_layered(f, [0.002 + 0.02 * k, 0.1], [10.0], (0, 0, 30.0), (8.0, 0, 30.0)) for k in p["k"]]
        ppm = np.array(s) / (S.MU0 / (4 * math.pi * 8.0**3)) * -1e6
        return {"k": p["k"], "re": ppm.real, "im": ppm.imag}

    rows = _by_model(_stations(spark, sf), ["k"], run, "k double, re array<double>, im array<double>")
    return rows.select("id", F.posexplode(F.arrays_zip("re", "im")).alias("frequency", "v")).select("id", "frequency", "v.re", "v.im")


@query("tem_layered_decay")
def _(spark, sf):
    gates = np.array([[1e-4, 1.4e-4], [3e-4, 4.2e-4], [1e-3, 1.4e-3]])

    def run(p):
        return {"k": p["k"], "dbdt": np.array([S.tem_gates(gates, [0.002 + 0.02 * k, 0.1], [20.0], (0, 0, 0.5), (30.0, 0, 0.5), order=3) * 1e12 for k in p["k"]])}

    return _by_model(_stations(spark, sf), ["k"], run, "k double, dbdt array<double>").select("id", F.posexplode("dbdt").alias("gate", "dbdt"))


_TIMES = np.array([0.05, 0.2, 0.8, 3.2])


@query("ip_decay_curves")
def _(spark, sf):
    events, currents = [0.0, 2.0, 4.0, 6.0], [1.0, 0.0, -1.0, 0.0]

    def run(p):
        out = {"id": p["id"]}
        model = [(0.02 + 0.015 * k, 0.1 + t, 0.6) for k, t in zip(p["k"], p["th"])]
        out["decay"] = np.array([S.ip_decay(_TIMES, *m) for m in model])
        out["pulse"] = np.array([S.ip_decay(_TIMES, *m, pulse=2.0, normalization="pulse") for m in model])
        out["stack"] = np.array([S.ip_stack(events, currents, [1, 3], _TIMES, *m) for m in model])
        return out

    rows = S.batched(_stations(spark, sf), run, ["id", "k", "th"], "id long, decay array<double>, pulse array<double>, stack array<double>")
    return rows.select("id", F.posexplode(F.arrays_zip("decay", "pulse", "stack")).alias("sample", "v")).select("id", "sample", "v.decay", "v.pulse", "v.stack")


@query("ip_decay_fit", digits=4)
def _(spark, sf):
    """Every spectrum's first 12 values, made positive and falling, as a decay."""
    t = np.geomspace(0.02, 4.0, 12)

    def run(p):
        rows = []
        for e in p["embedding"].astype(float):
            observed = np.sort(np.abs(e[:12]))[::-1] / max(np.abs(e).sum(), 1e-12)
            rows.append((*S.fit_ip(lambda m, tau, x: S.ip_decay(t, m, tau, x), observed, 0.01, (0.1, 0.5, 0.6))[0],))
        m = np.array(rows).reshape(-1, 3)
        return {"vec_id": p["vec_id"], "m": m[:, 0], "tau": m[:, 1], "c": m[:, 2]}

    e = table(spark, sf, "embeddings").select("vec_id", "embedding").repartition("vec_id")  # a fit costs far more than its row
    return S.batched(e, run, ["vec_id", "embedding"], "vec_id long, m double, tau double, c double").select("vec_id", F.round("m", 4).alias("m"), F.round("c", 4).alias("c"))


# radon
_RESPONSE = ((1.0, 0.1, 0.05, 0.2), (0.02, 1.2, 0.3, 0.4), (0.01, 0.05, 0.9, 0.1), (0.3, 0.2, 0.1, 1.5))


def _window_sql() -> dict[str, tuple]:
    inverse = np.linalg.inv(np.array(_RESPONSE))
    names = ("k", "u", "th", "wave")
    total = lambda row: " + ".join(f"{x!r} * {n}" for n, x in zip(names, map(float, row)))
    out = {}
    for i, n in enumerate(("potassium", "uranium", "thorium", "radon")):
        out[n] = (lambda i=i: M.window_radon([c(x) for x in names], np.array(_RESPONSE))[0][i], total(inverse[i]))
    out["uranium_window"] = (lambda: M.window_radon([c(x) for x in names], np.array(_RESPONSE))[1][1], f"u - 0.4 * ({total(inverse[3])})")
    return out


scalar("calibrated_window_radon", "stations", "id", _window_sql())


@query("full_spectrum_radon")
def _(spark, sf):
    at = np.arange(64)
    response = np.stack([np.exp(-0.5 * ((at - m) / w) ** 2) for m, w in ((12, 4), (30, 5), (50, 6))] + [np.exp(-at / 20)], axis=1)

    def run(p):
        counts = np.abs(p["embedding"].astype(float)) * 100
        x, clean = M.full_spectrum_radon(counts, response, np.sqrt(counts + 1), 3)
        return {"vec_id": p["vec_id"], "radon": x[:, 3], "uranium": x[:, 1], "left": clean.sum(axis=1)}

    return S.batched(table(spark, sf, "embeddings"), run, ["vec_id", "embedding"], "vec_id long, radon double, uranium double, left double")


@query("paired_detector_radon")
def _(spark, sf):
    def run(p):
        t = np.arange(len(p)) * 1.0
        got = M.paired_radon(t, p["v"].to_numpy(), p["y"].to_numpy() * 0.03, np.full(len(p), 2.0), np.full(len(p), 1.0), alpha=0.5, beta=0.1, gamma=0.9, roughness=0.2)
        return pd.DataFrame({"row_id": p["row_id"], "ground": got["ground"], "radon": got["radon"], "sd": np.sqrt(got["radon_variance"])})

    return K.by_group(view(spark, sf, "flights").select("line", "row_id", "v", "y").where("v is not null and y is not null"), ["line"], run, "row_id long, ground double, radon double, sd double")


# dipoles, prisms
@query("dipole_fit", digits=4)
def _(spark, sf):
    """One dipole below each gather of ten spectra, from its field at 5 x 5 points and the spectra's noise."""
    at = np.array([[x, y, 0.0] for x in np.linspace(-4, 4, 5) for y in np.linspace(-4, 4, 5)])

    def run(p):
        rows = []
        for i, e in zip(p["vec_id"], p["embedding"].astype(float)):
            truth = np.array([(i % 7) * 0.3 - 1, (i % 5) * 0.4 - 0.8, -2.0])
            field = M.dipole_field(at, truth, np.array([0.1, 0.3, 1.0])) + 0.01 * e[: at.size % 64].mean()
            where, moment, rms = M.fit_dipole(at, field, np.array([0.0, 0.0, -2.5]), np.array([-4, -4, -6.0]), np.array([4, 4, -0.5]))
            rows.append((*where, np.linalg.norm(moment), rms))
        m = np.array(rows)
        return {"vec_id": p["vec_id"], **{n: m[:, k] for k, n in enumerate(("east", "north", "up", "moment", "rms"))}}

    e = table(spark, sf, "embeddings").select("vec_id", "embedding").repartition("vec_id")
    out = S.batched(e, run, ["vec_id", "embedding"], "vec_id long, east double, north double, up double, moment double, rms double")
    return out.select("vec_id", *[F.round(n, 3).alias(n) for n in ("east", "north", "up", "moment")])


_BLOCKS = ((100.0, 300.0, 50.0, 250.0, -160.0, -40.0, 300.0), (350.0, 500.0, 300.0, 450.0, -90.0, -30.0, -200.0))
_NAMES = ("west", "east", "south", "north", "bottom", "top", "rho")


def _prism_sql(columns: dict[str, tuple[float, dict[str, float]]], factor: str) -> str:
    """Sums over the blocks of ``factor`` times weighted gradients, for each column."""
    terms: dict[str, list[str]] = {n: [] for n in ("ee", "nn", "uu", "en", "eu", "nu")}
    for i, x in enumerate(("west", "east")):
        for j, y in enumerate(("south", "north")):
            for k, z in enumerate(("bottom", "top")):
                a, b, d = f"({x} - x)", f"({y} - y)", f"({z} - 0)"
                r = f"sqrt({a} * {a} + {b} * {b} + {d} * {d})"
                sign = "+" if (i + j + k) % 2 else "-"
                each = {"ee": f"-atan2({b} * {d}, {a} * {r})", "nn": f"-atan2({a} * {d}, {b} * {r})", "uu": f"-atan2({a} * {b}, {d} * {r})", "en": f"ln({d} + {r})", "eu": f"ln({b} + {r})", "nu": f"ln({a} + {r})"}
                for n, v in each.items():
                    terms[n].append(f"{sign} ({v})")
    rows = ", ".join("(" + ", ".join(f"{v!r}::DOUBLE" for v in p) + ")" for p in _BLOCKS)
    total = lambda of: " + ".join(f"({w!r}) * ({' '.join(terms[n])})" for n, w in of.items())
    picked = ", ".join(f"round(sum({scale!r} * {factor} * ({total(of)})), 6) AS {n}" for n, (scale, of) in columns.items())
    return f"SELECT id, {picked} FROM (SELECT id, x + 5e-1 AS x, y + 5e-1 AS y FROM points), (VALUES {rows}) s(west, east, south, north, bottom, top, rho) GROUP BY id"


def _tensor(spark, sf):
    p = view(spark, sf, "points").select("id", "v", (c("x") + 0.5).alias("x"), (c("y") + 0.5).alias("y"), P.literal_rows(_NAMES, _BLOCKS))
    return p, M.prism_tensor(c("x"), c("y"), F.lit(0.0), [c(n) for n in _NAMES[:6]], c("rho"))


@query("prism_gravity_tensor", _prism_sql({n: (6.67430e-2, {n: 1.0}) for n in ("ee", "nn", "uu", "en", "eu", "nu")}, "rho"))
def _(spark, sf):
    p, t = _tensor(spark, sf)
    return p.groupBy("id").agg(*[F.sum(v).alias(n) for n, v in t.items()])


# mu0 / 4 pi is 1e-7, and fields are nT
@query("prism_magnetic_field", _prism_sql({"be": (100.0, {"ee": 0.2, "en": 1.0, "eu": -0.5}), "bn": (100.0, {"en": 0.2, "nn": 1.0, "nu": -0.5}), "bu": (100.0, {"eu": 0.2, "nu": 1.0, "uu": -0.5})}, "1"))
def _(spark, sf):
    p, t = _tensor(spark, sf)
    p = p.withColumns({f"t_{n}": v / c("rho") for n, v in t.items()})
    field = M.prism_magnetic({n: c(f"t_{n}") for n in t}, (0.2, 1.0, -0.5))
    return p.groupBy("id").agg(*[F.sum(v).alias(n) for n, v in zip(("be", "bn", "bu"), field)])


@query("prism_density_fit")
def _(spark, sf):
    p = view(spark, sf, "points").select("id", "v", c("x"), c("y"))
    for k, b in enumerate(_BLOCKS):
        down = (*b[:4], -b[5], -b[4])
        p = p.withColumn(f"g{k}", P.prism_gravity(c("x"), c("y"), F.lit(0.0), [F.lit(v) for v in down], F.lit(1.0)))
    p = p.withColumn("one", F.lit(1.0)).withColumn("sd", F.lit(10.0))
    x, cov = M.fit_rows(p, ["g0", "g1", "one"], "v", "sd")
    return spark.createDataFrame([(n, float(a), float(math.sqrt(s))) for n, a, s in zip(("west", "centre", "offset"), x, np.diag(cov))], "prism string, density double, deviation double")


@query("prism_magnetization_fit")
def _(spark, sf):
    p = view(spark, sf, "points").select("v", (c("x") + 0.5).alias("x"), (c("y") + 0.5).alias("y")).withColumn("sd", F.lit(5.0)).withColumn("one", F.lit(1.0))
    direction = (math.cos(math.radians(60)) * math.sin(math.radians(5)), math.cos(math.radians(60)) * math.cos(math.radians(5)), -math.sin(math.radians(60)))
    t = M.prism_tensor(c("x"), c("y"), F.lit(0.0), [F.lit(v) for v in _BLOCKS[0][:6]], F.lit(1.0))
    p = p.withColumns({f"t_{n}": v for n, v in t.items()})
    for k, unit in enumerate(np.eye(3)):
        b = M.prism_magnetic({n: c(f"t_{n}") for n in t}, unit)
        p = p.withColumn(f"m{k}", sum((x * d for x, d in zip(b[1:], direction[1:])), b[0] * direction[0]))
    x, cov = M.fit_rows(p, ["m0", "m1", "m2", "one"], "v", "sd")
    return spark.createDataFrame([(n, float(a)) for n, a in zip(("east", "north", "up", "offset"), x)], "term string, value double")


# linear models of a station's kernels
def _kernels(spark, sf):
    s = _stations(spark, sf)
    return s.select(*[F.exp(-c("k") * (0.1 * (j + 1))).alias(f"g{j}") for j in range(6)], c("u").alias("d"), F.lit(0.1).alias("sd"))


_ROUGH = np.diff(np.eye(6), axis=0)


@query("linear_resolution_matrix")
def _(spark, sf):
    gram, right = M.weighted_gram(_kernels(spark, sf), [f"g{j}" for j in range(6)], "sd", "d")
    prior = np.vstack([_ROUGH, 0.1 * np.eye(6)])
    cov, res = M.posterior(gram, prior, 10.0)
    mean = cov @ right
    draws = np.percentile(M.ensemble(cov, mean, 500, 7), [2.5, 97.5], axis=0)
    spread = M.point_spread(lambda v: gram @ v, lambda v: 10.0 * prior.T @ (prior @ v), 6, [2])[1][:, 0]
    rows = [(j, float(mean[j]), float(math.sqrt(cov[j, j])), float(res[j, j]), float(spread[j])) for j in range(6)]
    assert (draws[0] <= draws[1]).all()
    return spark.createDataFrame(rows, "parameter int, mean double, deviation double, resolution double, spread double")


# waves and profiles
@query("diffraction_hyperbola_fit", digits=4)
def _(spark, sf):
    """Each spectrum's first 15 values shake the arrival times of a point below."""
    at = np.linspace(-3.0, 3.0, 15)

    def run(p):
        rows = []
        for i, e in zip(p["vec_id"], p["embedding"].astype(float)):
            t = np.sqrt((20e-9 + 1e-9 * (i % 5)) ** 2 + 4 * (at - 0.2) ** 2 / 1e8**2) * 1e9 + 0.2 * e[:15]
            x, chi = M.fit_hyperbola(at, t, 0.2, (0.0, 15.0, 0.12), (0.03, 0.3))
            rows.append((*x, chi))
        m = np.array(rows)
        return {"vec_id": p["vec_id"], **{n: m[:, k] for k, n in enumerate(("x0", "t0", "velocity", "chi"))}}

    out = S.batched(table(spark, sf, "embeddings"), run, ["vec_id", "embedding"], "vec_id long, x0 double, t0 double, velocity double, chi double")
    return out.select("vec_id", *[F.round(n, 3).alias(n) for n in ("x0", "t0", "velocity")])


@query("euler_line_profile")
def _(spark, sf):
    def run(p):
        x, f = np.arange(len(p)) * 10.0, p["v"].to_numpy(float)
        gx = np.gradient(f, 10.0) if len(f) > 1 else np.zeros(len(f))
        rows = [(p["line"].iloc[0], int(p["row_id"].iloc[i]), px, pz) for i, px, pz, _ in M.euler_profile(x, np.zeros(len(p)), f, gx, -np.abs(gx) - 0.1, 1.0)]
        return pd.DataFrame(rows, columns=["line", "row_id", "x", "z"])

    return K.by_group(view(spark, sf, "flights").select("line", "row_id", "v"), ["line"], run, "line long, row_id long, x double, z double")


@query("interpret_grid_rows")
def _(spark, sf):
    """Rows of the grid as profiles: Werner's sheet in each window."""

    def run(p):
        p = p.sort_values("c")
        z = p["z"].interpolate(limit_direction="both").to_numpy(float)
        rows = [(int(p["r"].iloc[0]), x, d) for x, d in K.werner_profile(p["c"].to_numpy() * 25.0, z)] if np.isfinite(z).all() else []
        return pd.DataFrame(rows, columns=["r", "x", "depth"])

    return view(spark, sf, "cells").select("r", "c", "z").groupBy("r").applyInPandas(run, "r int, x double, depth double")


# grids
@query("gradient_total_field")
def _(spark, sf):
    cells = G.products(_grid(spark, sf), 25.0, 25.0)

    def run(p):
        at = None
        parts = {}
        for name in ("gx", "gy", "gz"):
            z, r0, c0 = G.dense(p.assign(z=p[name]))
            parts[name] = np.where(np.isnan(z), 0, z)
            at = p["r"] - r0, p["c"] - c0
        f = M.field_from_gradients(25.0, 25.0, 0.0, east=parts["gx"], north=parts["gy"], up=-parts["gz"], damping=1e-4)
        return pd.DataFrame({"r": p["r"], "c": p["c"], "field": f[at]})

    near = G.tiles(cells.select("r", "c", "gx", "gy", "gz"), G.TILE, G.HALO)
    core = lambda p: run(p)[p["core"].to_numpy()]
    return near.groupBy("tile_r", "tile_c").applyInPandas(core, "r int, c int, field double")


@query("elastic_thickness_scan")
def _(spark, sf):
    thickness = [500.0, 1000.0, 2000.0, 4000.0, 8000.0]

    def run(p):
        z, r0, c0 = G.dense(p)
        load = np.where(np.isnan(z), 0, z - np.nanmean(z)) * 9.8 * 2670 / 1000
        truth = G.spectral_filter(load, 1000.0, 1000.0, [G.airy_flexure(2000.0)], detrend=-1, pad=0)
        chi = M.thickness_scan(load, truth, np.full(load.shape, 1e-3), 1000.0, 1000.0, thickness, gravity=9.81)
        return pd.DataFrame({"tile_r": p["tile_r"].iloc[0], "tile_c": p["tile_c"].iloc[0], "thickness": thickness, "chi_squared": chi})

    cells = view(spark, sf, "cells").select("r", "c", "z", F.floor(c("r") / G.TILE).alias("tile_r"), F.floor(c("c") / G.TILE).alias("tile_c"))
    return cells.groupBy("tile_r", "tile_c").applyInPandas(run, "tile_r long, tile_c long, thickness double, chi_squared double").select("tile_r", "tile_c", "thickness", F.log1p("chi_squared").alias("log_chi_squared"))


@query("skeleton_lines")
def _(spark, sf):
    def run(p):
        mask = np.zeros((int(p["r"].max()) - int(p["r"].min()) + 1, int(p["c"].max()) - int(p["c"].min()) + 1), bool)
        mask[p["r"] - p["r"].min(), p["c"] - p["c"].min()] = p["z2"] >= 30
        found = M.skeleton_paths(mask, 25.0, 25.0, float(p["c"].min()) * 25, float(p["r"].min()) * 25, 40.0)
        rows = [(int(p["tile_r"].iloc[0]), k, len(q), length, closed) for k, (q, length, closed) in enumerate(found)]
        return pd.DataFrame(rows, columns=["tile", "path", "points", "length", "closed"])

    cells = view(spark, sf, "cells").select("r", "c", "z2", F.floor(c("r") / 256).alias("tile_r"), F.floor(c("c") / 256).alias("tile_c"))
    return cells.groupBy("tile_r", "tile_c").applyInPandas(run, "tile long, path int, points int, length double, closed boolean")


# projections and the main field
_UTM = TransverseMercator.utm(19)


@query("reproject_xy", digits=4)
def _(spark, sf):
    s = _stations(spark, sf).select("id", (c("az") / 60 - 72).alias("lon"), (c("lat") * 0.9).alias("lat"))
    other = TransverseMercator.utm(18)
    s = reproject(s, "lon", "lat", None, _UTM, ("east", "north"))
    s = other.inverse(reproject(s, "east", "north", _UTM, other, ("e2", "n2")), "e2", "n2", ("lon2", "lat2"))
    return s.select("id", "east", "north", "e2", "n2", (c("lon2") - c("lon")).alias("lon_error"), (c("lat2") - c("lat")).alias("lat_error"))


# an axial dipole with a tilt: the coefficients of a model and date are a parameter
_DIPOLE = ((1, 0, -29_400.0, 0.0), (1, 1, -1_450.0, 4_650.0), (2, 0, -2_500.0, 0.0), (2, 1, 2_980.0, -2_990.0), (2, 2, 1_680.0, -735.0))


@query("pole_reduction_by_main_field")
def _(spark, sf):
    """Reduction to the pole with the main field's direction at the middle of the grid."""
    b = M.main_field(_DIPOLE, np.array([-70.0]), np.array([-20.0]), np.array([0.1]))[0]
    inclination, declination = float(np.degrees(np.arctan2(-b[2], math.hypot(b[0], b[1])))), float(np.degrees(np.arctan2(b[0], b[1])))
    return G.fft_filter(_grid(spark, sf), [G.field_transform((inclination, declination))], 25.0, 25.0).select("r", "c", "filtered")


@query("main_field_removal", digits=3)
def _(spark, sf):
    def run(p):
        b = M.main_field(_DIPOLE, p["az"], p["lat"] * 0.99, p["h"] / 1000)
        size = np.linalg.norm(b, axis=1)
        return {"id": p["id"], "anomaly": p["g"] - 978000 + 50000 - size, "inclination": np.degrees(np.arcsin(-b[:, 2] / size)), "declination": np.degrees(np.arctan2(b[:, 0], b[:, 1]))}

    return S.batched(_stations(spark, sf), run, ["id", "az", "lat", "h", "g"], "id long, anomaly double, inclination double, declination double")
