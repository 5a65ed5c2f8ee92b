"""Potential fields, radon, calibration and waveforms: sums over sources and small closed forms."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from .grids import Transfer, _safe

G_MGAL = 6.67430e-11 * 1e5


def literal_rows(names: Sequence[str], rows: Sequence[Sequence[float]]) -> Column:
    """A few sources as a generator: each observation meets all of them without a join."""
    return F.inline(F.array(*[F.struct(*[F.lit(float(v)).alias(n) for n, v in zip(names, r)]) for r in rows]))


def prism_gravity(x: Column, y: Column, z: Column, bounds: Sequence[Column], density: Column) -> Column:
    """Vertical attraction (mGal, down positive) of a rectangular prism (x1, x2, y1, y2, z1, z2; z down) at a place above it."""
    total = None
    for i in (0, 1):
        for j in (0, 1):
            for k in (0, 1):
                dx, dy, dz = bounds[i] - x, bounds[2 + j] - y, bounds[4 + k] - z
                r = F.sqrt(dx * dx + dy * dy + dz * dz)
                term = dx * F.ln(dy + r) + dy * F.ln(dx + r) - dz * F.atan2(dx * dy, dz * r)
                sign = 1 if (i + j + k) % 2 else -1
                total = term * sign if total is None else total + term * sign
    return total * density * G_MGAL


def terrain_effect(stations: DataFrame, cells: DataFrame, cell: float, radius: int, density: float, tile: int = 256) -> DataFrame:
    """(r, c, effect): the sum over the cells up to ``radius`` cells away of their columns' line-mass attraction
    relative to the station's height. Tiles of stations meet the cells of the tile and its rim, sent as rows of numbers; a place may
    have several of either."""
    offsets = [(i, j) for i in range(-radius, radius + 1) for j in range(-radius, radius + 1) if (i or j) and i * i + j * j <= radius * radius]
    width = tile + 4 * radius
    kinds = ", ".join(f"{n} {cells.schema[n].dataType.simpleString()}" for n in ("r", "c"))

    def run(key, own, near):
        if own.empty or near.empty:
            return pd.DataFrame({"r": [], "c": [], "effect": []})
        r0, c0 = (int(k) * tile - 2 * radius for k in key)
        at = lambda r, c: (r.to_numpy("int64") - r0) * width + c.to_numpy("int64") - c0
        place, z = at(own["r"], own["c"]), own["z"].to_numpy(float)
        around = at(near["nr"], near["nc"])
        order = np.argsort(around, kind="stable")
        around, h = around[order], near["h"].to_numpy(float)[order]
        effect, met = np.zeros(len(z)), np.zeros(len(z), bool)
        for i, j in offsets:
            d = cell * math.hypot(i, j)
            here, last = (np.searchsorted(around, place + i * width + j, side) for side in ("left", "right"))
            while (more := here < last).any():
                rise = h[here[more]] - z[more]
                effect[more] += 1 / d - 1 / np.sqrt(d * d + rise * rise)
                met |= more
                here = here + more
        place, effect = place[met], effect[met] * (G_MGAL * density * cell * cell)
        where, group = np.unique(place, return_inverse=True)
        valued = np.bincount(group, ~np.isnan(effect), len(where))
        total = np.where(valued > 0, np.bincount(group, np.nan_to_num(effect), len(where)), np.nan)
        return pd.DataFrame({"r": where // width + r0, "c": where % width + c0, "effect": total})

    span = lambda p: F.explode(F.sequence(F.floor((F.col(p) - radius) / tile), F.floor((F.col(p) + radius) / tile)))
    own = stations.where("r is not null and c is not null").select("r", "c", F.col("z").cast("double").alias("z"), F.floor(F.col("r") / tile).alias("__i"), F.floor(F.col("c") / tile).alias("__j"))
    near = cells.where("z is not null").withColumn("__i", span("r")).withColumn("__j", span("c")).select(F.col("r").alias("nr"), F.col("c").alias("nc"), F.col("z").cast("double").alias("h"), "__i", "__j")
    return own.groupBy("__i", "__j").cogroup(near.groupBy("__i", "__j")).applyInPandas(run, f"{kinds}, effect double")


def upward_radon(u: Column, th: Column, bt: Column, bu: Column, up: Column, a1: float, a2: float, au: float, at: float) -> Column:
    """Radon background in the uranium window from an upward detector."""
    return F.try_divide(up - u * a1 - th * a2 + bt * a2 - bu, F.lit(au - a1 - a2 * at))


def complex_response(re: Column, im: Column, gain: tuple[float, float], offset: tuple[float, float]) -> tuple[Column, Column]:
    """(value - offset) / gain."""
    a, b = re - offset[0], im - offset[1]
    size = gain[0] ** 2 + gain[1] ** 2
    return (a * gain[0] + b * gain[1]) / size, (b * gain[0] - a * gain[1]) / size


def covariance_transform(cov: Sequence[Sequence[Column]], matrix: Sequence[Sequence[float]]) -> list[list[Column]]:
    """A C A' of each row's covariance."""
    n, out = len(cov), []
    for p in matrix:
        row = []
        for q in matrix:
            total = None
            for i in range(n):
                for j in range(n):
                    if w := float(p[i]) * float(q[j]):
                        total = cov[i][j] * w if total is None else total + cov[i][j] * w
            row.append(total if total is not None else F.lit(0.0))
        out.append(row)
    return out


def piecewise_mean(df: DataFrame, keys: Sequence[str], time: str, value: str, start: float, end: float) -> DataFrame:
    """Mean over [start, end] of the lines between samples, exact at the edges of the gate."""
    from pyspark.sql import Window

    w = Window.partitionBy(*keys).orderBy(time)
    p = df.select(*keys, F.col(time).alias("t0"), F.col(value).alias("v0"), F.lead(time).over(w).alias("t1"), F.lead(value).over(w).alias("v1")).where("t1 is not null")
    p = p.withColumn("a", F.greatest("t0", F.lit(start))).withColumn("b", F.least("t1", F.lit(end))).where("b > a")
    at = lambda c: F.col("v0") + (F.col("v1") - F.col("v0")) * (F.col(c) - F.col("t0")) / (F.col("t1") - F.col("t0"))
    return p.groupBy(*keys).agg((F.sum((F.col("b") - F.col("a")) * (at("a") + at("b")) / 2) / (end - start)).alias("gate_mean"))


def depth_of_investigation(ma: Column, mb: Column, ra: float, rb: float, minimum: float = 1e-12) -> Column:
    """How much two inversions follow their reference models."""
    if abs(ra - rb) <= minimum:
        raise ValueError("the reference models are too much alike")
    return (ma - mb) / (ra - rb)


def inside_boxes(points: DataFrame, boxes: Sequence[tuple[float, float, float, float, str]], x: str, y: str) -> DataFrame:
    """The points inside each box (x0, x1, y0, y1, name), edges included."""
    names = F.array(*[F.when((F.col(x) >= b[0]) & (F.col(x) <= b[1]) & (F.col(y) >= b[2]) & (F.col(y) <= b[3]), b[4]) for b in boxes])
    return points.withColumn("box", F.explode(F.array_compact(names)))


# Fourier-domain operators of whole grids


def tabulated(k: Sequence[float], gain: Sequence[float]) -> Transfer:
    """A radial gain by linear interpolation of a table; its ends hold beyond it."""
    return lambda ke, kn, kr: np.interp(kr, k, gain)


def layer_response(top: float, bottom: float) -> Transfer:
    """Gravity of a flat layer per unit of density (mGal per kg/m3)."""
    return lambda ke, kn, k: 2 * np.pi * G_MGAL * np.where(k > 0, _safe(np.exp(-k * top) - np.exp(-k * bottom), k), bottom - top)


def apparent_property(top: float, bottom: float, damping: float = 0.05) -> Transfer:
    """The layer's property from its field, with a damped inverse."""
    forward = layer_response(top, bottom)

    def go(ke, kn, k):
        f = forward(ke, kn, k)
        return f / (f * f + (damping * np.abs(f).max()) ** 2)

    return go


def component(source: str, target: str) -> Transfer:
    """From one component of a potential field (east, north, up) to another."""
    parts = {"east": lambda ke, kn, k: 1j * ke, "north": lambda ke, kn, k: 1j * kn, "up": lambda ke, kn, k: -k}
    return lambda ke, kn, k: _safe(parts[target](ke, kn, k), parts[source](ke, kn, k))


def parker_root(depth: float, contrast: float, terms: int = 4):
    """A function (root thickness -> gravity at height 0) by the series of powers of the relief."""

    def go(t: np.ndarray, dx: float, dy: float) -> np.ndarray:
        kn, ke = np.meshgrid(2 * np.pi * np.fft.fftfreq(t.shape[0], dy), 2 * np.pi * np.fft.fftfreq(t.shape[1], dx), indexing="ij")
        k = np.hypot(ke, kn)
        total = np.zeros(t.shape, complex)
        for n in range(1, terms + 1):
            total += (-k) ** (n - 1) / math.factorial(n) * np.fft.fft2(t**n)
        return np.fft.ifft2(-2 * np.pi * G_MGAL * contrast * np.exp(-k * depth) * total).real

    return go


def monogenic(z: np.ndarray, dx: float, wavelengths: Sequence[float]) -> tuple[np.ndarray, np.ndarray]:
    """(amplitude, local phase in degrees) of log-Gabor bands and their Riesz parts, summed over the wavelengths."""
    kn, ke = np.meshgrid(2 * np.pi * np.fft.fftfreq(z.shape[0], dx), 2 * np.pi * np.fft.fftfreq(z.shape[1], dx), indexing="ij")
    k = np.hypot(ke, kn)
    spectrum = np.fft.fft2(z - z.mean())
    even, odd = np.zeros(z.shape), np.zeros(z.shape)
    for w in wavelengths:
        with np.errstate(divide="ignore"):
            band = np.where(k > 0, np.exp(-(np.log(np.where(k > 0, k, 1) * w / (2 * np.pi)) ** 2) / (2 * math.log(0.65) ** 2)), 0)
        even += np.fft.ifft2(spectrum * band).real
        odd += np.hypot(np.fft.ifft2(spectrum * band * -1j * _safe(ke, k)).real, np.fft.ifft2(spectrum * band * -1j * _safe(kn, k)).real)
    return np.hypot(even, odd), np.degrees(np.arctan2(odd, even))


def phase_velocity(traces: np.ndarray, offsets: np.ndarray, step: float, velocities: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(frequencies, power): phase-only steering of a gather; frequencies above the spatial alias limit are NaN."""
    spectrum = np.fft.rfft(traces, axis=1)
    f = np.fft.rfftfreq(traces.shape[1], step)
    unit = spectrum / np.maximum(np.abs(spectrum), 1e-300)
    steer = np.exp(2j * np.pi * f[None, None, :] * offsets[None, :, None] / velocities[:, None, None])
    power = np.abs((steer * unit[None]).mean(axis=1)) ** 2
    gap = np.diff(np.sort(offsets)).max() if len(offsets) > 1 else 0
    power[f[None, :] / velocities[:, None] > 0.5 / max(gap, 1e-300)] = np.nan
    return f, power


def hvsr(east: np.ndarray, north: np.ndarray, up: np.ndarray, step: float) -> tuple[np.ndarray, np.ndarray]:
    """(frequencies, ratio of the horizontal to the vertical amplitude) of one window."""
    taper = np.hanning(len(up) + 2)[1:-1]
    a = [np.abs(np.fft.rfft((x - x.mean()) * taper)) for x in (east, north, up)]
    return np.fft.rfftfreq(len(up), step)[1:], np.sqrt((a[0] ** 2 + a[1] ** 2) / 2)[1:] / np.maximum(a[2][1:], 1e-12)


def _inverse_distance(a: np.ndarray, b: np.ndarray, depth: float) -> np.ndarray:
    out = np.subtract.outer(a[:, 0], b[:, 0])
    out *= out
    dy = np.subtract.outer(a[:, 1], b[:, 1])
    dy *= dy
    out += dy
    out += depth * depth
    np.sqrt(out, out=out)
    return np.divide(1, out, out=out)


def equivalent_sources(xy: np.ndarray, value: np.ndarray, at: np.ndarray, depth: float, height: float, damping: float = 1e-3, *, times: np.ndarray | None = None, mean: float | None = None, ridge: float | None = None) -> np.ndarray:
    """Values at other places and ``height`` above from point sources under the data. A place measured ``times`` times
    (with ``value`` the mean there) counts as so many points. ``mean`` and ``ridge`` (the damping as it is added to the
    normal equations) are those of the data unless given."""
    times = np.ones(len(xy)) if times is None else times.astype(float)
    root = np.sqrt(times)
    k = _inverse_distance(xy, xy, depth)
    k *= root[:, None]
    k *= root
    if mean is None:
        mean = np.average(value, weights=times)
    right = k @ (root * (value - mean))
    k = k.T @ k
    k[np.diag_indices(len(k))] += damping * np.trace(k) / times.sum() if ridge is None else ridge
    return _inverse_distance(at, xy, depth + height) @ (root * np.linalg.solve(k, right)) + mean


def equivalent_source_tiles(points: DataFrame, key: str, x: str, y: str, value: str, depth: float, height: float, *, tile: int, halo: int, cell: int, reach: int, damping: float = 1e-3, into: str = "continued") -> DataFrame:
    """:func:`equivalent_sources` of any number of points: a solve per square tile, for the places of the tile alone. It has
    the places of the tile and ``halo`` around it singly, those beyond, as far as ``reach``, as means of their cells, which
    tile and halo are multiples of. Mean and damping are those of all points, the latter from pairs of at most 64 x 64
    cells. Points at one place share a source, which is the same fit. Every key is returned; null where a coordinate is null
    or no value within reach."""
    if tile % cell or halo % cell or reach % cell or not 0 <= halo <= reach:
        raise ValueError("tile, halo and reach are multiples of the cell, the halo within reach")
    n = points.select(F.col(key), F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y"), F.col(value).cast("double").alias("v"))
    places = n.where("x is not null and y is not null").groupBy("x", "y").agg(F.avg("v").alias("v"), F.count("v").alias("n"))
    full = places.where("n > 0")
    e = full.agg(F.min("x"), F.max("x"), F.min("y"), F.max("y"), F.sum(F.col("v") * F.col("n")) / F.sum("n")).first()
    if e[0] is None:
        return n.select(key, F.lit(None).cast("double").alias(into))
    side = max(e[1] - e[0], e[3] - e[2]) / 64 or 1.0
    coarse = [F.least(F.floor((F.col(p) - least) / side), F.lit(63)).alias("c" + p) for p, least in (("x", e[0]), ("y", e[2]))]
    mean_at = [F.sum(F.col(p) * F.col("n")) / F.sum("n") for p in ("x", "y")]
    cells = np.array(full.groupBy(*coarse).agg(*mean_at, F.sum("n")).drop("cx", "cy").collect(), float)
    ridge = damping * float(cells[:, 2] @ (_inverse_distance(cells[:, :2], cells[:, :2], depth) ** 2 @ cells[:, 2]) / cells[:, 2].sum())
    mean = float(e[4])

    def run(q):
        core, has = q["core"].to_numpy(), q["n"].to_numpy() > 0
        xy = q[["x", "y"]].to_numpy()
        out = np.full(int(core.sum()), np.nan)
        if len(out) and has.any():
            out = equivalent_sources(xy[has], q["v"].to_numpy()[has], xy[core], depth, height, times=q["n"].to_numpy()[has], mean=mean, ridge=ridge)
        return q.loc[core, ["x", "y"]].assign(**{into: out})

    def dealt(df, around):
        """To the tiles that have the cell within ``around``."""
        for p in ("x", "y"):
            low = F.col("c" + p) * cell
            df = df.withColumn("t" + p, F.explode(F.sequence(F.floor((low - around) / tile), F.floor((low + around) / tile))))
        return df

    in_cell = [F.floor(F.col(p) / cell).alias("c" + p) for p in ("x", "y")]
    near = dealt(places.select("x", "y", "v", "n", *in_cell), halo)
    near = near.withColumn("core", (F.floor(F.col("cx") * cell / tile) == F.col("tx")) & (F.floor(F.col("cy") * cell / tile) == F.col("ty")))
    far = full.groupBy(*in_cell).agg(*[m.alias(p) for m, p in zip(mean_at, ("x", "y"))], (F.sum(F.col("v") * F.col("n")) / F.sum("n")).alias("v"), F.sum("n").alias("n"))
    inside = [(F.col("c" + p) * cell >= F.col("t" + p) * tile - halo) & (F.col("c" + p) * cell < (F.col("t" + p) + 1) * tile + halo) for p in ("x", "y")]
    far = dealt(far, reach).where(~(inside[0] & inside[1])).withColumn("core", F.lit(False))
    near = near.unionByName(far)
    got = near.groupBy("tx", "ty").applyInPandas(run, f"x double, y double, {into} double")
    return n.select(key, "x", "y").join(got, ["x", "y"], "left").select(key, F.when(~F.isnan(into), F.col(into)).alias(into))
