"""Rasters as cell tables (grid, r, c, z): r grows to the north, c to the east; a null z is missing.

Stencils are windows or neighbour sums on the cell table; Fourier transforms run one NumPy
kernel per tile and its halo (:func:`by_tile`), so a grid of any size is many bounded tasks.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F

TILE, HALO = 512, 128  # cells: at most 768 x 768 in one call of a Fourier kernel

Transfer = Callable[[np.ndarray, np.ndarray, np.ndarray], np.ndarray]  # (k_east, k_north, k) -> response


def neighbour_sums(cells: DataFrame, weights: Sequence[tuple[int, int, float]], keys: Sequence[str] = ()) -> DataFrame:
    """Weighted mean of the neighbours at (dr, dc), over the cells that have values (partial sums before the shuffle)."""
    spread = F.inline(F.array(*[F.struct((F.col("r") + dr).alias("r2"), (F.col("c") + dc).alias("c2"), F.lit(w).alias("w")) for dr, dc, w in weights]))
    near = cells.where("z is not null").select(*keys, "r", "c", "z", spread).groupBy(*keys, F.col("r2").alias("r"), F.col("c2").alias("c")).agg(F.sum(F.col("w") * F.col("z")).alias("total"), F.sum("w").alias("weight"))
    return cells.join(near, [*keys, "r", "c"], "left").withColumn("smooth", F.when(F.col("z").isNotNull(), F.try_divide("total", "weight"))).drop("total", "weight")


def nine_point(cells: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Binomial 3 x 3 smoothing, normalised by the weights present."""
    return neighbour_sums(cells, [(i, j, float((2 - abs(i)) * (2 - abs(j)))) for i in (-1, 0, 1) for j in (-1, 0, 1)], keys)


def disk_median(cells: DataFrame, radius: int, keys: Sequence[str] = ()) -> DataFrame:
    """Median of the values within ``radius`` cells."""
    disk = [(i, j) for i in range(-radius, radius + 1) for j in range(-radius, radius + 1) if i * i + j * j <= radius * radius]
    spread = F.inline(F.array(*[F.struct((F.col("r") + i).alias("r2"), (F.col("c") + j).alias("c2")) for i, j in disk]))
    near = cells.where("z is not null").select(*keys, "z", spread).groupBy(*keys, F.col("r2").alias("r"), F.col("c2").alias("c")).agg(F.percentile("z", F.lit(0.5)).alias("median"))
    return cells.join(near, [*keys, "r", "c"], "left").withColumn("median", F.when(F.col("z").isNotNull(), F.col("median")))


def box_sums(cells: DataFrame, half: int, value: str, keys: Sequence[str] = ()) -> DataFrame:
    """``total`` and ``n`` of the (2 half + 1)^2 box around each cell, by two one-dimensional windows."""
    row = Window.partitionBy(*keys, "r").orderBy("c").rangeBetween(-half, half)
    col = Window.partitionBy(*keys, "c").orderBy("r").rangeBetween(-half, half)
    part = cells.withColumn("__s", F.sum(value).over(row)).withColumn("__n", F.count(value).over(row))
    return part.withColumn("total", F.sum("__s").over(col)).withColumn("n", F.sum("__n").over(col)).drop("__s", "__n")


def automatic_gain(cells: DataFrame, window: int, keys: Sequence[str] = (), floor_fraction: float = 0.05, max_gain: float = 10.0) -> DataFrame:
    """Scales each value by global RMS / local RMS, at most ``max_gain``."""
    out = box_sums(cells.withColumn("__e", F.col("z") * F.col("z")), window // 2, "__e", keys)
    root = cells.groupBy(*keys).agg(F.sqrt(F.avg(F.col("z") * F.col("z"))).alias("__g"))
    out = out.join(root, list(keys)) if keys else out.crossJoin(F.broadcast(root))  # without keys: one row
    local = F.sqrt(F.try_divide("total", "n"))
    return out.withColumn("gained", F.col("z") * F.least(F.try_divide("__g", F.greatest(local, F.col("__g") * floor_fraction)), F.lit(max_gain))).drop("__e", "__g", "total", "n")


def gradients(cells: DataFrame, dx: float, dy: float, keys: Sequence[str] = ()) -> DataFrame:
    """Central differences gx, gy (null at the rim and beside missing cells) and thdr."""
    row, col = Window.partitionBy(*keys, "r").orderBy("c"), Window.partitionBy(*keys, "c").orderBy("r")
    def central(w, pos: str, step: float):
        whole = (F.col(pos) - F.lag(pos).over(w) == 1) & (F.lead(pos).over(w) - F.col(pos) == 1)
        return F.when(whole, (F.lead("z").over(w) - F.lag("z").over(w)) / (2 * step))
    out = cells.withColumn("gx", central(row, "c", dx)).withColumn("gy", central(col, "r", dy))
    return out.withColumn("thdr", F.hypot("gx", "gy"))


def hillshade(cells: DataFrame, azimuth: float, altitude: float, dx: float, dy: float, keys: Sequence[str] = ()) -> DataFrame:
    g = gradients(cells, dx, dy, keys)
    az, alt = math.radians(azimuth), math.radians(altitude)
    dot = (-F.col("gx") * math.sin(az) - F.col("gy") * math.cos(az)) * math.cos(alt) + math.sin(alt)
    return g.withColumn("shade", F.greatest(F.lit(0.0), dot / F.sqrt(F.col("gx") * F.col("gx") + F.col("gy") * F.col("gy") + 1)))


def shifted(cells: DataFrame, dr: int, dc: int, keys: Sequence[str] = (), into: str = "shifted") -> DataFrame:
    """The value dr rows and dc columns back, without wrapping."""
    moved = cells.select(*keys, (F.col("r") + dr).alias("r"), (F.col("c") + dc).alias("c"), F.col("z").alias(into))
    return cells.join(moved, [*keys, "r", "c"], "left")


def compare(a: DataFrame, b: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """One row: support and difference of two rasters of one geometry."""
    both = a.select(*keys, "r", "c", F.col("z").alias("za")).join(b.select(*keys, "r", "c", F.col("z").alias("zb")), [*keys, "r", "c"], "full")
    d = F.col("za") - F.col("zb")
    return both.agg(
        F.count_if(F.col("za").isNotNull() & F.col("zb").isNull()).alias("before_only"),
        F.count_if(F.col("za").isNull() & F.col("zb").isNotNull()).alias("after_only"),
        F.count(d).alias("common"),
        F.sqrt(F.avg(d * d)).alias("rms"),
        F.avg(F.abs(d)).alias("mae"),
        F.max(F.abs(d)).alias("worst"),
        F.percentile(F.abs(d), F.lit(0.95)).alias("p95"),
    )


def zonal(cells: DataFrame, zone: str) -> DataFrame:
    return cells.groupBy(zone).agg(F.count("*").alias("cells"), F.count("z").alias("valid"), F.avg("z").alias("mean"), F.min("z").alias("low"), F.max("z").alias("high"))


def block_mean(points: DataFrame, x: str, y: str, value: str, x0: float, y0: float, cell: float) -> DataFrame:
    """Mean position and value of the points nearest to each node (halves upwards)."""
    node = lambda c, o: F.floor((F.col(c) - o) / cell + 0.5).cast("int")
    return points.groupBy(node(y, y0).alias("r"), node(x, x0).alias("c")).agg(F.avg(x).alias("x"), F.avg(y).alias("y"), F.avg(value).alias("z"), F.count("*").alias("n"))


def mosaic(layers: Sequence[DataFrame]) -> DataFrame:
    """The mean of the layers' values at each cell."""
    out = layers[0].select("r", "c", "z")
    for layer in layers[1:]:
        out = out.unionByName(layer.select("r", "c", "z"))
    return out.groupBy("r", "c").agg(F.avg("z").alias("z"), F.count("z").alias("layers"))


def tiles(cells: DataFrame, size: int, halo: int, keys: Sequence[str] = ()) -> DataFrame:
    """Each cell in every tile whose core or halo has it, of the tiles with a cell in their core: columns tile_r, tile_c and ``core``."""
    lo = lambda p: F.floor((F.col(p) - halo) / size)
    hi = lambda p: F.floor((F.col(p) + halo) / size)
    out = cells.withColumn("tile_r", F.explode(F.sequence(lo("r"), hi("r")))).withColumn("tile_c", F.explode(F.sequence(lo("c"), hi("c"))))
    core = (F.floor(F.col("r") / size) == F.col("tile_r")) & (F.floor(F.col("c") / size) == F.col("tile_c"))
    own = Window.partitionBy(*keys, "tile_r", "tile_c")
    return out.withColumn("core", core).withColumn("__cores", F.max("core").over(own)).where("__cores").drop("__cores")


def by_tile(cells: DataFrame, kernel: Callable[[pd.DataFrame], pd.DataFrame], names: Sequence[str], *, grid: str = "grid", tile: int = TILE, halo: int = HALO) -> DataFrame:
    """One call of the kernel per tile and its halo (a frame of grid, r, c, z, one row a cell, whose rows it keeps in place); of its rows (grid, r, c, z and ``names``, doubles) the
    core's stay. A grid not larger than a tile and its halo is one call of its own cells, so a group never has more than
    (tile + 2 halo)^2 cells; across tiles a transform sees ``halo`` cells beyond its core and no more, which is enough
    for responses that fade within them."""
    kind = cells.schema[grid].dataType.simpleString()

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        out = kernel(pdf[[grid, "r", "c", "z"]].copy())[[grid, "r", "c", "z", *names]]
        return out[pdf["core"].to_numpy()]

    cut = tiles(cells.select(grid, "r", "c", "z"), tile, halo, [grid])
    return cut.groupBy(grid, "tile_r", "tile_c").applyInPandas(run, f"{grid} {kind}, r int, c int, z double, " + ", ".join(f"{n} double" for n in names))


def euler_solutions(cells: DataFrame, dx: float, dy: float, index: float, *, window: int = 9, stride: int = 1, tile: int = 32, grid: str = "grid") -> DataFrame:
    """Euler solutions (r and c of the window's middle, samples, x, y, depth, condition) of a window about every ``stride``-th cell
    of level grids with z and gx, gy, gz. Windows over missing cells or an edge have the cells that are there, five at least."""
    from .kernels import euler_windows

    if window < 3 or window % 2 == 0 or stride < 1:
        raise ValueError("an odd window of 3 cells at least, a stride of 1 at least")
    half = window // 2
    kind = cells.schema[grid].dataType.simpleString()

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        r0, c0 = int(pdf["tile_r"].iloc[0]) * tile, int(pdf["tile_c"].iloc[0]) * tile
        at = pdf["r"].to_numpy() - r0 + half, pdf["c"].to_numpy() - c0 + half
        fields = np.full((4, tile + 2 * half, tile + 2 * half), np.nan)
        fields[(slice(None), *at)] = pdf[["z", "gx", "gy", "gz"]].to_numpy(float).T
        there = np.zeros((tile + 2 * half, tile + 2 * half), bool)
        there[at] = True
        r, c, n, x, y, depth, condition = euler_windows(*fields, dx, dy, index, window)
        found = pd.DataFrame({grid: pdf[grid].iloc[0], "r": r + r0, "c": c + c0, "samples": n, "x": x + (c0 - half) * dx, "y": y + (r0 - half) * dy, "depth": depth, "condition": condition})
        return found[there[r + half, c + half] & (found["r"] % stride == 0) & (found["c"] % stride == 0)]

    near = cells.select(grid, "r", "c", "z", "gx", "gy", "gz")
    for p in ("r", "c"):
        near = near.withColumn(f"tile_{p}", F.explode(F.sequence(F.floor((F.col(p) - half) / tile), F.floor((F.col(p) + half) / tile))))
    return near.groupBy(grid, "tile_r", "tile_c").applyInPandas(run, f"{grid} {kind}, r int, c int, samples int, x double, y double, depth double, condition double")


# whole-grid Fourier filters


def dense(pdf: pd.DataFrame, value: str = "z") -> tuple[np.ndarray, int, int]:
    """(2-D values with NaN for missing cells, least row, least column)."""
    r0, c0 = int(pdf["r"].min()), int(pdf["c"].min())
    out = np.full((int(pdf["r"].max()) - r0 + 1, int(pdf["c"].max()) - c0 + 1), np.nan)
    out[pdf["r"] - r0, pdf["c"] - c0] = pdf[value].to_numpy(float)
    return out, r0, c0


def _filled(z: np.ndarray) -> np.ndarray:
    """Missing cells take the value of the nearest valid cell, ring by ring."""
    out = z.copy()
    while np.isnan(out).any():
        padded = np.pad(out, 1, constant_values=np.nan)
        around = np.stack([padded[1 + i : padded.shape[0] - 1 + i, 1 + j : padded.shape[1] - 1 + j] for i in (-1, 0, 1) for j in (-1, 0, 1) if i or j])
        n = (~np.isnan(around)).sum(axis=0)
        mean = np.nansum(around, axis=0) / np.maximum(n, 1)
        hole = np.isnan(out) & (n > 0)
        if not hole.any():
            return np.zeros_like(out)
        out[hole] = mean[hole]
    return out


def spectral_filter(z: np.ndarray, dx: float, dy: float, transfers: Sequence[Transfer], *, detrend: int = 1, pad: float = 0.25) -> np.ndarray:
    """Fills, takes off a plane (1), mean (0) or nothing (-1), pads by reflection with a
    taper over the margin, multiplies the spectrum by all transfers at once, and cuts back.
    A trend that the transfers keep is put back only for responses of 1 at wavenumber 0."""
    missing = np.isnan(z)
    full = _filled(z)
    rows, cols = np.mgrid[0 : z.shape[0], 0 : z.shape[1]]
    design = {1: [np.ones(z.size), rows.ravel(), cols.ravel()], 0: [np.ones(z.size)]}.get(detrend)
    trend = np.zeros_like(full)
    if design is not None:
        a = np.stack(design, axis=1)
        keep = ~missing.ravel()
        coefficients, *_ = np.linalg.lstsq(a[keep], full.ravel()[keep], rcond=None)
        trend = (a @ coefficients).reshape(z.shape)
    py, px = (min(max(1, int(n * pad)), n - 1) if n > 1 else 0 for n in z.shape)
    work = np.pad(full - trend, ((py, py), (px, px)), mode="reflect")
    for axis, p in ((0, py), (1, px)):
        ramp = np.ones(work.shape[axis])
        if p:
            ramp[:p] = np.sin(np.pi / 2 * (np.arange(p) + 0.5) / p)
            ramp[-p:] = ramp[:p][::-1]
        work = work * (ramp[:, None] if axis == 0 else ramp[None, :])
    kn, ke = np.meshgrid(2 * np.pi * np.fft.fftfreq(work.shape[0], dy), 2 * np.pi * np.fft.fftfreq(work.shape[1], dx), indexing="ij")
    k = np.hypot(ke, kn)
    response = np.ones(work.shape, complex)
    for t in transfers:
        response = response * t(ke, kn, k)
    out = np.fft.ifft2(np.fft.fft2(work) * response).real[py : py + z.shape[0], px : px + z.shape[1]]
    if abs(response[0, 0] - 1) < 1e-12:
        out = out + trend
    out[missing] = np.nan
    return out


def fft_filter(cells: DataFrame, transfers: Sequence[Transfer], dx: float, dy: float, *, grid: str = "grid", detrend: int = 1, pad: float = 0.25, tile: int = TILE, halo: int = HALO) -> DataFrame:
    """``cells`` (grid, r, c, z) with ``filtered``; consecutive filters are one pass (give all their transfers). Grids larger than
    ``tile`` are filtered by tiles with ``halo`` cells around them (see :func:`by_tile`)."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        z, r0, c0 = dense(pdf)
        out = spectral_filter(z, dx, dy, transfers, detrend=detrend, pad=pad)
        pdf["filtered"] = out[pdf["r"] - r0, pdf["c"] - c0]
        return pdf

    out = by_tile(cells, run, ["filtered"], grid=grid, tile=tile, halo=halo)
    return out.withColumn("filtered", F.when(~F.isnan("filtered"), F.col("filtered"))).withColumn("z", F.when(~F.isnan("z"), F.col("z")))


def _safe(top: np.ndarray | float, bottom: np.ndarray) -> np.ndarray:
    with np.errstate(divide="ignore", invalid="ignore"):
        return np.where(np.abs(bottom) > 1e-15, top / np.where(np.abs(bottom) > 1e-15, bottom, 1), 0)


def derivative(direction: str, order: int = 1) -> Transfer:
    """``east``, ``north`` or ``up`` (positive upwards: -k) derivative."""
    return {"east": lambda ke, kn, k: (1j * ke) ** order, "north": lambda ke, kn, k: (1j * kn) ** order, "up": lambda ke, kn, k: (-k) ** order}[direction]


def directional_derivative(azimuth: float) -> Transfer:
    """The horizontal derivative towards an azimuth (degrees clockwise from north)."""
    a = math.radians(azimuth)
    return lambda ke, kn, k: 1j * (ke * math.sin(a) + kn * math.cos(a))


def continuation(height: float) -> Transfer:
    return lambda ke, kn, k: np.exp(-k * height)


def downward(height: float, wavelength: float, order: int = 2, max_gain: float = 100.0) -> Transfer:
    return lambda ke, kn, k: np.exp(np.minimum(k * height, math.log(max_gain))) * butterworth(wavelength, order)(ke, kn, k)


def butterworth(wavelength: float, order: int, high: bool = False) -> Transfer:
    cut = 2 * math.pi / wavelength
    if high:
        return lambda ke, kn, k: np.where(k > 0, 1 / np.sqrt(1 + _safe(cut, k) ** (2 * order)), 0)
    return lambda ke, kn, k: 1 / np.sqrt(1 + (k / cut) ** (2 * order))


def gaussian(wavelength: float, high: bool = False) -> Transfer:
    cut = 2 * math.pi / wavelength
    low = lambda ke, kn, k: np.exp(-0.5 * (k / cut) ** 2)
    return (lambda ke, kn, k: 1 - low(ke, kn, k)) if high else low


def ideal(long: float, short: float, reject: bool = False) -> Transfer:
    a, b = 2 * math.pi / long, 2 * math.pi / short
    return lambda ke, kn, k: ((k >= a) & (k <= b)) != reject


def cosine_rolloff(long: float, short: float, degree: int = 2, high: bool = False) -> Transfer:
    a, b = 2 * math.pi / long, 2 * math.pi / short

    def low(ke, kn, k):
        return np.where(k <= a, 1.0, np.where(k >= b, 0.0, np.cos(np.clip((k - a) / (b - a), 0, 1) * np.pi / 2) ** degree))

    return (lambda ke, kn, k: 1 - low(ke, kn, k)) if high else low


def directional(azimuth: float, degree: int = 2, reject: bool = False) -> Transfer:
    """Passes structures that run along the azimuth."""

    def go(ke, kn, k):
        g = np.where(k > 0, np.abs(np.cos(np.arctan2(ke, kn) - (math.radians(azimuth % 180) + np.pi / 2))) ** degree, 1.0)
        return 1 - g if reject else g

    return go


def microlevel(azimuth: float, across: float, along: float) -> Transfer:
    """The corrugation along lines of an azimuth that is to be taken off."""
    a = math.radians(azimuth)

    def go(ke, kn, k):
        k_along, k_across = ke * math.sin(a) + kn * math.cos(a), ke * math.cos(a) - kn * math.sin(a)
        return (1 - np.exp(-0.5 * (k_across * across / (2 * np.pi)) ** 4)) * np.exp(-0.5 * (k_along * along / (2 * np.pi)) ** 2)

    return go


def integration(direction: str) -> Transfer:
    return {"east": lambda ke, kn, k: _safe(1, 1j * ke), "north": lambda ke, kn, k: _safe(1, 1j * kn), "up": lambda ke, kn, k: _safe(1, k)}[direction]


def direction_factor(inclination: float, declination: float) -> Transfer:
    i, d = math.radians(inclination), math.radians(declination)
    return lambda ke, kn, k: math.sin(i) + 1j * math.cos(i) * _safe(math.sin(d) * ke + math.cos(d) * kn, k)


def field_transform(source: tuple[float, float], target: tuple[float, float] = (90.0, 0.0), magnetization: tuple[float, float] | None = None, max_gain: float = 100.0) -> Transfer:
    """From one field direction (inclination, declination) to another; the default target is the pole."""
    s, t, m = direction_factor(*source), direction_factor(*target), direction_factor(*(magnetization or source))

    def go(ke, kn, k):
        out = np.where(k > 0, _safe(t(ke, kn, k) ** 2, s(ke, kn, k) * m(ke, kn, k)), 0)
        size = np.abs(out)
        return np.where(size > max_gain, out * _safe(max_gain, size), out)

    return go


def pseudogravity(inclination: float, declination: float, scale: float = 1.0) -> Transfer:
    rtp = field_transform((inclination, declination))
    return lambda ke, kn, k: rtp(ke, kn, k) * _safe(scale, k)


def airy_flexure(thickness: float, crust: float = 2670.0, mantle: float = 3300.0, young: float = 1e11, poisson: float = 0.25, gravity: float = 9.81) -> Transfer:
    """Deflection of a thin elastic plate under a load given as pressure."""
    rigidity = young * thickness**3 / (12 * (1 - poisson**2))
    return lambda ke, kn, k: 1 / (rigidity * k**4 + (mantle - crust) * gravity)


def products(cells: DataFrame, dx: float, dy: float, *, grid: str = "grid", inclination: float | None = None, declination: float = 0.0, pad: float = 0.25, tile: int = TILE, halo: int = HALO) -> DataFrame:
    """Derivative products of each grid from one padded spectrum (after reduction to the pole if
    an inclination is given): dx, dy, dz, dz2, thdr, analytic signal, tilt, tdx, theta, and upward residual."""
    first = [] if inclination is None else [field_transform((inclination, declination))]
    names = ("gx", "gy", "gz", "gzz", "thdr", "analytic", "tilt", "tdx", "theta")

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        z, r0, c0 = dense(pdf)
        get = lambda *t: spectral_filter(z, dx, dy, [*first, *t], pad=pad)
        gx, gy, gz, gzz = get(derivative("east")), get(derivative("north")), -get(derivative("up")), get(derivative("up", 2))
        thdr = np.hypot(gx, gy)
        signal = np.hypot(thdr, gz)
        values = (gx, gy, gz, gzz, thdr, signal, np.degrees(np.arctan2(gz, thdr)), np.degrees(np.arctan2(thdr, np.abs(gz))), np.degrees(np.arccos(np.clip(_safe(thdr, signal), -1, 1))) * (signal > 0))
        at = pdf["r"] - r0, pdf["c"] - c0
        return pdf.assign(**{n: v[at] for n, v in zip(names, values)})

    out = by_tile(cells, run, names, grid=grid, tile=tile, halo=halo)
    return out.select(grid, "r", "c", *[F.when(~F.isnan(n), F.col(n)).alias(n) for n in ("z", *names)])


def radial_spectrum(z: np.ndarray, dx: float, dy: float, bins: int, azimuth: float | None = None, half_width: float = 15.0) -> pd.DataFrame:
    """Mean power by radial wavenumber of a plane-detrended, Hann-tapered grid; the last bin is closed. With an azimuth (degrees
    counterclockwise from easting, modulo 180), only wavenumbers at most ``half_width`` degrees from that axis, at both its ends."""
    if azimuth is not None and not (np.isfinite(azimuth) and 0 < half_width <= 90):
        raise ValueError("a finite azimuth, a half width over 0 and up to 90 degrees")
    rows, cols = np.mgrid[0 : z.shape[0], 0 : z.shape[1]]
    full = _filled(z)
    a = np.stack([np.ones(z.size), rows.ravel(), cols.ravel()], axis=1)
    coefficients, *_ = np.linalg.lstsq(a, full.ravel(), rcond=None)
    work = (full - (a @ coefficients).reshape(z.shape)) * np.outer(np.hanning(z.shape[0] + 2)[1:-1], np.hanning(z.shape[1] + 2)[1:-1])
    power = np.abs(np.fft.fft2(work)) ** 2 / z.size
    kn, ke = np.meshgrid(2 * np.pi * np.fft.fftfreq(z.shape[0], dy), 2 * np.pi * np.fft.fftfreq(z.shape[1], dx), indexing="ij")
    k = np.hypot(ke, kn).ravel()
    top = min(np.pi / dx, np.pi / dy)
    inside = (k > 0) & (k <= top)
    if azimuth is not None:
        inside &= np.abs((np.degrees(np.arctan2(kn, ke)).ravel() - azimuth + 90) % 180 - 90) <= half_width
    b = np.minimum((k[inside] / top * bins).astype(int), bins - 1)
    n = np.bincount(b, minlength=bins)
    return pd.DataFrame({"bin": np.arange(bins), "k": np.bincount(b, k[inside], bins) / np.maximum(n, 1), "power": np.bincount(b, power.ravel()[inside], bins) / np.maximum(n, 1), "n": n})[n > 0]


def block_spectra(cells: DataFrame, dx: float, dy: float, bins: int, *, grid: str = "grid", block: int = TILE, azimuth: float | None = None) -> DataFrame:
    """(grid, bin, k, power, n): :func:`radial_spectrum` of blocks of a grid, averaged over its blocks by their samples (partial
    sums before the shuffle)."""
    kind = cells.schema[grid].dataType.simpleString()

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        return radial_spectrum(dense(pdf)[0], dx, dy, bins, azimuth).assign(**{grid: pdf[grid].iloc[0]})[[grid, "bin", "k", "power", "n"]]

    cut = cells.select(grid, "r", "c", "z", F.floor(F.col("r") / block).alias("tile_r"), F.floor(F.col("c") / block).alias("tile_c"))
    each = cut.groupBy(grid, "tile_r", "tile_c").applyInPandas(run, f"{grid} {kind}, bin int, k double, power double, n long")
    mean = lambda x: F.try_divide(F.sum(F.col(x) * F.col("n")), F.sum("n")).alias(x)
    return each.groupBy(grid, "bin").agg(mean("k"), mean("power"), F.sum("n").alias("n"))


def minimum_curvature_tiles(nodes: DataFrame, *, tile: int = TILE, halo: int = HALO, tolerance: float = 1e-4, rounds: int = 2000) -> DataFrame:
    """(r, c, z) of every cell of the tiles that have a node, from node means (r, c, z), rows and columns from 0 to the
    largest: one relaxation per tile and its halo."""
    from .kernels import minimum_curvature

    top = nodes.agg(F.max("r").alias("r"), F.max("c").alias("c")).first()

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        tr, tc = int(pdf["tile_r"].iloc[0]), int(pdf["tile_c"].iloc[0])
        r0, c0 = max(0, tr * tile - halo), max(0, tc * tile - halo)
        r1, c1 = min(top["r"] + 1, (tr + 1) * tile + halo), min(top["c"] + 1, (tc + 1) * tile + halo)
        out, _ = minimum_curvature(pdf["r"].to_numpy() - r0, pdf["c"].to_numpy() - c0, pdf["z"].to_numpy(), (r1 - r0, c1 - c0), tolerance=tolerance, rounds=rounds)
        r, c = (i.ravel() for i in np.indices(out.shape))
        found = pd.DataFrame({"r": r + r0, "c": c + c0, "z": out.ravel()})
        return found[(found["r"] // tile == tr) & (found["c"] // tile == tc)]

    return tiles(nodes.select("r", "c", "z"), tile, halo).groupBy("tile_r", "tile_c").applyInPandas(run, "r int, c int, z double")
