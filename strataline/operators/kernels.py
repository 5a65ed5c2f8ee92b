"""Numerical kernels on one line, trace, spectrum or neighbourhood, in NumPy.

They are for ``applyInPandas`` and Arrow functions; :func:`by_group` wraps one.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame


def by_group(df: DataFrame, keys: Sequence[str], kernel: Callable[[pd.DataFrame], pd.DataFrame], schema: str) -> DataFrame:
    """One call of the kernel per group, in row_id order where there is one."""
    ordered = "row_id" in df.columns

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        return kernel(pdf.sort_values("row_id") if ordered else pdf)

    return df.groupBy(*keys).applyInPandas(run, schema)


# recursive filters


def butterworth_sections(order: int, cutoff: float, high: bool = False) -> np.ndarray:
    """Second-order sections (b0 b1 b2 1 a1 a2) of a digital Butterworth filter; ``cutoff`` in cycles per
    sample, by the bilinear transform of the analogue poles."""
    if order < 1 or not 0 < cutoff < 0.5:
        raise ValueError("order >= 1 and 0 < cutoff < 0.5")
    w = math.tan(math.pi * cutoff)
    out = []
    for i in range(order // 2):
        q = 2 * math.sin(math.pi * (2 * i + 1) / (2 * order))
        d = 1 + q * w + w * w
        b = [1, -2, 1] if high else [w * w, 2 * w * w, w * w]
        out.append([*(x / d for x in b), 1, 2 * (w * w - 1) / d, (1 - q * w + w * w) / d])
    if order % 2:
        d = 1 + w
        b = [1, -1, 0] if high else [w, w, 0]
        out.append([*(x / d for x in b), 1, (w - 1) / d, 0])
    return np.array(out)


def notch_section(frequency: float, quality: float) -> np.ndarray:
    """One section that takes off a frequency (cycles per sample)."""
    w = 2 * math.pi * frequency
    a = math.sin(w) / (2 * quality)
    c = math.cos(w)
    return np.array([[1 / (1 + a), -2 * c / (1 + a), 1 / (1 + a), 1, -2 * c / (1 + a), (1 - a) / (1 + a)]])


_SPAN = 64  # samples that go through a section at once


def _run_sections(sections: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Second-order sections one after the other, started in the steady state of the first sample. A span of samples is a
    product with the section's impulse response; only its two states pass from span to span."""
    y, level = x.astype(float), float(x[0])
    for b0, b1, b2, _, a1, a2 in sections:
        gain = (b0 + b1 + b2) / (1 + a1 + a2)
        move, feed = np.array([[-a1, 1.0], [-a2, 0.0]]), np.array([b1 - a1 * b0, b2 - a2 * b0])
        powers = [np.eye(2)]
        for _ in range(_SPAN):
            powers.append(move @ powers[-1])
        seen = np.array([p[0] for p in powers[:_SPAN]])  # what a state adds to each output of the span
        impulse = np.concatenate(([b0], seen[:-1] @ feed))
        lag = np.subtract.outer(np.arange(_SPAN), np.arange(_SPAN))
        response = np.where(lag >= 0, impulse[lag.clip(min=0)], 0.0)
        collect = np.array([powers[_SPAN - 1 - k] @ feed for k in range(_SPAN)])  # what an input adds to the state after the span
        n = -(-len(y) // _SPAN)
        spans = np.zeros((n, _SPAN))
        spans.ravel()[: len(y)] = y
        added = spans @ collect
        states = np.empty((n, 2))
        state, whole = np.array([level * (gain - b0), level * (b2 - a2 * gain)]), powers[_SPAN]
        for i in range(n):
            states[i] = state
            state = whole @ state + added[i]
        y, level = (spans @ response.T + states @ seen.T).ravel()[: len(y)], level * gain
    return y


def zero_phase(sections: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Forwards and backwards with odd padding; NaN where the run is too short for the padding."""
    pad = 3 * (2 * len(sections) + 1)
    if len(x) <= pad:
        return np.full(len(x), np.nan)
    ends = np.concatenate([2 * x[0] - x[pad:0:-1], x, 2 * x[-1] - x[-2 : -pad - 2 : -1]])
    once = _run_sections(sections, ends)
    return _run_sections(sections, once[::-1])[::-1][pad:-pad]


def welch(x: np.ndarray, step: float, segment: int) -> tuple[np.ndarray, np.ndarray]:
    """Frequencies and mean one-sided power of half-overlapping Hann segments, means taken off."""
    n = min(segment, len(x))
    window = 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(n) / n)
    starts = range(0, len(x) - n + 1, max(1, n // 2))
    power = np.mean([np.abs(np.fft.rfft((x[s : s + n] - x[s : s + n].mean()) * window)) ** 2 for s in starts], axis=0) * step / (window**2).sum()
    power[1 : -1 if n % 2 == 0 else None] *= 2
    return np.fft.rfftfreq(n, step), power


def admittance(x: np.ndarray, y: np.ndarray, step: float, segment: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Frequencies, real admittance of y on x, coherence."""
    n = min(segment, len(x))
    window = 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(n) / n)
    xx = yy = xy = 0
    for s in range(0, len(x) - n + 1, max(1, n // 2)):
        a, b = (np.fft.rfft((v[s : s + n] - v[s : s + n].mean()) * window) for v in (x, y))
        xx, yy, xy = xx + np.abs(a) ** 2, yy + np.abs(b) ** 2, xy + np.conj(a) * b
    floor = 1e-12 * np.max(xx)
    return np.fft.rfftfreq(n, step), np.where(xx > floor, xy.real / np.maximum(xx, 1e-300), np.nan), np.abs(xy) ** 2 / np.maximum(xx * yy, 1e-300)


# linear problems


def nnls(a: np.ndarray, b: np.ndarray, rounds: int = 1000) -> np.ndarray:
    """Least squares with non-negative unknowns, by an active set."""
    n = a.shape[1]
    x, free = np.zeros(n), np.zeros(n, bool)
    for _ in range(rounds):
        w = a.T @ (b - a @ x)
        w[free] = -np.inf
        if free.all() or w.max() <= 1e-10 * max(1.0, np.abs(a.T @ b).max()):
            break
        free[int(np.argmax(w))] = True
        while True:
            s = np.zeros(n)
            s[free] = np.linalg.lstsq(a[:, free], b, rcond=None)[0]
            low = free & (s <= 0)
            if not low.any():
                x = s
                break
            t = np.min(x[low] / (x[low] - s[low]))
            x = x + t * (s - x)
            free &= x > 1e-14
            x[~free] = 0
    return x


def gls(design: np.ndarray, observed: np.ndarray, covariance: np.ndarray, max_condition: float = 1e10) -> tuple[np.ndarray, np.ndarray, float]:
    """(estimate, its covariance, chi square) of whitened, column-scaled least squares."""
    root = np.linalg.cholesky(covariance)
    a, b = np.linalg.solve(root, design), np.linalg.solve(root, observed)
    scale = np.linalg.norm(a, axis=0)
    u, s, v = np.linalg.svd(a / scale, full_matrices=False)
    if s[-1] * max_condition < s[0]:
        raise ValueError("the calibration is ill-conditioned")
    x = v.T @ (u.T @ b / s) / scale
    return x, (v.T / s**2 @ v) / np.outer(scale, scale), float(((b - a @ x) ** 2).sum())


def nasvd(counts: np.ndarray, rank: int) -> np.ndarray:
    """Spectra (rows) rebuilt from the first components after Poisson whitening."""
    mean = np.maximum(counts.mean(axis=0), 1e-12)
    exposure = np.maximum(counts.sum(axis=1, keepdims=True) / mean.sum(), 1e-12)
    white = counts / np.sqrt(exposure * mean)
    u, s, v = np.linalg.svd(white, full_matrices=False)
    return (u[:, :rank] * s[:rank]) @ v[:rank] * np.sqrt(exposure * mean)


def difference_noise(data: np.ndarray, floor: float = 1e-6) -> np.ndarray:
    """Noise covariance of all channels from the differences of successive spectra (rows). Under two rows more than channels it
    would be singular, and its empty directions would pass for signal: then the channels' noise counts as independent."""
    cov = np.atleast_2d(np.cov(np.diff(data, axis=0).T)) / 2
    if len(data) - 2 < data.shape[1]:
        cov = np.diag(np.diag(cov))
    return cov + np.eye(len(cov)) * floor


def mnf(data: np.ndarray, noise: np.ndarray, keep: int) -> np.ndarray:
    """Minimum noise fraction: components in order of signal over noise, the first ``keep`` rebuilt."""
    mean = data.mean(axis=0)
    root = np.linalg.cholesky(noise)
    white = np.linalg.solve(root, (data - mean).T).T
    _, vectors = np.linalg.eigh(np.cov(white.T))
    best = vectors[:, ::-1][:, :keep]
    return (white @ best @ best.T) @ root.T + mean


# interpolation


def thin_plate(xy: np.ndarray, z: np.ndarray, at: np.ndarray, smoothing: float = 0.0) -> np.ndarray:
    """Thin-plate spline with a plane, in coordinates scaled by their largest range."""
    origin, scale = xy.mean(axis=0), max(float(np.ptp(xy, axis=0).max()), 1e-12)
    p, q = (xy - origin) / scale, (at - origin) / scale

    def basis(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        r2 = ((a[:, None, :] - b[None, :, :]) ** 2).sum(axis=2)
        return np.where(r2 > 0, 0.5 * r2 * np.log(np.maximum(r2, 1e-300)), 0)

    n = len(p)
    system = np.zeros((n + 3, n + 3))
    system[:n, :n] = basis(p, p) + smoothing * np.eye(n)
    system[:n, n:] = np.column_stack([np.ones(n), p])
    system[n:, :n] = system[:n, n:].T
    w = np.linalg.lstsq(system, np.concatenate([z, np.zeros(3)]), rcond=None)[0]
    return basis(q, p) @ w[:n] + np.column_stack([np.ones(len(q)), q]) @ w[n:]


def ordinary_kriging(xy: np.ndarray, z: np.ndarray, at: np.ndarray, sill: float, reach: float, nugget: float = 0.0) -> tuple[float, float]:
    """(estimate, variance) at one place from its neighbours by a spherical variogram; an exact hit wins; under 3 neighbours: NaN."""
    d = np.hypot(*(xy - at).T)
    if (d <= 1e-12).any():
        return float(z[d <= 1e-12].mean()), 0.0
    if len(z) < 3:
        return math.nan, math.nan

    def gamma(h: np.ndarray) -> np.ndarray:
        t = np.minimum(h / reach, 1)
        return np.where(h > 0, nugget + (sill - nugget) * (1.5 * t - 0.5 * t**3), 0)

    n = len(z)
    system = np.ones((n + 1, n + 1))
    system[:n, :n] = gamma(np.hypot(xy[:, None, 0] - xy[None, :, 0], xy[:, None, 1] - xy[None, :, 1])) / sill
    system[n, n] = 0
    right = np.append(gamma(d) / sill, 1.0)
    w = np.linalg.lstsq(system, right, rcond=None)[0]
    return float(w[:n] @ z), float(w @ right * sill)


def minimum_curvature(r: np.ndarray, c: np.ndarray, z: np.ndarray, shape: tuple[int, int], tolerance: float = 1e-4, rounds: int = 2000, relaxation: float = 1.4) -> tuple[np.ndarray, int]:
    """Grid of least curvature through values at nodes, coarse to fine; a plane is taken off first.
    The biharmonic stencil is relaxed node by node of alternating colours; returns (grid, rounds used)."""
    a = np.column_stack([np.ones(len(z)), r, c])
    plane, *_ = np.linalg.lstsq(a, z, rcond=None)
    rest = z - a @ plane
    grid, used = None, 0
    for factor in (16, 8, 4, 2, 1):
        size = tuple(max(3, -(-n // factor) + (factor > 1)) for n in shape)
        rr, cc = np.minimum(np.rint(r / factor).astype(int), size[0] - 1), np.minimum(np.rint(c / factor).astype(int), size[1] - 1)
        at = rr * size[1] + cc
        n = np.bincount(at, minlength=size[0] * size[1])
        fixed = (n > 0).reshape(size)
        value = (np.bincount(at, rest, size[0] * size[1]) / np.maximum(n, 1)).reshape(size)
        if grid is None:
            grid = np.where(fixed, value, rest.mean())
        else:
            y, x = np.meshgrid(np.arange(size[0]) * (grid.shape[0] - 1) / max(size[0] - 1, 1), np.arange(size[1]) * (grid.shape[1] - 1) / max(size[1] - 1, 1), indexing="ij")
            y0, x0 = np.minimum(y.astype(int), grid.shape[0] - 2), np.minimum(x.astype(int), grid.shape[1] - 2)
            fy, fx = y - y0, x - x0
            grid = (grid[y0, x0] * (1 - fy) + grid[y0 + 1, x0] * fy) * (1 - fx) + (grid[y0, x0 + 1] * (1 - fy) + grid[y0 + 1, x0 + 1] * fy) * fx
            grid = np.where(fixed, value, grid)
        colour = (np.add.outer(np.arange(size[0]), 2 * np.arange(size[1]))) % 5
        for used in range(1, rounds + 1):
            change = 0.0
            for k in range(5):
                p = np.pad(grid, 2, mode="reflect", reflect_type="odd")
                near = p[1:-3, 2:-2] + p[3:-1, 2:-2] + p[2:-2, 1:-3] + p[2:-2, 3:-1]
                diagonal = p[1:-3, 1:-3] + p[1:-3, 3:-1] + p[3:-1, 1:-3] + p[3:-1, 3:-1]
                far = p[:-4, 2:-2] + p[4:, 2:-2] + p[2:-2, :-4] + p[2:-2, 4:]
                move = ((8 * near - 2 * diagonal - far) / 20 - grid) * relaxation / 1.4
                sel = (colour == k) & ~fixed
                grid = np.where(sel, grid + move, grid)
                change = max(change, float(np.abs(move[sel]).max(initial=0)))
            if change < tolerance:
                break
    rows, cols = np.mgrid[0 : shape[0], 0 : shape[1]]
    return grid[: shape[0], : shape[1]] + plane[0] + plane[1] * rows + plane[2] * cols, used


def lanczos(values: np.ndarray, at: np.ndarray, a: int = 3) -> np.ndarray:
    """Samples of a regular series between its points by a windowed sinc, weights normalised at the ends."""
    base = np.floor(at).astype(int)
    out, weight = np.zeros(len(at)), np.zeros(len(at))
    for k in range(-a + 1, a + 1):
        i = base + k
        inside = (i >= 0) & (i < len(values))
        w = np.where(inside, np.sinc(at - i) * np.sinc((at - i) / a), 0)
        out += w * values[i.clip(0, len(values) - 1)]
        weight += w
    return out / np.where(np.abs(weight) > 1e-9, weight, np.nan)


# source depths


def euler_window(x: np.ndarray, y: np.ndarray, z: np.ndarray, field: np.ndarray, gx: np.ndarray, gy: np.ndarray, gz: np.ndarray, index: float, max_condition: float = 1e6) -> tuple[float, float, float, float] | None:
    """(x, y, z of the source, condition) of one window, or None where it isn't determined. Coordinates and
    field are centred; columns are scaled before the singular value decomposition."""
    cx, cy, cz, cf = x.mean(), y.mean(), z.mean(), field.mean()
    last = np.full(len(x), index if index else 1.0)
    a = np.column_stack([gx, gy, gz, last])
    b = (x - cx) * gx + (y - cy) * gy + (z - cz) * gz + index * (field - cf)
    scale = np.linalg.norm(a, axis=0)
    if (scale == 0).any():
        return None
    u, s, v = np.linalg.svd(a / scale, full_matrices=False)
    if s[-1] * max_condition < s[0]:
        return None
    p = v.T @ (u.T @ b / s) / scale
    return cx + p[0], cy + p[1], cz + p[2], float(s[0] / s[-1])


def euler_windows(z: np.ndarray, gx: np.ndarray, gy: np.ndarray, gz: np.ndarray, dx: float, dy: float, index: float, window: int = 9, max_condition: float = 1e6) -> tuple[np.ndarray, ...]:
    """:func:`euler_window` at every position of a window in a level grid with NaN for missing cells, all at once:
    (row and column of the window's first cell, cells it has, x, y, depth, condition) of the solutions, from the grid's corner.
    A window needs five cells."""
    cut = lambda a: np.lib.stride_tricks.sliding_window_view(a, (window, window)).reshape(-1, window * window)
    values = [cut(a) for a in (z, gx, gy, gz)]
    rows, cols = np.mgrid[0 : z.shape[0] - window + 1, 0 : z.shape[1] - window + 1]
    valid = np.isfinite(values).all(axis=0)
    keep = np.flatnonzero(valid.sum(axis=1) >= 5)
    valid, n, at = valid[keep], valid[keep].sum(axis=1), (rows.ravel()[keep], cols.ravel()[keep])
    f, a, b, d = (np.where(valid, v[keep], 0.0) for v in values)
    r, c = np.divmod(np.arange(window * window), window)
    x, y = (at[1][:, None] + c) * dx, (at[0][:, None] + r) * dy
    centre = lambda v: (v * valid).sum(axis=1) / n
    cx, cy, cf = centre(x), centre(y), centre(f)
    design = np.stack([a, b, d, valid * (index if index else 1.0)], axis=2)
    right = ((x - cx[:, None]) * a + (y - cy[:, None]) * b + index * (f - cf[:, None])) * valid
    scale = np.linalg.norm(design, axis=1)
    full = np.flatnonzero((scale > 0).all(axis=1))
    u, s, v = np.linalg.svd(design[full] / scale[full][:, None, :], full_matrices=False)
    good = s[:, -1] * max_condition >= s[:, 0]
    u, s, v, full = u[good], s[good], v[good], full[good]
    p = np.einsum("nkj,nk->nj", v, np.einsum("nik,ni->nk", u, right[full]) / s) / scale[full]
    return at[0][full], at[1][full], n[full], cx[full] + p[:, 0], cy[full] + p[:, 1], p[:, 2], s[:, 0] / s[:, -1]


def werner_profile(x: np.ndarray, f: np.ndarray, window: int = 7, stride: int = 1) -> list[tuple[float, float]]:
    """:func:`werner_window` at each ``stride``-th position of the window along a profile."""
    return [w for i in range(0, len(f) - window + 1, stride) if (w := werner_window(x[i : i + window], f[i : i + window]))]


def werner_window(x: np.ndarray, f: np.ndarray) -> tuple[float, float] | None:
    """(position, depth) of a thin sheet under a profile window, or None."""
    centre, half, sd = x.mean(), max(np.ptp(x) / 2, 1e-12), f.std()
    if sd == 0:
        return None
    t, g = (x - centre) / half, (f - f.mean()) / sd
    a = np.column_stack([g, t * g, np.ones(len(t)), t])
    b, _, rank, _ = np.linalg.lstsq(a, g * t * t, rcond=None)
    square = -b[0] - (b[1] / 2) ** 2
    return (centre + half * b[1] / 2, half * math.sqrt(square)) if rank == 4 and square > 0 else None


# electromagnetics


def layered_impedance(frequency: np.ndarray, resistivity: Sequence[float], thickness: Sequence[float]) -> np.ndarray:
    """Surface impedance of a layered earth, exp(+i w t); thick layers take tanh as 1."""
    iwm = 2j * np.pi * frequency * 4e-7 * np.pi
    z = np.sqrt(iwm * resistivity[-1])
    for rho, h in zip(reversed(resistivity[:-1]), reversed(thickness)):
        own, q = np.sqrt(iwm * rho), np.sqrt(iwm / rho) * h
        t = np.where(q.real < 20, np.tanh(np.where(q.real < 20, q, 0)), 1)
        z = own * (z + own * t) / (own + z * t)
    return z


def fit_bounded(model: Callable[[np.ndarray], np.ndarray], observed: np.ndarray, start: np.ndarray, low: np.ndarray, high: np.ndarray, rounds: int = 100) -> tuple[np.ndarray, float]:
    """Nonlinear least squares in a box by damped Gauss-Newton steps with projection; (parameters, rms)."""
    x, damping = np.clip(start.astype(float), low, high), 1e-2
    r = model(x) - observed
    cost = float(r @ r)
    for _ in range(rounds):
        steps = np.maximum(1e-6 * np.abs(x), 1e-9)
        sides = [(np.minimum(x + d * e, high), np.maximum(x - d * e, low)) for d, e in zip(steps, np.eye(len(x)))]  # within the box
        j = np.column_stack([(model(a) - model(b)) / max((a - b).sum(), 1e-300) for a, b in sides])
        gram, g = j.T @ j, j.T @ r
        scale = np.diag(np.maximum(np.diag(gram), 1e-300))
        moved = False
        for _ in range(20):
            new = np.clip(x - np.linalg.lstsq(gram + damping * scale, g, rcond=None)[0], low, high)
            rn = model(new) - observed
            if float(rn @ rn) < cost:
                moved = cost - float(rn @ rn) > 1e-14 * max(cost, 1e-300)
                x, r, cost, damping = new, rn, float(rn @ rn), max(damping / 5, 1e-12)
                break
            damping *= 5
        if not moved:
            break
    return x, math.sqrt(cost / max(len(observed), 1))


def polygon_gravity(stations: np.ndarray, vertices: np.ndarray, density: float) -> np.ndarray:
    """Vertical attraction (mGal) of a two-dimensional polygon (x, depth), edge by edge, at (x, depth) stations."""
    out = np.zeros(len(stations))
    area = np.sum(vertices[:, 0] * np.roll(vertices[:, 1], -1) - np.roll(vertices[:, 0], -1) * vertices[:, 1])
    ring = vertices if area > 0 else vertices[::-1]
    for i, (sx, sz) in enumerate(stations):
        p = ring - (sx, sz)
        q = np.roll(p, -1, axis=0)
        d = q - p
        length2 = (d**2).sum(axis=1)
        cross = p[:, 0] * q[:, 1] - q[:, 0] * p[:, 1]
        r1, r2 = np.maximum((p**2).sum(axis=1), 1e-300), np.maximum((q**2).sum(axis=1), 1e-300)
        turn = np.arctan2(cross, (p * q).sum(axis=1))
        out[i] = np.sum(cross / np.maximum(length2, 1e-300) * (d[:, 1] * 0.5 * np.log(r2 / r1) - d[:, 0] * turn) * (length2 > 0))
    return 2 * 6.67430e-11 * density * 1e5 * out
