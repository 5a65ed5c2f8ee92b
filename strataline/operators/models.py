"""Small models in NumPy: linear resolution, radon, dipoles, prisms, diffractions, plates, profiles and skeletons.

They run on one survey, line, spectrum or grid in a task; what grows with the data is summed by Spark first.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F

from ..functions.geophysics import finite
from .kernels import fit_bounded

G_SI = 6.67430e-11
MU0 = 4e-7 * math.pi


# linear Gaussian models


def posterior(gram: np.ndarray, regularization: np.ndarray, beta: float) -> tuple[np.ndarray, np.ndarray]:
    """(covariance, resolution) from the weighted normal matrix of the data and the matrix of the prior."""
    precision = gram + beta * regularization.T @ regularization
    root = np.linalg.cholesky(precision)  # raises where data and prior leave a direction free
    half = np.linalg.solve(root, np.eye(len(gram)))
    covariance = half.T @ half
    return covariance, covariance @ gram


def weighted_gram(rows: DataFrame, columns: Sequence[str], deviation: str, target: str | None = None) -> tuple[np.ndarray, np.ndarray | None]:
    """(G' W G, G' W d) of a sensitivity table with a row per datum: one aggregation, however many data."""
    w = 1 / (F.col(deviation) * F.col(deviation))
    parts = [F.sum(w * F.col(a) * F.col(b)).alias(f"a{i}_{j}") for i, a in enumerate(columns) for j, b in enumerate(columns) if j >= i]
    if target:
        parts += [F.sum(w * F.col(a) * F.col(target)).alias(f"b{i}") for i, a in enumerate(columns)]
    row = rows.agg(*parts).first()
    n = len(columns)
    gram = np.array([[row[f"a{min(i, j)}_{max(i, j)}"] for j in range(n)] for i in range(n)], float)
    return gram, np.array([row[f"b{i}"] for i in range(n)], float) if target else None


def ensemble(covariance: np.ndarray, mean: np.ndarray, count: int, seed: int) -> np.ndarray:
    """Draws (count x parameters) of the posterior."""
    root = np.linalg.cholesky((covariance + covariance.T) / 2)
    return mean + np.random.default_rng(seed).normal(size=(count, len(mean))) @ root.T


def conjugate_gradients(apply: Callable[[np.ndarray], np.ndarray], right: np.ndarray, tolerance: float = 1e-10, rounds: int = 1000) -> np.ndarray:
    """Solutions of one symmetric positive definite system for many right sides (columns), together."""
    x = np.zeros_like(right, float)
    r = right.astype(float).copy()
    p, rr = r.copy(), (r * r).sum(axis=0)
    goal = tolerance**2 * np.maximum(rr, 1e-300)
    for _ in range(rounds):
        if (rr <= goal).all():
            return x
        q = apply(p)
        step = np.where(rr > goal, rr / np.maximum((p * q).sum(axis=0), 1e-300), 0)
        x, r = x + step * p, r - step * q
        new = (r * r).sum(axis=0)
        p, rr = r + np.where(rr > goal, new / np.maximum(rr, 1e-300), 0) * p, new
    raise ValueError("the solves have not converged")


def stochastic_resolution(gram: Callable[[np.ndarray], np.ndarray], prior: Callable[[np.ndarray], np.ndarray], n: int, probes: int, seed: int) -> tuple[np.ndarray, np.ndarray, float]:
    """Estimates of the diagonals of covariance and resolution and of the trace of the resolution, by probes of random signs:
    the matrices are only ever applied."""
    z = np.random.default_rng(seed).choice([-1.0, 1.0], size=(n, probes))
    precise = lambda v: gram(v) + prior(v)
    c = (z * conjugate_gradients(precise, z)).mean(axis=1)
    r = (z * conjugate_gradients(precise, gram(z))).mean(axis=1)
    return c, r, float(r.sum())


def point_spread(gram: Callable[[np.ndarray], np.ndarray], prior: Callable[[np.ndarray], np.ndarray], n: int, at: Sequence[int]) -> tuple[np.ndarray, np.ndarray]:
    """Columns ``at`` of covariance and resolution."""
    unit = np.eye(n)[:, list(at)]
    precise = lambda v: gram(v) + prior(v)
    return conjugate_gradients(precise, unit), conjugate_gradients(precise, gram(unit))


# radon


def window_radon(rates: Sequence[Column], response: np.ndarray, radon: int = 3) -> tuple[list[Column], list[Column]]:
    """(components, rates without the radon) of window rates that are ``response`` (windows x components) times the components."""
    response = np.asarray(response, float)
    if np.linalg.cond(response / np.linalg.norm(response, axis=0)) > 1e8:
        raise ValueError("the response is ill-conditioned")
    inverse = np.linalg.inv(response)
    total = lambda row: finite(sum((r * float(x) for r, x in zip(rates[1:], row[1:])), rates[0] * float(row[0])))
    parts = [total(row) for row in inverse]
    return parts, [finite(r - parts[radon] * float(response[i, radon])) for i, r in enumerate(rates)]


def full_spectrum_radon(spectra: np.ndarray, response: np.ndarray, deviation: np.ndarray, radon: int) -> tuple[np.ndarray, np.ndarray]:
    """(signed components, spectra without the radon) of spectra (records x channels), each weighted by its own deviations."""
    w = 1 / deviation**2
    gram = np.einsum("ca,nc,cb->nab", response, w, response)
    x = np.linalg.solve(gram, np.einsum("ca,nc->na", response, w * spectra)[..., None])[..., 0]
    return x, spectra - x[:, radon : radon + 1] * response[:, radon]


def paired_radon(time: np.ndarray, down: np.ndarray, up: np.ndarray, down_sd: np.ndarray, up_sd: np.ndarray, *, alpha: float, beta: float, gamma: float, roughness: float, covariance: np.ndarray | float = 0.0) -> dict[str, np.ndarray]:
    """Ground rate g and radon r of one run, from down = g + alpha r and up = beta g + gamma r with Gaussian errors, and a pull of
    ``roughness`` (r[i + 1] - r[i])^2 / dt between neighbours in time; with marginal variances. The radon alone is seen by up - beta
    down; its smoothing is a tridiagonal system, solved by elimination."""
    gain = gamma - alpha * beta
    if abs(gain) <= 1e-8 * max(abs(gamma), abs(alpha * beta)):
        raise ValueError("the detectors can't tell ground and radon apart")
    raw, weight = (up - beta * down) / gain, gain**2 / (up_sd**2 + beta**2 * down_sd**2 - 2 * beta * covariance)
    n = len(time)
    tie = np.zeros(n + 1)
    tie[1:-1] = roughness / np.diff(time)
    diagonal = weight + tie[:-1] + tie[1:]
    # what elimination from the left and from the right leaves of each diagonal
    left, right = diagonal.copy(), diagonal.copy()
    from_left, from_right = weight * raw, weight * raw
    for i in range(1, n):
        f = tie[i] / left[i - 1]
        left[i] -= tie[i] * f
        from_left[i] += f * from_left[i - 1]
        j = n - 1 - i
        f = tie[j + 1] / right[j + 1]
        right[j] -= tie[j + 1] * f
        from_right[j] += f * from_right[j + 1]
    precision = left + right - diagonal
    radon, variance = (from_left + from_right - weight * raw) / precision, 1 / precision
    noise = down_sd**2 * up_sd**2 - covariance**2
    by_down, by_up = (up_sd**2 - beta * covariance) / noise, (beta * down_sd**2 - covariance) / noise
    strength = by_down + beta * by_up
    slope = (alpha * by_down + gamma * by_up) / strength
    return {"ground": (by_down * down + by_up * up) / strength - slope * radon, "radon": radon, "raw_radon": raw, "ground_variance": 1 / strength + slope**2 * variance, "radon_variance": variance}


# dipoles and prisms


def dipole_field(at: np.ndarray, source: np.ndarray, moment: np.ndarray) -> np.ndarray:
    """Field (nT, east north up) at points of one dipole (A m^2)."""
    d = at - source
    n = np.linalg.norm(d, axis=1, keepdims=True)
    return MU0 / (4 * math.pi) * 1e9 * (3 * d * (d @ moment)[:, None] / n**5 - moment / n**3)


def fit_dipole(at: np.ndarray, observed: np.ndarray, start: np.ndarray, low: np.ndarray, high: np.ndarray, direction: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, float]:
    """(position, moment, rms) of a dipole from its vector field, or its projection on ``direction``. The moment is linear, so
    only the position is searched, within its box; the moment at each is the least squares'."""
    observed = np.asarray(observed, float).ravel()

    def columns(p: np.ndarray) -> np.ndarray:
        f = np.stack([dipole_field(at, p, e) for e in np.eye(3)], axis=2)  # points x components x moments
        return (np.einsum("c,pcm->pm", direction, f) if direction is not None else f.reshape(-1, 3)) if f.size else np.zeros((0, 3))

    def residual(p: np.ndarray) -> np.ndarray:
        a = columns(p)
        return a @ np.linalg.lstsq(a, observed, rcond=None)[0] - observed

    p, rms = fit_bounded(residual, np.zeros(len(observed)), np.asarray(start, float), np.asarray(low, float), np.asarray(high, float))
    a = columns(p)
    return p, np.linalg.lstsq(a, observed, rcond=None)[0], rms


def prism_tensor(x: Column, y: Column, z: Column, bounds: Sequence[Column], density: Column) -> dict[str, Column]:
    """Gravity gradients (Eotvos; east, north, up) at a point of a prism (west, east, south, north, bottom, top)."""
    west, east, south, north, bottom, top = bounds
    dx, dy, dz = (west - x, east - x), (south - y, north - y), (bottom - z, top - z)
    sums: dict[str, Column] = {}
    for i in (0, 1):
        for j in (0, 1):
            for k in (0, 1):
                a, b, c = dx[i], dy[j], dz[k]
                r = F.sqrt(a * a + b * b + c * c)
                sign = 1.0 if (i + j + k) % 2 else -1.0  # + at the corner of all upper bounds
                corner = {"ee": -F.atan2(b * c, a * r), "nn": -F.atan2(a * c, b * r), "uu": -F.atan2(a * b, c * r), "en": F.ln(c + r), "eu": F.ln(b + r), "nu": F.ln(a + r)}
                for name, v in corner.items():
                    sums[name] = sums[name] + v * sign if name in sums else v * sign
    return {name: finite(v * density * (G_SI * 1e9)) for name, v in sums.items()}


def prism_magnetic(tensor: dict[str, Column], magnetization: Sequence[float], density: float = 1.0) -> list[Column]:
    """Field (nT, east north up) of a prism with a magnetization (A/m), by Poisson's relation from its gradients (Eotvos) at ``density``."""
    scale = MU0 / (4 * math.pi) / (G_SI * 1e9 * density) * 1e9
    rows = (("ee", "en", "eu"), ("en", "nn", "nu"), ("eu", "nu", "uu"))
    return [finite(sum((tensor[n] * float(m) for n, m in zip(row[1:], magnetization[1:])), tensor[row[0]] * float(magnetization[0])) * scale) for row in rows]


def fit_rows(rows: DataFrame, columns: Sequence[str], target: str, deviation: str, max_condition: float = 1e8) -> tuple[np.ndarray, np.ndarray]:
    """(coefficients, covariance) of weighted least squares on kernel columns, from one aggregation; scaled columns decide the condition."""
    gram, right = weighted_gram(rows, columns, deviation, target)
    scale = np.sqrt(np.diag(gram))
    if (scale == 0).any() or np.linalg.cond(gram / np.outer(scale, scale)) > max_condition**2:
        raise ValueError("the sources can't be told apart")
    inverse = np.linalg.inv(gram / np.outer(scale, scale)) / np.outer(scale, scale)
    return inverse @ right, inverse


# waves, plates, potential fields


def fit_hyperbola(position: np.ndarray, time: np.ndarray, deviation: np.ndarray | float, start: Sequence[float], velocity: tuple[float, float]) -> tuple[np.ndarray, float]:
    """((x0, t0, v), chi square) of a diffraction t^2 = t0^2 + 4 (x - x0)^2 / v^2."""
    sd = np.broadcast_to(np.asarray(deviation, float), time.shape)
    model = lambda p: np.sqrt(p[1] ** 2 + 4 * (position - p[0]) ** 2 / p[2] ** 2) / sd
    wide = np.ptp(position)
    p, rms = fit_bounded(model, time / sd, np.asarray(start, float), np.array([position.min() - wide, 0.0, velocity[0]]), np.array([position.max() + wide, float(time.max()), velocity[1]]))
    return p, rms**2 * len(time)


def thickness_scan(load: np.ndarray, observed: np.ndarray, deviation: np.ndarray, dx: float, dy: float, candidates: Sequence[float], *, young: float = 1e11, poisson: float = 0.25, contrast: float = 630.0, gravity: float = 9.80665) -> np.ndarray:
    """Chi square of each plate thickness for an observed deflection (down) under a load (pressure); NaN deflections don't count."""
    kn, ke = np.meshgrid(2 * np.pi * np.fft.fftfreq(load.shape[0], dy), 2 * np.pi * np.fft.fftfreq(load.shape[1], dx), indexing="ij")
    spectrum, k4 = np.fft.fft2(load), (ke**2 + kn**2) ** 2
    stiff = young / (12 * (1 - poisson**2))
    return np.array([np.nansum(((np.fft.ifft2(spectrum / (stiff * t**3 * k4 + contrast * gravity)).real - observed) / deviation) ** 2) for t in candidates])


def field_from_gradients(dx: float, dy: float, mean: float, *, east: np.ndarray | None = None, north: np.ndarray | None = None, up: np.ndarray | None = None, weights: dict[str, float] | None = None, damping: float = 0.0) -> np.ndarray:
    """The field whose gradients fit the given ones best, wavenumber by wavenumber (i ke, i kn, -k); Nyquist rows and columns, and
    what no gradient shows, are 0 but for the mean."""
    given = {n: g for n, g in (("east", east), ("north", north), ("up", up)) if g is not None}
    shape = next(iter(given.values())).shape
    kn, ke = np.meshgrid(2 * np.pi * np.fft.fftfreq(shape[0], dy), 2 * np.pi * np.fft.fftfreq(shape[1], dx), indexing="ij")
    operator = {"east": 1j * ke, "north": 1j * kn, "up": -np.hypot(ke, kn)}
    w = {n: (weights or {}).get(n, 1.0) for n in given}
    top = sum(w[n] * np.conj(operator[n]) * np.fft.fft2(g) for n, g in given.items())
    bottom = sum(w[n] * np.abs(operator[n]) ** 2 for n in given)
    shown = bottom > 0
    for axis, n in enumerate(shape):
        if n % 2 == 0:
            np.moveaxis(shown, axis, 0)[n // 2] = False
    spectrum = np.where(shown, top / np.where(shown, bottom + damping**2, 1), 0)
    spectrum[0, 0] = mean * spectrum.size
    return np.fft.ifft2(spectrum).real


# profiles


def euler_profile(x: np.ndarray, z: np.ndarray, field: np.ndarray, gx: np.ndarray, gz: np.ndarray, index: float, window: int = 15, stride: int = 1, max_condition: float = 1e6) -> list[tuple[int, float, float, float]]:
    """(start, x, z, condition) of the window from each ``stride``-th sample: position and background by least squares in
    (x - x0) gx + (z - z0) gz + N (f - b) = 0 with centred, scaled unknowns. z is up."""
    out = []
    for i in range(0, len(x) - window + 1, stride):
        s = slice(i, i + window)
        if not all(np.isfinite(v[s]).all() for v in (x, z, field, gx, gz)):
            continue
        cx, cz, cf = x[s].mean(), z[s].mean(), field[s].mean()
        a = np.column_stack([gx[s], gz[s], np.full(window, index if index else 1.0)])
        scale = np.linalg.norm(a, axis=0)
        if (scale == 0).any():
            continue
        u, sv, v = np.linalg.svd(a / scale, full_matrices=False)
        if sv[-1] * max_condition < sv[0]:
            continue
        p = v.T @ (u.T @ ((x[s] - cx) * gx[s] + (z[s] - cz) * gz[s] + index * (field[s] - cf)) / sv) / scale
        out.append((i, cx + p[0], cz + p[1], sv[0] / sv[-1]))
    return out


# skeletons


def thinned(mask: np.ndarray) -> np.ndarray:
    """The skeleton of a mask: border cells go in turns of two directions while that keeps what is connected connected."""
    m = np.pad(np.asarray(mask, bool), 1)
    while True:
        before = m.sum()
        for turn in (0, 1):
            around = [np.roll(np.roll(m, -dr, 0), -dc, 1) for dr, dc in ((-1, 0), (-1, 1), (0, 1), (1, 1), (1, 0), (1, -1), (0, -1), (-1, -1))]
            n = sum(a.astype(int) for a in around)
            rises = sum((~a & b).astype(int) for a, b in zip(around, [*around[1:], around[0]]))
            north, east, south, west = around[0], around[2], around[4], around[6]
            free = ~(north & east & south) & ~(east & south & west) if turn == 0 else ~(north & east & west) & ~(north & south & west)
            m = m & ~(m & (n >= 2) & (n <= 6) & (rises == 1) & free)
            m[[0, -1]] = False
            m[:, [0, -1]] = False
        if m.sum() == before:
            return m[1:-1, 1:-1]


def skeleton_paths(mask: np.ndarray, dx: float, dy: float, x0: float = 0.0, y0: float = 0.0, min_length: float = 0.0) -> list[tuple[np.ndarray, float, bool]]:
    """(points, length, closed) of the lines of a mask's skeleton, from end or fork to end or fork; loops without either are closed."""
    cells = {tuple(map(int, p)) for p in np.argwhere(thinned(mask))}

    def near(p: tuple[int, int]) -> list[tuple[int, int]]:
        side = [(p[0] + a, p[1] + b) for a, b in ((0, 1), (1, 0), (0, -1), (-1, 0)) if (p[0] + a, p[1] + b) in cells]
        # a diagonal counts where no side cell makes the same step
        return side + [(p[0] + a, p[1] + b) for a in (-1, 1) for b in (-1, 1) if (p[0] + a, p[1] + b) in cells and (p[0] + a, p[1]) not in cells and (p[0], p[1] + b) not in cells]

    links = {p: near(p) for p in cells}
    knots = {p for p, n in links.items() if len(n) != 2}
    used: set[frozenset] = set()
    paths: list[list[tuple[int, int]]] = []

    def walk(p: tuple[int, int], q: tuple[int, int], stop: set) -> list[tuple[int, int]]:
        path = [p, q]
        used.add(frozenset((p, q)))
        while path[-1] not in stop:
            on = [n for n in links[path[-1]] if frozenset((path[-1], n)) not in used]
            if not on:
                break
            used.add(frozenset((path[-1], on[0])))
            path.append(on[0])
        return path

    for start in (sorted(knots), sorted(cells - knots)):
        for p in start:
            for q in links[p]:
                if frozenset((p, q)) not in used:
                    paths.append(walk(p, q, knots or {p}) if p in knots else walk(p, q, {p}))
    out = []
    for path in paths:
        points = np.array([(x0 + c * dx, y0 + r * dy) for r, c in path])
        length = float(np.hypot(*np.diff(points, axis=0).T).sum())
        if length >= min_length:
            out.append((points, length, path[0] == path[-1]))
    return out


# the main field


def main_field(coefficients: Sequence[tuple[int, int, float, float]], longitude: np.ndarray, latitude: np.ndarray, height_km: np.ndarray, radius_km: float = 6371.2) -> np.ndarray:
    """Field (nT, east north up) of spherical harmonic coefficients (n, m, g, h; Schmidt semi-normalised), at geodetic degrees and
    heights on WGS84. The coefficients (of a model and date) are the caller's."""
    a, f = 6378.137, 1 / 298.257223563
    phi, lam = np.radians(latitude), np.radians(longitude)
    e2 = f * (2 - f)
    n_ = a / np.sqrt(1 - e2 * np.sin(phi) ** 2)
    rho, z = (n_ + height_km) * np.cos(phi), (n_ * (1 - e2) + height_km) * np.sin(phi)
    r = np.hypot(rho, z)
    theta = np.arctan2(rho, z)  # colatitude
    c, s = np.cos(theta), np.maximum(np.sin(theta), 1e-10)
    top = max((n for n, *_ in coefficients), default=0)
    p, d = {(0, 0): np.ones_like(c)}, {(0, 0): np.zeros_like(c)}
    for n in range(1, top + 1):
        for m in range(n + 1):
            if m == n:
                k = math.sqrt(1 - 1 / (2 * n)) if n > 1 else 1.0
                p[n, m] = k * s * p[n - 1, n - 1]
                d[n, m] = k * (s * d[n - 1, n - 1] + c * p[n - 1, n - 1])
            else:
                root = math.sqrt(n * n - m * m)
                before = (math.sqrt((n - 1) ** 2 - m * m) / root, p.get((n - 2, m), 0.0), d.get((n - 2, m), 0.0)) if n - 2 >= m else (0.0, 0.0, 0.0)
                k = (2 * n - 1) / root
                p[n, m] = k * c * p[n - 1, m] - before[0] * before[1]
                d[n, m] = k * (c * d[n - 1, m] - s * p[n - 1, m]) - before[0] * before[2]
    radial, south, east = np.zeros_like(r), np.zeros_like(r), np.zeros_like(r)
    for n, m, g, h in coefficients:
        fall = (radius_km / r) ** (n + 2)
        wave, turn = g * np.cos(m * lam) + h * np.sin(m * lam), -g * np.sin(m * lam) + h * np.cos(m * lam)
        radial += (n + 1) * fall * wave * p[n, m]
        south -= fall * wave * d[n, m]
        east -= fall * m * turn * p[n, m] / s
    tilt = phi - (math.pi / 2 - theta)  # of the ellipsoid's normal against the radius
    return np.stack([east, -south * np.cos(tilt) - radial * np.sin(tilt), radial * np.cos(tilt) - south * np.sin(tilt)], axis=-1)
