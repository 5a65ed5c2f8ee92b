"""Closed forms of survey geophysics as Spark expressions, one row at a time.

Units are those of the parameter names; a missing input gives a missing result.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, functions as F

from .numbers import finite, is_finite, ratio

# GRS80 normal gravity (equator in mGal, Somigliana's k, first eccentricity squared).
GRS80_EQUATOR, GRS80_K, GRS80_E2 = 978032.67715, 0.00193185138639, 0.00669438002290
# earth's rotation (rad/s), mean radius (m), magnetic constant (SI), dose coefficients for K, eU, eTh.
EARTH_ROTATION, EARTH_RADIUS, MU_0 = 7.2921150e-5, 6371008.8, 4e-7 * math.pi
DOSE = (13.078, 5.675, 2.494)


def _rad(x: Column) -> Column:
    return F.radians(x)


# gravity


def normal_gravity(latitude: Column, equator: float = GRS80_EQUATOR, k: float = GRS80_K, e2: float = GRS80_E2) -> Column:
    """Somigliana's formula, mGal; null beyond the poles."""
    s = F.pow(F.sin(_rad(latitude)), F.lit(2.0))
    return F.when(F.abs(latitude) <= 90, equator * (k * s + 1) / F.sqrt(1 - e2 * s))


def free_air_correction(height: Column, gradient: float = 0.3086) -> Column:
    return height * gradient


def slab_effect(height: Column, density: float = 2670.0, coefficient: float = 0.0419) -> Column:
    """Infinite plate; ``coefficient`` is mGal / (g/cm3 m)."""
    return height * (coefficient * density / 1000)


def plate_effect(height: Column, land: float = 2670.0, sea: float = 1640.0) -> Column:
    """2 pi G rho h in mGal; below 0 with the density contrast of the sea."""
    two_pi_g = 2 * math.pi * 6.67430e-11 * 1e5
    return height * F.when(height < 0, two_pi_g * sea).otherwise(two_pi_g * land)


def curvature_b(height: Column, density: float = 2670.0) -> Column:
    """Bullard B of a spherical cap, mGal; 0 below 0."""
    h = F.greatest(height, F.lit(0.0))
    return (h * 1.4633e-3 - F.pow(h, F.lit(2.0)) * 3.533e-7 + F.pow(h, F.lit(3.0)) * 4.5e-14) * (density / 2670.0)


def free_air_anomaly(observed: Column, latitude: Column, height: Column) -> Column:
    return observed - normal_gravity(latitude) + free_air_correction(height)


def simple_bouguer(observed: Column, latitude: Column, height: Column, effect: Column) -> Column:
    return free_air_anomaly(observed, latitude, height) - effect


def complete_bouguer(observed: Column, latitude: Column, height: Column, effect: Column, terrain: Column) -> Column:
    return simple_bouguer(observed, latitude, height, effect) + terrain - curvature_b(height)


def airy_root(height: Column, crust: float = 2670.0, mantle: float = 3070.0) -> Column:
    if mantle <= crust:
        raise ValueError("the mantle is denser than the crust")
    return height * (crust / (mantle - crust))


def airy_moho(height: Column, depth: float = 25000.0, crust: float = 2670.0, mantle: float = 3070.0) -> Column:
    return airy_root(height, crust, mantle) + depth


def eotvos(latitude: Column, east: Column, north: Column, radius: float = EARTH_RADIUS) -> Column:
    """mGal for velocities in m/s."""
    return (east * F.cos(_rad(latitude)) * (2 * EARTH_ROTATION) + (F.pow(east, F.lit(2.0)) + F.pow(north, F.lit(2.0))) / radius) * 1e5


def drift(seconds: Column, start: Column, per_hour: float) -> Column:
    return (seconds - start) * per_hour / 3600.0


# directions and magnetics


def azimuth(east: Column, north: Column) -> Column:
    """Degrees clockwise from north, 0 to 360."""
    return F.pmod(F.degrees(F.atan2(east, north)), F.lit(360.0))


def angle_between(first: Column, second: Column) -> Column:
    """Signed, -180 to 180 degrees."""
    return F.pmod(first - second + 180.0, F.lit(360.0)) - 180.0


def heading_correction(degrees: Column, cosine: float = 0.0, sine: float = 0.0) -> Column:
    return F.cos(_rad(degrees)) * cosine + F.sin(_rad(degrees)) * sine


def true_velocity(east: Column, north: Column, convergence: float) -> tuple[Column, Column]:
    c, s = math.cos(math.radians(convergence)), math.sin(math.radians(convergence))
    return east * c - north * s, east * s + north * c


def magnetic_elements(east: Column, north: Column, up: Column) -> dict[str, Column]:
    flat = F.hypot(east, north)
    return {
        "total": F.sqrt(east * east + north * north + up * up),
        "horizontal": flat,
        "declination": F.degrees(F.atan2(east, north)),
        "inclination": F.degrees(F.atan2(-up, flat)),
    }


def tensor_invariants(xx: Column, xy: Column, xz: Column, yy: Column, yz: Column, zz: Column) -> dict[str, Column]:
    """Of a symmetric gradient tensor."""
    return {
        "i1": xx + yy + zz,
        "i2": xx * yy + yy * zz + zz * xx - xy * xy - yz * yz - xz * xz,
        "i3": xx * (yy * zz - yz * yz) - xy * (xy * zz - yz * xz) + xz * (xy * yz - yy * xz),
    }


def rotated_tensor(t: Sequence[Column], r: Sequence[Sequence[float]]) -> dict[str, Column]:
    """R T R' of a symmetric tensor (xx, xy, xz, yy, yz, zz)."""
    full = [[t[0], t[1], t[2]], [t[1], t[3], t[4]], [t[2], t[4], t[5]]]
    names = ("xx", "xy", "xz", "yy", "yz", "zz")
    out = {}
    for name, (i, j) in zip(names, ((0, 0), (0, 1), (0, 2), (1, 1), (1, 2), (2, 2))):
        total = None
        for a in range(3):
            for b in range(3):
                if weight := r[i][a] * r[j][b]:
                    total = full[a][b] * weight if total is None else total + full[a][b] * weight
        out[name] = total if total is not None else F.lit(0.0)
    return out


# gamma-ray spectrometry


def live_time(rate: Column, live_ms: Column, interval_ms: float = 1000.0) -> Column:
    return F.when((live_ms > 0) & (live_ms <= interval_ms) & is_finite(rate), F.try_divide(rate * interval_ms, live_ms))


def dead_time(rate: Column, seconds: float) -> Column:
    """Non-paralyzable; a rate that would need a denominator of 0 or less fails the query."""
    d = 1 - rate * seconds
    return F.when(d <= 0, F.raise_error(F.lit("dead time too long for this rate")).cast("double")).otherwise(F.try_divide(rate, d))


def background(rate: Column, *parts: Column) -> Column:
    for p in parts:
        rate = rate - p
    return rate


def height_attenuation(rate: Column, height: Column, reference: float, coefficient: float) -> Column:
    return rate * F.exp((height - reference) * coefficient)


def sensitivity(rate: Column, per_unit: float, offset: float = 0.0) -> Column:
    if not per_unit > 0:
        raise ValueError("a sensitivity is positive")
    return (rate - offset) / per_unit


def dose_rate(k: Column, u: Column, th: Column, coefficients: tuple[float, float, float] = DOSE) -> Column:
    return k * coefficients[0] + u * coefficients[1] + th * coefficients[2]


def f_parameter(k: Column, u: Column, th: Column, minimum: float = 0.0) -> Column:
    return ratio(k * u, th, minimum)


def linear_map(columns: Sequence[Column], matrix: Sequence[Sequence[float]]) -> list[Column]:
    """matrix times columns."""
    return [sum((c * float(m) for c, m in zip(columns[1:], row[1:])), columns[0] * float(row[0])) for row in matrix]


def unmix(columns: Sequence[Column], response: Sequence[Sequence[float]], max_condition: float = 1e10) -> list[Column]:
    """Solves the window response for the true rates (the inverse is taken once, on the driver)."""
    import numpy as np

    m = np.asarray(response, float)
    if not np.isfinite(m).all() or np.linalg.cond(m) > max_condition:
        raise ValueError("the window response is singular or ill-conditioned")
    return [F.when(_all_finite(columns), x) for x in linear_map(columns, np.linalg.inv(m).tolist())]


def _all_finite(columns: Sequence[Column]) -> Column:
    out = is_finite(columns[0])
    for c in columns[1:]:
        out = out & is_finite(c)
    return out


# electrics


def geometric_factor(am: Column, bm: Column, an: Column, bn: Column, space: str = "half") -> Column:
    """From the distances of current electrodes A, B and potential electrodes M, N; a
    null distance is a remote electrode. Null where the terms cancel."""
    if space not in ("half", "full"):
        raise ValueError("half or full")
    terms = [F.coalesce(F.try_divide(F.lit(1.0), d), F.lit(0.0)) for d in (am, bm, an, bn)]
    total = terms[0] - terms[1] - terms[2] + terms[3]
    scale = terms[0] + terms[1] + terms[2] + terms[3]
    return F.when(F.abs(total) > scale * 1e-12, F.try_divide(F.lit((2 if space == "half" else 4) * math.pi), total))


def apparent_resistivity(factor: Column, volts: Column, amperes: Column) -> Column:
    return factor * F.try_divide(volts, amperes)


def cole_cole(frequency: Column, rho0: float, m: float, tau: float, c: float) -> tuple[Column, Column]:
    """Real and imaginary part of Pelton's resistivity, exp(+i w t)."""
    x = F.pow(frequency * (2 * math.pi * tau), F.lit(c))
    re, im = x * math.cos(c * math.pi / 2) + 1, x * math.sin(c * math.pi / 2)
    size = re * re + im * im
    return (re / size * m + (1 - m)) * rho0, im / size * (-m * rho0)


def mt_resistivity(frequency: Column, re: Column, im: Column) -> Column:
    return (re * re + im * im) / (frequency * (2 * math.pi * MU_0))


def mt_phase(re: Column, im: Column) -> Column:
    """Degrees; null for a zero impedance."""
    return F.when((re != 0) | (im != 0), F.degrees(F.atan2(im, re)))


def mt_units(value: Column) -> Column:
    """(mV/km)/nT to ohms."""
    return value * (1000 * MU_0)


def phase_tensor(x: Sequence[Column], y: Sequence[Column]) -> list[Column]:
    """Real(Z)^-1 Imag(Z) for Z = x + i y, both (xx, xy, yx, yy); null for a singular real part."""
    det = x[0] * x[3] - x[1] * x[2]
    over = lambda v: F.try_divide(v, det)
    return [over(x[3] * y[0] - x[1] * y[2]), over(x[3] * y[1] - x[1] * y[3]), over(x[0] * y[2] - x[2] * y[0]), over(x[0] * y[3] - x[2] * y[1])]


# Fourier-domain responses of a radial wavenumber (rad/m)


def _cutoff(wavelength: float) -> float:
    if wavelength <= 0:
        raise ValueError("a wavelength is positive")
    return 2 * math.pi / wavelength


def butterworth_low(k: Column, wavelength: float, order: int) -> Column:
    return 1 / F.sqrt(F.pow(k / _cutoff(wavelength), F.lit(2.0 * order)) + 1)


def butterworth_high(k: Column, wavelength: float, order: int) -> Column:
    return F.when(k > 0, 1 / F.sqrt(F.pow(F.try_divide(F.lit(_cutoff(wavelength)), k), F.lit(2.0 * order)) + 1)).when(k <= 0, 0.0)


def ideal_band(k: Column, long: float, short: float) -> Column:
    return F.when((k >= _cutoff(long)) & (k <= _cutoff(short)), 1.0).when(k.isNotNull(), 0.0)


def cosine_rolloff(k: Column, long: float, short: float, degree: int) -> Column:
    a, b = _cutoff(long), _cutoff(short)
    return F.when(k <= a, 1.0).when(k >= b, 0.0).otherwise(F.pow(F.cos((k - a) * (math.pi / 2 / (b - a))), F.lit(float(degree))))


def directional_cosine(east: Column, north: Column, azimuth_degrees: float, degree: int) -> Column:
    normal = math.radians(azimuth_degrees % 180) + math.pi / 2
    return F.when((east == 0) & (north == 0), 1.0).otherwise(F.pow(F.abs(F.cos(F.atan2(east, north) - normal)), F.lit(float(degree))))


def upward(k: Column, height: float) -> Column:
    return F.exp(k * -height)


def downward(k: Column, height: float, wavelength: float, order: int, max_gain: float) -> Column:
    return F.exp(F.least(k * height, F.lit(math.log(max_gain)))) * butterworth_low(k, wavelength, order)


def vertical_integration(k: Column) -> Column:
    return F.when(k > 0, F.try_divide(F.lit(1.0), k)).when(k <= 0, 0.0)


def gaussian_low(k: Column, wavelength: float) -> Column:
    """The gain at the cutoff is exp(-1/2)."""
    return F.exp(F.pow(k / _cutoff(wavelength), F.lit(2.0)) * -0.5)


def wiener_inverse(re: Column, im: Column, signal: Column, noise: Column) -> tuple[Column, Column]:
    """conj(H) S / (|H|^2 S + N)."""
    bottom = (re * re + im * im) * signal + noise
    return finite(F.try_divide(re * signal, bottom)), finite(F.try_divide(-im * signal, bottom))


def time_gain(value: Column, seconds: Column, start: float, power: float, rate: float, limit: float) -> Column:
    return value * F.least(F.pow(seconds / start + 1, F.lit(power)) * F.exp(seconds * rate), F.lit(limit))
