"""Models against closed forms, dense algebra and plain loops."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from strataline.functions.projection import TransverseMercator, reproject
from strataline.operators import models as M


def test_resolution_spread_and_probes():
    r = np.random.default_rng(1)
    g = r.normal(size=(30, 8))
    gram, prior = g.T @ g, np.vstack([np.diff(np.eye(8), axis=0), 0.3 * np.eye(8)])
    cov, res = M.posterior(gram, prior, 2.0)
    assert np.allclose(cov @ (gram + 2 * prior.T @ prior), np.eye(8), atol=1e-9) and np.allclose(res, cov @ gram)
    apply = (lambda v: gram @ v, lambda v: 2 * prior.T @ (prior @ v))
    c, q = M.point_spread(*apply, 8, [0, 5])
    assert np.allclose(c, cov[:, [0, 5]], atol=1e-8) and np.allclose(q, res[:, [0, 5]], atol=1e-7)
    dc, dr, trace = M.stochastic_resolution(*apply, 8, 4000, 3)
    assert np.allclose(dc, np.diag(cov), atol=0.05 * np.diag(cov).max()) and abs(trace - np.trace(res)) < 0.2
    draws = M.ensemble(cov, np.arange(8.0), 20000, 5)
    assert np.allclose(draws.mean(axis=0), np.arange(8), atol=0.05) and np.allclose(np.cov(draws.T), cov, atol=0.05 * np.abs(cov).max())


def test_gram_is_one_aggregation(spark):
    r = np.random.default_rng(2)
    a, d, sd = r.normal(size=(50, 3)), r.normal(size=50), r.uniform(0.5, 2, 50)
    df = spark.createDataFrame([(*map(float, x), float(y), float(s)) for x, y, s in zip(a, d, sd)], "p double, q double, r double, d double, sd double")
    gram, right = M.weighted_gram(df, ["p", "q", "r"], "sd", "d")
    assert np.allclose(gram, a.T @ (a / sd[:, None] ** 2)) and np.allclose(right, a.T @ (d / sd**2))
    x, cov = M.fit_rows(df, ["p", "q", "r"], "d", "sd")
    assert np.allclose(x, np.linalg.lstsq(a / sd[:, None], d / sd, rcond=None)[0]) and np.allclose(cov, np.linalg.inv(gram))


def test_paired_radon_is_the_dense_gaussian():
    r = np.random.default_rng(3)
    n, alpha, beta, gamma, rough = 12, 0.5, 0.1, 0.9, 0.7
    t, down, up = np.cumsum(r.uniform(0.5, 2, n)), r.normal(10, 2, n), r.normal(4, 1, n)
    sd, su, cov = r.uniform(0.5, 1, n), r.uniform(0.3, 0.8, n), 0.05
    got = M.paired_radon(t, down, up, sd, su, alpha=alpha, beta=beta, gamma=gamma, roughness=rough, covariance=cov)
    precision, right = np.zeros((2 * n, 2 * n)), np.zeros(2 * n)
    for i in range(n):
        w = np.linalg.inv([[sd[i] ** 2, cov], [cov, su[i] ** 2]])
        a = np.array([[1, alpha], [beta, gamma]])
        at = [i, n + i]
        precision[np.ix_(at, at)] += a.T @ w @ a
        right[at] += a.T @ w @ [down[i], up[i]]
    for i in range(n - 1):
        k = rough / (t[i + 1] - t[i])
        precision[np.ix_([n + i, n + i + 1], [n + i, n + i + 1])] += k * np.array([[1, -1], [-1, 1]])
    full = np.linalg.inv(precision)
    x = full @ right
    assert np.allclose(got["ground"], x[:n]) and np.allclose(got["radon"], x[n:])
    assert np.allclose(got["ground_variance"], np.diag(full)[:n]) and np.allclose(got["radon_variance"], np.diag(full)[n:])


def test_full_spectrum_radon():
    r = np.random.default_rng(4)
    a, truth = r.uniform(0.1, 1, (20, 3)), r.uniform(1, 5, (6, 3))
    x, left = M.full_spectrum_radon(truth @ a.T, a, r.uniform(0.5, 2, (6, 20)), 2)
    assert np.allclose(x, truth) and np.allclose(left, truth[:, :2] @ a[:, :2].T)


def test_a_dipole_is_found():
    at = np.array([[x, y, 0.3 * math.sin(x)] for x in np.linspace(-3, 3, 6) for y in np.linspace(-3, 3, 6)])
    where, moment = np.array([0.7, -0.4, -1.6]), np.array([0.2, -0.5, 1.3])
    field = M.dipole_field(at, where, moment)
    p, m, rms = M.fit_dipole(at, field, [0, 0, -2.5], [-3, -3, -5], [3, 3, -0.5])
    assert np.allclose(p, where, atol=1e-4) and np.allclose(m, moment, atol=1e-3) and rms < 1e-3
    d = np.array([0.3, 0.5, -0.81])
    p, m, _ = M.fit_dipole(at, field @ d, [0, 0, -2.5], [-3, -3, -5], [3, 3, -0.5], d)
    assert np.allclose(p, where, atol=1e-3)


def test_prisms_far_away_are_points_and_their_gradients_are_harmonic(spark):
    at = [(40.0, -30.0, 50.0), (-60.0, 10.0, -45.0), (5.0, 80.0, 1.0)]
    bounds = [F.lit(v) for v in (-1.0, 1.0, -1.5, 1.5, -0.5, 0.5)]
    df = spark.createDataFrame(at, "x double, y double, z double")
    t = M.prism_tensor(F.col("x"), F.col("y"), F.col("z"), bounds, F.lit(1000.0))
    b = M.prism_magnetic(M.prism_tensor(F.col("x"), F.col("y"), F.col("z"), bounds, F.lit(1.0)), (0.3, -1.0, 2.0))
    for p, r in zip(at, df.select(*[v.alias(n) for n, v in t.items()], *[v.alias(n) for n, v in zip(("be", "bn", "bu"), b)]).collect()):
        d = np.array(p)
        n = np.linalg.norm(d)
        want = M.G_SI * 1000 * 6 * 1e9 * (3 * np.outer(d, d) / n**5 - np.eye(3) / n**3)
        got = np.array([[r["ee"], r["en"], r["eu"]], [r["en"], r["nn"], r["nu"]], [r["eu"], r["nu"], r["uu"]]])
        assert np.allclose(got, want, rtol=2e-2, atol=2e-3 * np.abs(want).max()) and abs(np.trace(got)) < 1e-6 * np.abs(got).max()
        far = M.dipole_field(np.array([p]), np.zeros(3), 6 * np.array([0.3, -1.0, 2.0]))[0]
        assert np.allclose([r["be"], r["bn"], r["bu"]], far, atol=2e-3 * np.abs(far).max())


def test_hyperbola_thickness_and_gradients():
    x = np.linspace(-2, 3, 20)
    p, chi = M.fit_hyperbola(x, np.sqrt(9 + 4 * (x - 0.4) ** 2 / 0.6**2), 0.1, (0, 2, 0.4), (0.1, 2))
    assert np.allclose(p, [0.4, 3, 0.6], atol=1e-4) and chi < 1e-6
    r = np.random.default_rng(5)
    load = r.normal(size=(16, 20)) * 1e6
    k = np.hypot(*np.meshgrid(2 * np.pi * np.fft.fftfreq(16, 2000.0), 2 * np.pi * np.fft.fftfreq(20, 2000.0), indexing="ij"))
    rigid = 1e11 * 3000.0**3 / (12 * (1 - 0.25**2))
    w = np.fft.ifft2(np.fft.fft2(load) / (rigid * k**4 + 630 * 9.80665)).real
    chi = M.thickness_scan(load, w, np.ones(w.shape), 2000.0, 2000.0, [1000.0, 3000.0, 9000.0])
    assert chi.argmin() == 1 and chi[1] < 1e-12
    spectrum = np.fft.fft2(r.normal(size=(15, 17)))
    kn, ke = np.meshgrid(2 * np.pi * np.fft.fftfreq(15, 3.0), 2 * np.pi * np.fft.fftfreq(17, 2.0), indexing="ij")
    field = np.fft.ifft2(spectrum).real
    east, north, up = (np.fft.ifft2(spectrum * o).real for o in (1j * ke, 1j * kn, -np.hypot(ke, kn)))
    assert np.allclose(M.field_from_gradients(2.0, 3.0, field.mean(), east=east, north=north, up=up), field)
    assert np.allclose(M.field_from_gradients(2.0, 3.0, field.mean(), up=up, weights={"up": 3.0}), field)


def test_euler_profile_finds_a_line_mass():
    x = np.arange(0, 600, 10.0)
    dx, dz = x - 270.0, 80.0  # z up: the source is at -80
    f = dz / (dx**2 + dz**2)
    gx, gz = -2 * dx * dz / (dx**2 + dz**2) ** 2, (dx**2 - dz**2) / (dx**2 + dz**2) ** 2
    found = M.euler_profile(x, np.zeros(len(x)), f + 3, gx, gz, 1.0)
    assert len(found) == len(x) - 14 and all(abs(px - 270) < 1e-5 and abs(pz + 80) < 1e-5 for _, px, pz, _ in found)


def test_skeletons():
    m = np.zeros((20, 30), bool)
    m[9:12, 3:27] = True
    paths = M.skeleton_paths(m, 2.0, 2.0)
    assert len(paths) == 1 and 36 <= paths[0][1] <= 48 and not paths[0][2]
    m[2:18, 14:17] = True
    assert len(M.skeleton_paths(m, 2.0, 2.0, min_length=6.0)) == 4
    ring = np.zeros((15, 15), bool)
    ring[3:12, 3:12] = True
    ring[5:10, 5:10] = False
    loop = M.skeleton_paths(ring, 1.0, 1.0)
    assert len(loop) == 1 and loop[0][2]
    assert M.skeleton_paths(np.zeros((4, 4), bool), 1.0, 1.0) == []


def test_transverse_mercator(spark):
    """The meridian arc by quadrature, the scale on the meridian, zone edges and the way back."""
    a, f = 6378137.0, 1 / 298.257223563
    e2 = f * (2 - f)
    utm = TransverseMercator.utm(31)
    lat = [0.0, 10.0, 45.0, 80.0]
    df = spark.createDataFrame([(3.0, v) for v in lat] + [(6.0, 52.0), (0.1, -33.0), (None, 1.0), (3.0, 95.0)], "lon double, lat double")
    got = utm.inverse(utm.forward(df, "lon", "lat", ("e", "n")), "e", "n", ("lon2", "lat2")).collect()
    for r, v in zip(got, lat):
        t = (np.arange(20000) + 0.5) / 20000 * math.radians(v)
        arc = (a * (1 - e2) / (1 - e2 * np.sin(t) ** 2) ** 1.5).mean() * math.radians(v) if v else 0.0
        assert abs(r["e"] - 500000) < 1e-6 and abs(r["n"] - 0.9996 * arc) < 1e-3
    for r in got[:6]:
        assert abs(r["lon2"] - r["lon"]) < 1e-11 and abs(r["lat2"] - r["lat"]) < 1e-11
    assert got[6]["e"] is None and got[6]["n"] is None and got[7]["e"] is None
    # a short step east at 52 north is as long as on the ellipsoid, times the projection's scale there
    near = utm.forward(spark.createDataFrame([(6.0, 52.0), (6.00001, 52.0)], "lon double, lat double"), "lon", "lat", ("e", "n")).collect()
    step = math.hypot(near[1]["e"] - near[0]["e"], near[1]["n"] - near[0]["n"])
    ground = a / math.sqrt(1 - e2 * math.sin(math.radians(52)) ** 2) * math.cos(math.radians(52)) * math.radians(1e-5)
    x = near[0]["e"] - 500000
    assert abs(step / ground - 0.9996 * (1 + x * x / (2 * 6.383e6**2 * 0.9996**2))) < 1e-6
    south = TransverseMercator.utm(19, south=True)
    back = reproject(spark.createDataFrame([(166_000.0, 1_100_000.0)], "x double, y double"), "x", "y", south, south, ("x", "y")).first()
    assert abs(back["x"] - 166_000) < 1e-6 and abs(back["y"] - 1_100_000) < 1e-6


def test_main_field_is_a_gradient():
    """A centred dipole in closed form, and the potential of other coefficients by differences."""
    lat, lon, h = np.array([0.0, 0.0, 30.0]), np.array([0.0, 90.0, 40.0]), np.array([0.0, 10.0, 200.0])
    b = M.main_field([(1, 0, -30000.0, 0.0)], lon, lat, h)
    assert np.allclose(b[:2, 1], 30000 * (6371.2 / (6378.137 + h[:2])) ** 3) and np.allclose(b[:2, [0, 2]], 0, atol=1e-9)

    def potential(xyz, coefficients, a=6371.2):
        r = np.linalg.norm(xyz)
        c, s, lam = xyz[2] / r, math.hypot(xyz[0], xyz[1]) / r, math.atan2(xyz[1], xyz[0])
        schmidt = {(1, 0): c, (1, 1): s, (2, 0): 1.5 * c * c - 0.5, (2, 1): math.sqrt(3) * c * s, (2, 2): math.sqrt(3) / 2 * s * s, (3, 0): c * (5 * c * c - 3) / 2, (3, 2): math.sqrt(15) / 2 * c * s * s, (3, 3): math.sqrt(10) / 4 * s**3}
        return a * sum((a / r) ** (n + 1) * (g * math.cos(m * lam) + k * math.sin(m * lam)) * schmidt[n, m] for n, m, g, k in coefficients)

    terms = [(1, 0, -29000.0, 0), (1, 1, -1500.0, 4600.0), (2, 0, -2400.0, 0), (2, 1, 3000.0, -2800.0), (2, 2, 1600.0, -700.0), (3, 0, 1300.0, 0), (3, 2, 1200.0, 240.0), (3, 3, 500.0, -540.0)]
    got = M.main_field(terms, lon, lat, h)
    for k in range(3):
        phi, lam = math.radians(lat[k]), math.radians(lon[k])
        e2 = (2 - 1 / 298.257223563) / 298.257223563
        big = 6378.137 / math.sqrt(1 - e2 * math.sin(phi) ** 2)
        at = np.array([(big + h[k]) * math.cos(phi) * math.cos(lam), (big + h[k]) * math.cos(phi) * math.sin(lam), (big * (1 - e2) + h[k]) * math.sin(phi)])
        frame = np.array([[-math.sin(lam), math.cos(lam), 0], [-math.sin(phi) * math.cos(lam), -math.sin(phi) * math.sin(lam), math.cos(phi)], [math.cos(phi) * math.cos(lam), math.cos(phi) * math.sin(lam), math.sin(phi)]])
        want = [-(potential(at + u * 0.01, terms) - potential(at - u * 0.01, terms)) / 0.02 for u in frame]
        assert np.allclose(got[k], want, atol=1e-3), k


def test_unclear_models_are_refused():
    with pytest.raises(ValueError):
        M.window_radon([F.lit(1.0)] * 4, np.ones((4, 4)))
    with pytest.raises(ValueError):
        M.paired_radon(np.arange(3.0), np.ones(3), np.ones(3), np.ones(3), np.ones(3), alpha=1, beta=0.9, gamma=0.9, roughness=0)
    with pytest.raises(np.linalg.LinAlgError):
        M.posterior(np.zeros((2, 2)), np.array([[1.0, -1.0]]), 1.0)
