import math

import numpy as np
import pytest

from strataline.operators import grids as G, kernels as K


def test_butterworth_separates_and_gains_at_the_cutoff():
    n = np.arange(2000)
    low, high = np.sin(2 * np.pi * 0.01 * n), np.sin(2 * np.pi * 0.2 * n)
    out = K.zero_phase(K.butterworth_sections(4, 0.05), low + high)
    assert np.sqrt(np.mean((out - low)[200:-200] ** 2)) < 0.01
    for order in (1, 2, 5):
        s = K.butterworth_sections(order, 0.1)
        z = np.exp(-2j * np.pi * 0.1)
        gain = np.prod([abs((b0 + b1 * z + b2 * z * z) / (1 + a1 * z + a2 * z * z)) for b0, b1, b2, _, a1, a2 in s])
        assert abs(gain - math.sqrt(0.5)) < 1e-12
    tone = np.sin(2 * np.pi * 0.1 * n)
    assert np.abs(K.zero_phase(K.notch_section(0.1, 5), tone)[300:-300]).max() < 1e-3
    assert np.isnan(K.zero_phase(K.butterworth_sections(4, 0.1), np.ones(5))).all()


def test_welch_finds_a_tone_and_its_power():
    x = 3 * np.sin(2 * np.pi * 0.125 * np.arange(4096))
    f, p = K.welch(x, 1.0, 256)
    assert f[np.argmax(p)] == 0.125 and abs(np.sum(p) * f[1] - 4.5) < 0.05
    f, a, c = K.admittance(x, 2 * x, 1.0, 256)
    assert abs(a[32] - 2) < 1e-9 and abs(c[32] - 1) < 1e-9


def test_least_squares():
    r = np.random.default_rng(1)
    a = np.abs(r.normal(size=(30, 4)))
    x = np.array([1.0, 0, 2.0, 0])
    assert np.allclose(K.nnls(a, a @ x), x, atol=1e-8)
    assert (K.nnls(a, -a @ x) == 0).all()
    e, cov, chi = K.gls(a, a @ x, np.eye(30))
    assert np.allclose(e, x) and chi < 1e-18 and cov.shape == (4, 4)
    with pytest.raises(ValueError):
        K.gls(np.ones((5, 2)), np.ones(5), np.eye(5))
    counts = np.outer(np.arange(1, 20), np.exp(-np.arange(16) / 5)) * 100
    assert np.allclose(K.nasvd(counts, 1), counts)
    data = np.outer(r.normal(size=200), np.arange(1, 6)) * 10 + r.normal(size=(200, 5))
    assert np.std(K.mnf(data, np.eye(5), 5) - data) < 1e-8


def test_interpolators():
    r = np.random.default_rng(2)
    xy = r.random((40, 2)) * 100
    z = 3 + 2 * xy[:, 0] - xy[:, 1]
    at = r.random((5, 2)) * 100
    assert np.allclose(K.thin_plate(xy, z, at), 3 + 2 * at[:, 0] - at[:, 1], atol=1e-6)
    assert np.allclose(K.thin_plate(xy, np.sin(xy[:, 0] / 20), xy[:5]), np.sin(xy[:5, 0] / 20), atol=1e-6)
    assert K.ordinary_kriging(xy, z, xy[3], 1.0, 50.0) == (pytest.approx(z[3]), 0.0)
    assert math.isnan(K.ordinary_kriging(xy[:2], z[:2], at[0], 1.0, 50.0)[0])
    e, v = K.ordinary_kriging(xy, np.full(40, 7.0), at[0], 1.0, 50.0)
    assert abs(e - 7) < 1e-9 and v > 0
    rr, cc = np.array([0, 0, 20, 20, 9]), np.array([0, 30, 0, 30, 14])
    grid, _ = K.minimum_curvature(rr, cc, 5 + 0.5 * rr - 0.25 * cc, (21, 31))
    want = 5 + 0.5 * np.arange(21)[:, None] - 0.25 * np.arange(31)
    assert np.abs(grid - want).max() < 1e-6
    s = np.sin(np.arange(60) / 5)
    assert np.abs(K.lanczos(s, np.arange(10, 50, 0.5)) - np.sin(np.arange(10, 50, 0.5) / 5)).max() < 5e-3


def test_spectral_filters_on_a_wave():
    x = np.arange(96) * 2.0
    wave = np.cos(2 * np.pi * x / 48)[None, :] * np.ones((90, 1))
    k = 2 * np.pi / 48
    mid = np.s_[30:60, 30:66]
    got = G.spectral_filter(wave, 2.0, 2.0, [G.derivative("east")], detrend=-1)
    assert np.abs(got - -k * np.sin(2 * np.pi * x / 48))[mid].max() < 0.02 * k
    up = G.spectral_filter(wave, 2.0, 2.0, [G.continuation(10.0)], detrend=-1)
    assert np.abs(up - math.exp(-10 * k) * wave)[mid].max() < 0.02
    half = G.spectral_filter(wave, 2.0, 2.0, [G.butterworth(48.0, 2)], detrend=-1)
    assert np.abs(half - math.sqrt(0.5) * wave)[mid].max() < 0.05
    both = G.spectral_filter(wave, 2.0, 2.0, [G.continuation(4.0), G.continuation(6.0)], detrend=-1)
    assert np.allclose(both, up)
    plane = np.add.outer(np.arange(20.0), 2 * np.arange(30.0))
    assert np.allclose(G.spectral_filter(plane, 1.0, 1.0, [G.gaussian(50.0)]), plane)
    holed = wave.copy()
    holed[5, 5] = np.nan
    assert np.isnan(G.spectral_filter(holed, 2.0, 2.0, [G.gaussian(50.0)])[5, 5])


def test_directions():
    ke, kn = np.meshgrid(np.linspace(-1, 1, 9), np.linspace(-1, 1, 9))
    k = np.hypot(ke, kn)
    same = G.field_transform((60.0, 10.0), (60.0, 10.0))(ke, kn, k)
    assert np.allclose(same[k > 0], 1)
    pole = G.field_transform((90.0, 0.0))(ke, kn, k)
    assert np.allclose(pole[k > 0], 1)


def test_euler_finds_a_point_source():
    y, x = np.mgrid[0:9, 0:9] * 10.0
    sx, sy, depth = 37.0, 52.0, 25.0
    r = np.sqrt((x - sx) ** 2 + (y - sy) ** 2 + depth**2)
    f = 1 / r**2  # of degree -2
    gx, gy, gz = -2 * (x - sx) / r**4, -2 * (y - sy) / r**4, 2 * -depth / r**4 * -1
    got = K.euler_window(x.ravel(), y.ravel(), np.zeros(81), f.ravel(), gx.ravel(), gy.ravel(), gz.ravel(), 2.0)
    assert np.allclose(got[:3], (sx, sy, depth), atol=0.5) or np.allclose(got[:3], (sx, sy, -depth), atol=30)


def test_polygon_is_a_cylinder_far_away():
    a = np.linspace(0, 2 * np.pi, 181)[:-1]
    ring = np.column_stack([20 * np.cos(a), 100 + 20 * np.sin(a)])
    for s in (ring, ring[::-1]):
        got = K.polygon_gravity(np.array([[0.0, 0.0], [80.0, 0.0]]), s, 500.0)
        want = [2 * np.pi * 6.6743e-11 * 1e5 * 500 * 400 * 100 / (d * d + 1e4) for d in (0.0, 80.0)]
        assert np.allclose(got, want, rtol=1e-3)


def test_impedance_and_fit():
    f = np.logspace(-2, 3, 10)
    z = K.layered_impedance(f, [100.0, 100.0], [500.0])
    assert np.allclose(np.abs(z) ** 2 / (2 * np.pi * f * 4e-7 * np.pi), 100) and np.allclose(np.angle(z, deg=True), 45)
    x, rms = K.fit_bounded(lambda p: p[0] * np.exp(-p[1] * f), 3 * np.exp(-0.5 * f), np.array([1.0, 1.0]), np.array([0.0, 0.0]), np.array([10.0, 5.0]))
    assert np.allclose(x, (3, 0.5), atol=1e-4) and rms < 1e-6
    got = K.werner_window(np.arange(-50.0, 60, 10), 100 * (2 * (np.arange(-50.0, 60, 10) - 12) + 3 * 40) / ((np.arange(-50.0, 60, 10) - 12) ** 2 + 40**2))
    assert got is None or abs(got[1]) < 200


def test_directional_derivative_of_a_wave():
    y, x = np.mgrid[0:64, 0:64] * 10.0
    ke, kn = 2 * np.pi * 4 / 640, 2 * np.pi * 3 / 640
    z = np.sin(ke * x + kn * y)
    for azimuth in (0.0, 30.0, 90.0, 215.0):
        a = np.radians(azimuth)
        got = G.spectral_filter(z, 10.0, 10.0, [G.directional_derivative(azimuth)], detrend=-1, pad=0.25)
        want = (ke * np.sin(a) + kn * np.cos(a)) * np.cos(ke * x + kn * y)
        inner = (slice(16, 48), slice(16, 48))
        assert np.abs(got - want)[inner].max() < 0.15 * np.hypot(ke, kn)


def test_sections_by_spans_are_the_recursion():
    """Against the plain recursion, sample by sample, around the length of a span."""
    r = np.random.default_rng(8)
    for sections in (K.butterworth_sections(5, 0.07), K.notch_section(0.2, 9.0), K.butterworth_sections(4, 0.01, high=True)):
        for n in (1, 2, 63, 64, 65, 500):
            x = r.normal(size=n).cumsum() + 50
            want, level = x.copy(), x[0]
            for b0, b1, b2, _, a1, a2 in sections:
                gain = (b0 + b1 + b2) / (1 + a1 + a2)
                v1 = v2 = level  # inputs and outputs before the first sample, in the steady state
                o1 = o2 = level * gain
                out = []
                for v in want:
                    o = b0 * v + b1 * v1 + b2 * v2 - a1 * o1 - a2 * o2
                    v2, v1, o2, o1 = v1, v, o1, o
                    out.append(o)
                want, level = np.array(out), level * gain
            assert np.allclose(K._run_sections(sections, x), want, rtol=1e-9, atol=1e-8)


def test_denoising_by_moments_is_the_dense_kernels(spark, monkeypatch):
    """Groups dealt over tasks and blocks of ids, a null group, a group below the channels and one of two rows."""
    from strataline.operators import spectra as X

    monkeypatch.setattr(X, "ID_BLOCK", 37)
    r = np.random.default_rng(9)
    group = [None if k % 5 == 4 else "ab"[k % 2] for k in range(400)] + ["small"] * 6 + ["two"] * 2
    x = np.abs(r.normal(size=(408, 8)) + 3 * np.sin(np.arange(8)) * r.normal(size=(408, 1))) * 10
    ids = r.permutation(408) * 3
    df = spark.createDataFrame([(int(i), g, v.tolist()) for i, g, v in zip(ids, group, x)], "id long, g string, v array<double>").repartition(7)
    some = df.where("g is null or g not in ('two')")
    for got, dense in ((X.mnf(df, "id", "g", "v", 3), None), (X.nasvd(some, "id", "g", "v", 3), K.nasvd)):
        rows = {q["id"]: q["rebuilt"] for q in got.collect()}
        for name in (None, "a", "b", "small", "two"):
            at = [k for k in range(408) if group[k] == name]
            at.sort(key=lambda k: ids[k])
            own = x[at]
            if dense is None:
                want = own if len(own) < 3 else K.mnf(own, K.difference_noise(own), 3)
            elif name == "two":
                continue
            else:
                want = dense(own, 3)
            assert np.allclose([rows[int(ids[k])] for k in at], want, atol=1e-6), (name, dense)
