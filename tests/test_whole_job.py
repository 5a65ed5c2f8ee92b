"""Queries cover all of their input: no row, channel or window is left out."""

import os

import numpy as np
import pandas as pd

from strataline.operators import fields as P, grids as G, kernels as K
from strataline.queries import QUERIES


def _part(folder, rows):
    i = np.arange(1, rows + 1)
    pd.DataFrame({"p_partkey": i, "p_retailprice": 900 + np.sin(i / 7.0) * 50 + i % 13, "p_size": (i % 50).astype("int32")}).to_parquet(os.path.join(folder, "part.parquet"))
    return str(folder)


def test_every_point_is_continued(spark, tmp_path):
    got = QUERIES["equivalent_source_continuation"](spark, _part(tmp_path, 1000)).toPandas()
    assert sorted(got["id"]) == list(range(1, 1001)) and got["continued"].notna().all()


def test_tiles_follow_the_solve_of_all_points(spark):
    i = np.arange(1, 801)
    p = pd.DataFrame({"id": i, "x": i % 211 * 3.0 - 100, "y": i % 157 * 4.0 - 100, "v": i % 31 * 1.0})
    p = pd.concat([p, p[:50].assign(id=i[:50] + 800, v=p["v"][:50] + 8)])  # some places twice
    xy = p[["x", "y"]].to_numpy()
    k = 1 / np.sqrt(((xy[:, None] - xy[None]) ** 2).sum(axis=2) + 1600)
    up = 1 / np.sqrt(((xy[:, None] - xy[None]) ** 2).sum(axis=2) + 65**2)
    v = p["v"].to_numpy()
    whole = up @ np.linalg.solve(k @ k + 1e-3 * np.trace(k @ k) / len(p) * np.eye(len(p)), k @ (v - v.mean())) + v.mean()
    df = spark.createDataFrame(p)
    far = P.equivalent_source_tiles(df, "id", "x", "y", "v", 40.0, 25.0, tile=80, halo=1000, cell=20, reach=1000).toPandas().sort_values("id")["continued"]
    near = P.equivalent_source_tiles(df, "id", "x", "y", "v", 40.0, 25.0, tile=80, halo=60, cell=20, reach=400).toPandas().sort_values("id")["continued"]
    assert len(far) == len(near) == 850
    assert np.sqrt(np.mean((far - whole) ** 2)) < 0.02 * whole.std()
    assert np.sqrt(np.mean((near - whole) ** 2)) < 0.15 * whole.std()


def test_euler_has_a_window_about_every_cell(spark):
    r, c = (a.ravel() for a in np.mgrid[0:13, 0:40])
    rng = np.random.default_rng(3)
    cells = pd.DataFrame({"grid": 0, "r": r.astype("int32"), "c": c.astype("int32"), **{n: rng.normal(size=len(r)) for n in ("z", "gx", "gy", "gz")}})
    cells.loc[cells.index % 17 == 5, "z"] = np.nan
    got = G.euler_solutions(spark.createDataFrame(cells), 25.0, 20.0, 1.0).toPandas()
    want = {}
    for i, j in zip(r, c):
        w = cells[(abs(cells["r"] - i) <= 4) & (abs(cells["c"] - j) <= 4)].dropna()
        if s := K.euler_window(w["c"].to_numpy() * 25.0, w["r"].to_numpy() * 20.0, np.zeros(len(w)), *(w[n].to_numpy() for n in ("z", "gx", "gy", "gz")), 1.0):
            want[i, j] = (len(w), *s)
    assert len(got) == len(want) == 13 * 40
    for row in got.itertuples():
        assert np.allclose((row.samples, row.x, row.y, row.depth, row.condition), want[row.r, row.c], rtol=1e-6, atol=1e-6)
    assert len(G.euler_solutions(spark.createDataFrame(cells), 25.0, 20.0, 1.0, stride=4).toPandas()) == 4 * 10


def test_werner_tries_every_window(spark, tmp_path):
    x, f = np.arange(200) * 10.0, np.random.default_rng(3).normal(size=200)
    want = [w for i in range(194) if (w := K.werner_window(x[i : i + 7], f[i : i + 7]))]
    pd.DataFrame({"event_id": np.arange(200), "user_id": 1, "ts": (pd.Timestamp("2024-01-01") + pd.to_timedelta(np.arange(200), "s")).astype("datetime64[us]"), "event_type": "view", "value": f}).to_parquet(tmp_path / "events.parquet")
    got = QUERIES["werner_profile"](spark, str(tmp_path)).toPandas()
    assert len(got) == len(want) > len(K.werner_profile(x, f, stride=3))
    assert np.allclose(sorted(got["position"]), sorted(p for p, _ in want), atol=1e-5)


def _embeddings(folder, values, label):
    pd.DataFrame({"vec_id": np.arange(len(values)), "embedding": list(values.astype("float32")), "label": label}).to_parquet(os.path.join(folder, "embeddings.parquet"))
    return str(folder)


def test_every_spectrum_is_fitted(spark, tmp_path):
    got = QUERIES["cole_cole_fit"](spark, _embeddings(tmp_path, np.random.default_rng(1).normal(size=(40, 64)), np.arange(40) % 10)).toPandas()
    assert sorted(got["vec_id"]) == list(range(40))
    assert (abs(got["rho0"] - 100) < 5).all() and (abs(got["m"] - 0.3) < 0.05).all() and (got["rms"] < 0.1).all()


def test_noise_modes_have_all_channels(spark, tmp_path):
    a = np.abs(np.random.default_rng(2).normal(size=(130, 64))).astype("float32")
    label = np.array([0] * 100 + [1] * 28 + [2] * 2)
    got = QUERIES["mnf_denoise"](spark, _embeddings(tmp_path, a, label)).toPandas().set_index("vec_id")["kept"]
    assert sorted(got.index) == list(range(130))
    for k in (0, 1):
        own = a[label == k].astype(float)
        noise = np.cov(np.diff(own, axis=0).T) / 2
        noise = (noise if k == 0 else np.diag(np.diag(noise))) + np.eye(64) * 1e-6
        assert np.allclose(got[label == k], K.mnf(own, noise, 5).sum(axis=1), atol=1e-5)
    assert np.allclose(got[128:], a[128:].sum(axis=1), atol=1e-4)


def test_directional_bins_tell_directions_apart():
    rows, cols = np.mgrid[0:64, 0:64]
    z = np.sin(2 * np.pi * (cols + rows) / 8)
    bins = lambda *a: G.radial_spectrum(z, 25.0, 25.0, 10, *a)
    along, back, across = bins(45.0), bins(225.0), bins(135.0)
    assert along["power"].max() > 1000 * across["power"].max() and along.equals(back)
    assert np.isclose((bins(0.0, 90.0)["power"] * bins()["n"]).sum(), (bins()["power"] * bins()["n"]).sum())
    assert along["n"].sum() < bins()["n"].sum()


def test_a_text_stays_whose_id_has_another_text_with_an_earlier_copy(spark):
    from strataline.llm import near_dup

    word = lambda k: " ".join(f"w{k}x{i}" for i in range(60))
    rows = [(1, word(1)), (5, word(1)), (5, word(2)), (5, word(2)), (7, word(3)), (9, word(2)), (None, word(1))]
    kept = near_dup.deduplicate(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(map(tuple, kept), key=repr) == sorted([(1, word(1)), (5, word(2)), (7, word(3)), (None, word(1))], key=repr)
