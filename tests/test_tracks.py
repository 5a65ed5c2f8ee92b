"""Tracks, tiles and windows against plain Python and small cases with known answers."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from strataline.operators import grids as G, tracks as T


def test_tiles_keep_every_cell(spark):
    cells = spark.createDataFrame([(r, c, float(r * 10 + c)) for r in range(-3, 3) for c in range(-3, 3)], "r int, c int, z double")
    core = G.tiles(cells, 4, 1).where("core")
    assert core.count() == 36 and core.select("r", "c").distinct().count() == 36
    lone = spark.createDataFrame([(0, 0, 1.0)], "r int, c int, z double")
    assert [(t["tile_r"], t["tile_c"]) for t in G.tiles(lone, 4, 2).collect()] == [(0, 0)]


@pytest.mark.parametrize("transfers", [[G.continuation(40.0)], [G.gaussian(60.0, high=True)], [G.butterworth(60.0, 4)]])
def test_a_filter_by_tiles_is_the_whole_grids_filter(spark, transfers):
    """Inside, up to the share of the response beyond the halo."""
    r = np.random.default_rng(1)
    z = r.normal(size=(96, 96))
    z = z + np.roll(z, 1, 0) + np.roll(z, 1, 1)
    cells = spark.createDataFrame([(0, int(i) - 20, int(j) - 20, float(z[i, j])) for i, j in np.ndindex(z.shape)], "grid int, r int, c int, z double")
    whole = {(x["r"], x["c"]): x["filtered"] for x in G.fft_filter(cells, transfers, 10.0, 10.0, tile=512).collect()}
    df = G.fft_filter(cells, transfers, 10.0, 10.0, tile=32, halo=32)
    tiled = {(x["r"], x["c"]): x["filtered"] for x in df.collect()}
    assert tiled.keys() == whole.keys() and len(tiled) == 96 * 96
    inner = [k for k in whole if 10 <= k[0] < 45 and 10 <= k[1] < 45]
    size = np.std([whole[k] for k in inner])
    assert max(abs(tiled[k] - whole[k]) for k in inner) < 0.12 * size
    assert np.sqrt(np.mean([(tiled[k] - whole[k]) ** 2 for k in inner])) < 0.03 * size


def test_minimum_curvature_by_tiles_honours_nodes(spark):
    nodes = [(int(i), int(j), math.sin(i / 9) + math.cos(j / 7)) for i in range(0, 60, 4) for j in range(0, 60, 4)]
    out = {(x["r"], x["c"]): x["z"] for x in G.minimum_curvature_tiles(spark.createDataFrame(nodes, "r int, c int, z double"), tile=20, halo=12).collect()}
    assert len(out) == 57 * 57 and all(abs(out[i, j] - z) < 1e-6 for i, j, z in nodes)
    assert max(abs(out[i, j] - math.sin(i / 9) - math.cos(j / 7)) for i in range(8, 50) for j in range(8, 50)) < 0.05


def test_filter_gains_of_missing_wavenumbers_are_missing(spark):
    from strataline.functions import geophysics as g

    k = F.col("k")
    df = spark.createDataFrame([(None,), (0.0,), (0.02,)], "k double").select(g.butterworth_high(k, 100.0, 2), g.ideal_band(k, 400.0, 100.0), g.vertical_integration(k))
    rows = [tuple(r) for r in df.collect()]
    assert rows[0] == (None, None, None) and rows[1] == (0.0, 0.0, 0.0) and rows[2][1:] == (1.0, 50.0)


def test_crossovers_of_random_tracks(spark):
    """Every proper crossing once, with distances and values, against all pairs."""
    r = random.Random(2)
    rows = []
    for line in range(6):
        x, y = r.uniform(-200, 0), r.uniform(-200, 200)
        for k in range(40):
            rows.append((line * 100 + k, line, x, y, float(r.randrange(100))))
            x, y = x + r.uniform(-3, 15), y + r.uniform(-20, 20)
    rows.append((950, 2, None, 5.0, 1.0))
    df = spark.createDataFrame(rows, "row_id long, line int, x double, y double, v double")
    s = T.segments(df, "line", "x", "y", "v")
    got = sorted((x["traverse"], x["tie"], round(x["x"], 6), round(x["y"], 6), round(x["residual"], 6), round(x["traverse_distance"], 5)) for x in T.crossovers(s.where("line < 3"), s.where("line >= 3"), 25.0).collect())
    tracks = {k: [p for p in rows if p[1] == k and p[2] is not None] for k in range(6)}
    want = []
    for a in range(3):
        for b in range(3, 6):
            sa = 0.0
            for p, q in zip(tracks[a], tracks[a][1:]):
                la = math.dist(p[2:4], q[2:4])
                for u, w in zip(tracks[b], tracks[b][1:]):
                    m = np.array([[q[2] - p[2], -(w[2] - u[2])], [q[3] - p[3], -(w[3] - u[3])]])
                    if abs(np.linalg.det(m)) > 1e-12:
                        t, v = np.linalg.solve(m, [u[2] - p[2], u[3] - p[3]])
                        if 0 <= t < 1 and 0 <= v < 1:
                            want.append((a, b, round(p[2] + t * (q[2] - p[2]), 6), round(p[3] + t * (q[3] - p[3]), 6), round(p[4] + t * (q[4] - p[4]) - u[4] - v * (w[4] - u[4]), 6), round(sa + t * la, 5)))
                sa += la
    assert got == sorted(want) and len(want) > 10


def test_levelling_on_found_crossovers(spark):
    """Constant line errors are found from computed crossings and taken off."""
    from strataline.operators import solve as S

    rows = []
    shift = {0: 5.0, 1: -3.0, 2: 1.0, 10: -2.0, 11: -1.0}
    for line in range(3):
        rows += [(line * 100 + k, line, k * 10.0, line * 50.0, shift[line]) for k in range(20)]
    for line in (10, 11):
        rows += [(line * 100 + k, line, (line - 9) * 60.0 + 3, k * 12.0 - 21, shift[line]) for k in range(20)]
    df = spark.createDataFrame(rows, "row_id long, line int, x double, y double, v double")
    s = T.segments(df, "line", "x", "y", "v")
    x = T.crossovers(s.where("line < 10"), s.where("line >= 10"), 40.0)
    assert x.count() == 6
    out = T.leveled(df, S.line_corrections(x, "traverse", "tie", "residual", sigmas=50.0), "line", "v")
    assert out.agg(F.max("leveled") - F.min("leveled")).first()[0] < 1e-9


def test_polygon_boundary_and_nulls(spark):
    ring = [(0.0, 0.0), (10.0, 0.0), (10.0, 10.0), (5.0, 5.0), (0.0, 10.0)]
    points = [(5.0, 4.0, True), (5.0, 6.0, False), (0.0, 5.0, True), (10.0, 10.0, True), (5.0, 5.0, True), (5.0, 0.0, True), (-1.0, 0.0, False), (2.5, 7.5, True), (None, 1.0, False), (11.0, 0.0, False)]
    got = spark.createDataFrame(points, "x double, y double, want boolean").select("want", T.inside_polygon(F.col("x"), F.col("y"), ring).alias("got")).collect()
    assert all(g["want"] == g["got"] for g in got)


def test_ids_and_dummies(spark):
    df = spark.createDataFrame([("2.0", 1.0), (" 2 ", 2.0), ("3", -99.9), ("2.5", float("nan")), (None, 5.0)], "s string, v double")
    out = T.exclude_sensors(T.without_dummies(df, ["v"], [-99.9], 1e-6), "s", [2], ["v"]).collect()
    assert [r["v"] for r in out] == [None, None, None, None, 5.0] and [r["s"] for r in out] == ["2.0", " 2 ", "3", "2.5", None]
    assert T.accepted([("a", [1, 2, 3]), ("b", [1]), ("a", [3, 2, 9])]) == {"a": [2, 3], "b": [1]}
