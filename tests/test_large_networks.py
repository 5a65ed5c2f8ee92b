"""Networks with more nodes than the driver solves at once."""

import numpy as np
import pandas as pd
import pytest

from strataline.operators import solve
from strataline.queries import QUERIES


def _plain(rows, anchors):
    """The dense least squares of all nodes; a component without an anchor is taken to mean 0."""
    names = sorted({n for a, b, _, _ in rows for n in (a, b)})
    at = {n: i for i, n in enumerate(names)}
    m, v, linked = np.zeros((len(names), len(names))), np.zeros(len(names)), np.eye(len(names))
    for a, b, d, w in rows:
        i, j = at[a], at[b]
        for p, q, sign in ((i, j, 1), (j, i, -1)):
            m[p, p] += w
            m[p, q] -= w
            v[p] += sign * w * d
            linked[p, q] = 1
    known = [at[n] for n in anchors if n in at]
    free = [i for i in range(len(names)) if i not in known]
    x = np.zeros(len(names))
    x[known] = [anchors[n] for n in anchors if n in at]
    x[free] = np.linalg.lstsq(m[np.ix_(free, free)], v[free] - m[np.ix_(free, known)] @ x[known], rcond=None)[0]
    reach = np.linalg.matrix_power(linked, len(names)) > 0
    for i in free:
        own = np.flatnonzero(reach[i])
        if not set(own) & set(known):
            x[own] -= x[own].mean()
    return dict(zip(names, x))


@pytest.mark.parametrize("turned", [False, True])
@pytest.mark.parametrize("anchors", [{}, {"b1": 3.0}, {"a2": -1.0, "b0": 4.0}, {"a0": 1.0, "z1": 2.0, "none": 5.0}])
def test_network_equals_the_dense_solution(spark, turned, anchors):
    rng = np.random.default_rng(5)
    rows = [(f"a{rng.integers(20)}", f"b{rng.integers(4)}", float(rng.normal()), float(rng.integers(1, 4))) for _ in range(60)]
    rows += [("b0", "b1", 2.0, 1.0), ("b2", "b2", 1.0, 1.0), ("a3", "a4", 1.5, 2.0), ("y1", "z1", 1.0, 1.0), ("y2", "z1", 4.0, 2.0)]
    if turned:
        rows = [(b, a, -d, w) for a, b, d, w in rows]
    got = solve.network(spark.createDataFrame(rows, "a string, b string, d double, w double"), "a", "b", "d", "w", anchors).collect()
    want = _plain(rows, anchors)
    assert len(got) == len(want)
    assert {r["node"]: r["value"] for r in got} == pytest.approx(want, abs=1e-9)


def test_network_of_many_stations(spark):
    e = spark.range(12000).selectExpr("concat('s', id div 2) a", "concat('b', (id + id div 2) % 3) b", "double(id div 2 - (id + id div 2) % 3) d")
    got = {r["node"]: r["value"] for r in solve.network(e, "a", "b", "d", None, {"b0": 10.0}).collect()}
    assert len(got) == 6002 > solve.MAX_UNKNOWNS
    assert max(abs(x - 10 - int(n[1:])) for n, x in got.items()) < 1e-8


def test_levelling_of_many_lines(spark):
    c = spark.range(48000).selectExpr("concat('L', id div 8) a", "concat('T', id % 8) b", "double((id div 8) % 5 - id % 8) r")
    got = {r["line"]: r["correction"] for r in solve.line_corrections(c, "a", "b", "r").collect()}
    assert len(got) == 6008 > solve.MAX_UNKNOWNS
    assert abs(sum(got.values())) < 1e-6
    assert max(abs((k // 8) % 5 - k % 8 + got[f"L{k // 8}"] - got[f"T{k % 8}"]) for k in range(48000)) < 1e-8


@pytest.mark.parametrize("odd", [np.inf, -np.inf, np.nan, None])
@pytest.mark.parametrize("every", [19, 2])
def test_levelling_beside_crossings_without_a_finite_residual(spark, odd, every):
    """They don't count, be they few among equal residuals or half of all."""
    rows = [(f"L{k // 6}", f"T{k % 6}", 3.0) for k in range(60)]
    plain = solve.line_corrections(spark.createDataFrame(rows, "a string, b string, r double"), "a", "b", "r").collect()
    mixed = rows + [(f"L{k // 6}", f"T{k % 6}", odd) for k in range(60) if k % every == 0]
    got = solve.line_corrections(spark.createDataFrame(mixed, "a string, b string, r double"), "a", "b", "r").collect()
    assert {r["line"]: r["correction"] for r in got} == pytest.approx({r["line"]: r["correction"] for r in plain}, abs=1e-9)


def test_levelling_query_of_many_lines(spark, tmp_path):
    """6,000 suppliers against seven ties, with a few wild crossings that don't count."""
    k = np.arange(48000)
    line, tie, wild = k // 8, k % 8 % 7, k % 1009 == 5
    residual = np.where(wild, 1e4, line % 5 - tie)
    pd.DataFrame({"l_orderkey": k, "l_suppkey": line, "l_partkey": k % 8, "l_quantity": residual + 25.0}).to_parquet(tmp_path / "lineitem.parquet")
    got = {r["line"]: r["correction"] for r in QUERIES["line_leveling_solution"](spark, str(tmp_path)).collect()}
    assert len(got) == 6007 > solve.MAX_UNKNOWNS
    assert abs(np.mean(list(got.values()))) < 1e-6
    assert max(abs(residual[i] + got[str(line[i])] - got[f"t{tie[i]}"]) for i in k[~wild]) < 2e-6
