"""Small global problems: Spark sums the normal equations, the driver solves them.

Unknowns that meet no other of their kind (the lines that cross ties, outlying stations) are taken out by sums in Spark;
the number of the others is checked before anything is collected.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import DataFrame, functions as F

from ..functions.numbers import is_finite
from .stats import components, robust_keep

MAX_UNKNOWNS = 5000


def _names(df: DataFrame) -> list[str]:
    found = [r[0] for r in df.where("name is not null").distinct().orderBy("name").limit(MAX_UNKNOWNS + 1).collect()]
    if len(found) > MAX_UNKNOWNS:
        raise ValueError(f"more than {MAX_UNKNOWNS} unknowns")
    return found


def _solved(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The solution of a symmetric system; the shortest one where it is singular (separate networks)."""
    try:
        x = np.linalg.solve(a, b)
        if np.allclose(a @ x, b, rtol=1e-9, atol=1e-9 * max(1.0, np.abs(b).max())) and np.abs(x).max() < 1e9 * max(1.0, np.abs(b).max()):
            return x
    except np.linalg.LinAlgError:
        pass
    return np.linalg.lstsq(a, b, rcond=None)[0]


def _islands(linked: np.ndarray) -> np.ndarray:
    """The least index of each node's component."""
    out = np.full(len(linked), -1)
    for start in range(len(linked)):
        if out[start] < 0:
            new = np.zeros(len(linked), bool)
            new[start] = True
            while new.any():
                out[new] = start
                new = linked[new].any(axis=0) & (out < 0)
    return out


def _network(edges: DataFrame, anchors: dict[str, float]) -> DataFrame:
    """(node, value) from edges (i, j, w, d): least squares of sum w (value[i] - value[j] - d / w)^2. Nodes of one side only (of the side
    that has more of them) have no edges among themselves, so each is a weighted mean of its neighbours plus a constant and is taken out by
    sums over its pairs of neighbours. The driver solves for the others, whose number is checked; any number of nodes can be taken out."""
    spark = edges.sparkSession
    edges = edges.where("i is not null and j is not null").groupBy("i", "j").agg(F.sum("w").cast("double").alias("w"), F.sum("d").cast("double").alias("d"))
    edges = edges.checkpoint() if spark.sparkContext._jsc.sc().getCheckpointDir().isDefined() else edges.persist()  # read several times below
    ends = edges.select(F.col("i").alias("name"), F.lit(1).alias("left")).union(edges.select("j", F.lit(0)))
    sides = ends.groupBy("name").agg(F.max("left").alias("left"), F.min("left").alias("only"))
    n = sides.agg(F.count_if(F.col("only") == 1).alias("left"), F.count_if(F.col("left") == 0).alias("right")).first()
    one = "only = 1" if n["left"] >= n["right"] else "left = 0"
    fixed = F.col("name").isin(list(anchors))
    rest, out = sides.where(~F.expr(one) | fixed).select("name"), sides.where(F.expr(one) & ~fixed).select("name")
    names = _names(rest)
    at = {x: k for k, x in enumerate(names)}
    if n["left"] < n["right"]:  # nodes taken out are in i below
        edges = edges.select(F.col("j").alias("i"), F.col("i").alias("j"), "w", (-F.col("d")).alias("d"))
    m, v, linked = np.zeros((len(names), len(names))), np.zeros(len(names)), np.eye(len(names), dtype=bool)
    inner = edges.join(out.withColumnRenamed("name", "i"), "i", "left_anti")
    for r in inner.toLocalIterator():
        i, j = at[r["i"]], at[r["j"]]
        m[i, i] += r["w"]
        m[j, j] += r["w"]
        m[i, j] -= r["w"]
        m[j, i] -= r["w"]
        v[i] += r["d"]
        v[j] -= r["d"]
        linked[i, j] = linked[j, i] = True
    # value[i] = (sum of d + sum of w value[j]) / sum of w for a node taken out, put into the others' equations
    star = edges.join(out.withColumnRenamed("name", "i"), "i")
    whole = star.groupBy("i").agg(F.sum("w").alias("ws"), F.sum("d").alias("ds"))
    star = star.join(whole, "i")
    alone = star.groupBy("j").agg(F.sum(F.col("w") * F.coalesce(F.try_divide("ds", "ws"), F.lit(0.0)) - F.col("d")).alias("v"))
    for r in alone.toLocalIterator():
        v[at[r["j"]]] += r["v"]
    other = star.select("i", F.col("j").alias("k"), F.col("w").alias("wk"))
    pairs = star.join(other, "i").where("j < k").groupBy("j", "k").agg(F.sum(F.coalesce(F.try_divide(F.col("w") * F.col("wk"), F.col("ws")), F.lit(0.0))).alias("w"))
    for r in pairs.toLocalIterator():
        j, k = at[r["j"]], at[r["k"]]
        m[j, j] += r["w"]
        m[k, k] += r["w"]
        m[j, k] -= r["w"]
        m[k, j] -= r["w"]
        linked[j, k] = linked[k, j] = True
    known = [at[x] for x in anchors if x in at]
    value = np.zeros(len(names))
    for x in anchors:
        if x in at:
            value[at[x]] = anchors[x]
    free = np.setdiff1d(np.arange(len(names)), known)
    island = _islands(linked)
    held = set(island[known].tolist())
    loose = ~np.isin(island, list(held))
    right = v - m[:, known] @ value[known]
    m += loose[:, None] & (island[:, None] == island[None, :])  # a component without an anchor has mean 0
    if len(free):
        value[free] = _solved(m[np.ix_(free, free)], right[free])
    solved = spark.createDataFrame([(x, float(value[k]), int(island[k]), int(island[k]) in held) for k, x in enumerate(names)], "node string, value double, island long, held boolean")
    means = star.join(F.broadcast(solved), star["j"] == solved["node"]).groupBy("i").agg(F.sum(F.col("d") + F.col("w") * F.col("value")).alias("s"), F.sum("w").alias("w"), F.first("island").alias("island"), F.first("held").alias("held"))
    taken = means.select(F.col("i").alias("node"), F.coalesce(F.try_divide("s", "w"), F.lit(0.0)).alias("value"), "island", "held")
    every = solved.unionByName(taken)
    middle = every.where("not held").groupBy("island").agg(F.avg("value").alias("mean"))
    return every.join(F.broadcast(middle), "island", "left").select("node", (F.col("value") - F.coalesce("mean", F.lit(0.0))).alias("value"))


def line_corrections(crossings: DataFrame, traverse: str, tie: str, residual: str, sigmas: float = 4.5) -> DataFrame:
    """(line, correction): constants that take the accepted residuals down in the least squares, with mean 0
    over the lines of each network, from crossings with a finite residual. Lines are taken out of the equations by sums, those of the side
    that has more."""
    kept = robust_keep(crossings.where(is_finite(F.col(residual))), residual, sigmas).where("accepted")
    edges = kept.select(F.col(traverse).cast("string").alias("i"), F.col(tie).cast("string").alias("j"), F.lit(1.0).alias("w"), (-F.col(residual)).alias("d"))
    return _network(edges, {}).select(F.col("node").alias("line"), F.col("value").alias("correction"))


def polynomial_corrections(crossings: DataFrame, line: str, position: str, residual: str, order: int) -> DataFrame:
    """(line, c0, c1, c2): a polynomial of the position (-1 to 1) for each line, from sums of powers; the order
    falls to what the line's crossings determine."""
    powers = crossings.groupBy(line).agg(F.count("*").alias("n"), *[F.sum(F.pow(F.col(position), F.lit(float(k)))).alias(f"p{k}") for k in range(2 * order + 1)], *[F.sum(F.pow(F.col(position), F.lit(float(k))) * F.col(residual)).alias(f"r{k}") for k in range(order + 1)])
    kind = crossings.schema[line].dataType.simpleString()

    def fit(batches):
        for pdf in batches:
            out = []
            for row in pdf.itertuples(index=False):
                k = min(order, int(row.n) - 1)
                a = np.array([[getattr(row, f"p{i + j}") for j in range(k + 1)] for i in range(k + 1)])
                x = np.linalg.lstsq(a, np.array([getattr(row, f"r{i}") for i in range(k + 1)]), rcond=None)[0]
                out.append(np.append(-x, np.zeros(2 - k)))
            values = np.array(out).reshape(-1, 3)
            yield pdf[[line, "n"]].assign(c0=values[:, 0], c1=values[:, 1], c2=values[:, 2])

    return powers.mapInPandas(fit, f"{line} {kind}, n long, c0 double, c1 double, c2 double")


def network(edges: DataFrame, a: str, b: str, difference: str, weight: str | None, anchors: dict[str, float]) -> DataFrame:
    """(node, value) of differences value[a] - value[b] by weighted least squares with exact anchors. A
    component without an anchor gets mean 0."""
    w = F.col(weight) if weight else F.lit(1.0)
    return _network(edges.select(F.col(a).cast("string").alias("i"), F.col(b).cast("string").alias("j"), w.alias("w"), (w * F.col(difference)).alias("d")).where("d is not null"), anchors)


def least_squares(df: DataFrame, columns: Sequence[str], target: str, weight: str | None = None) -> dict[str, float]:
    """Weighted least squares with a constant, from one aggregation of products."""
    names = ["1", *columns]
    cols = [F.lit(1.0), *[F.col(c) for c in columns]]
    w = F.col(weight) if weight else F.lit(1.0)
    row = df.agg(*[F.sum(w * x * y).alias(f"a{i}_{j}") for i, x in enumerate(cols) for j, y in enumerate(cols) if j >= i], *[F.sum(w * x * F.col(target)).alias(f"b{i}") for i, x in enumerate(cols)]).first()
    a = np.array([[row[f"a{min(i, j)}_{max(i, j)}"] for j in range(len(cols))] for i in range(len(cols))], float)
    x = np.linalg.lstsq(a, np.array([row[f"b{i}"] for i in range(len(cols))], float), rcond=None)[0]
    return dict(zip(names, x.tolist()))


def compensation(df: DataFrame, vector: Sequence[str], total: str, keys: Sequence[str], ridge: float = 1e-3) -> DataFrame:
    """Tolles-Lawson compensation of the total field by the attitude: 18 terms of the unit vector and its steps,
    ridge regression on standardised terms, fitted and applied by line (needs 60 rows)."""
    from .kernels import by_group

    def kernel(pdf):
        v = pdf[list(vector)].to_numpy(float)
        size = np.linalg.norm(v, axis=1, keepdims=True)
        u = v / np.where(size > 0, size, 1)
        du = np.gradient(u, axis=0) if len(u) > 1 else np.zeros_like(u)
        scale = size / 50000
        terms = [u[:, i : i + 1] for i in range(3)]
        terms += [u[:, i : i + 1] * u[:, j : j + 1] * scale for i in range(3) for j in range(i, 3)]
        terms += [u[:, i : i + 1] * du[:, j : j + 1] * scale for i in range(3) for j in range(3)]
        a = np.hstack(terms)
        a = a - a.mean(axis=0)
        sd = np.where(a.std(axis=0) > 0, a.std(axis=0), 1)
        f = pdf[total].to_numpy(float)
        correction = np.zeros(len(f))
        if len(f) >= 60:
            s = a / sd
            correction = s @ np.linalg.solve(s.T @ s + ridge * len(f) * np.eye(s.shape[1]), s.T @ (f - f.mean()))
        return pdf.assign(compensated=f - correction)[[*keys, "row_id", "compensated"]]

    kinds = ", ".join(f"{k} {df.schema[k].dataType.simpleString()}" for k in keys)
    return by_group(df, list(keys), kernel, f"{kinds}, row_id long, compensated double")


def networks_of(edges: DataFrame, a: str, b: str) -> DataFrame:
    """Which component each node is in."""
    return components(edges, a, b)
