"""Denoising of spectra by groups from summed moments: no group is ever gathered in one task.

Tasks send a sum and a matrix of products per group; the driver gets one of each per group, at most
``MAX_GROUPS``, and the transforms it finds go back with the function that applies them batch by batch.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F

MAX_GROUPS = 500  # of 64 channels: 16 MB of matrices
ID_BLOCK = 1 << 16

Moments = dict[object, tuple[int, np.ndarray, np.ndarray]]  # group -> rows, sum, sum of products


def moments(df: DataFrame, group: str, vector: str, weigh: Callable[[np.ndarray], np.ndarray] | None = None) -> Moments:
    """Of the vectors of each group; ``weigh`` gives each row's weight in the products."""
    kind = df.schema[group].dataType.simpleString()

    def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[object, list] = {}
        for p in batches:
            for key, rows in p.groupby(group, dropna=False):
                x = np.stack(rows[vector].to_numpy()).astype(float)
                w = weigh(x) if weigh else np.ones(len(x))
                got = held.setdefault(None if pd.isna(key) else key, [0, 0.0, 0.0])
                got[0], got[1], got[2] = got[0] + len(x), got[1] + x.sum(axis=0), got[2] + (x * w[:, None]).T @ x
        if held:
            yield pd.DataFrame({group: list(held), "n": [v[0] for v in held.values()], "s": [v[1] for v in held.values()], "m": [v[2].ravel() for v in held.values()]})

    def total(p: pd.DataFrame) -> pd.DataFrame:
        p = p.sort_values("n", kind="stable")
        return pd.DataFrame({group: p[group].iloc[:1], "n": [p["n"].sum()], "s": [np.sum(p["s"].to_list(), axis=0)], "m": [np.sum(p["m"].to_list(), axis=0)]})

    schema = f"{group} {kind}, n long, s array<double>, m array<double>"
    rows = df.select(group, vector).mapInPandas(partial, schema).groupBy(group).applyInPandas(total, schema).limit(MAX_GROUPS + 1).collect()
    if len(rows) > MAX_GROUPS:
        raise ValueError(f"more than {MAX_GROUPS} groups")
    return {r[group]: (r["n"], np.array(r["s"]), np.array(r["m"]).reshape(len(r["s"]), -1)) for r in rows}


def _applied(df: DataFrame, key: str, group: str, vector: str, rebuilt: dict[object, Callable[[np.ndarray], np.ndarray]], into: str) -> DataFrame:
    kind = df.schema[key].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in batches:
            for g, rows in p.groupby(group, dropna=False):
                x = np.stack(rows[vector].to_numpy()).astype(float)
                yield pd.DataFrame({key: rows[key], vector: list(x), into: list(rebuilt[None if pd.isna(g) else g](x))})

    return df.select(key, group, vector).mapInPandas(run, f"{key} {kind}, {vector} array<double>, {into} array<double>")


def nasvd(df: DataFrame, key: str, group: str, vector: str, rank: int, into: str = "rebuilt") -> DataFrame:
    """(key, vector, rebuilt): spectra from the first components of their group after Poisson whitening. The products of the whitened
    spectra need each spectrum's total alone, so one pass finds the components."""

    def transform(n: int, s: np.ndarray, m: np.ndarray) -> Callable[[np.ndarray], np.ndarray]:
        mean = np.maximum(s / n, 1e-12)
        root = np.sqrt(mean)
        _, vectors = np.linalg.eigh(m * mean.sum() / np.outer(root, root))
        best = vectors[:, ::-1][:, :rank]
        return lambda x: x / root @ best @ best.T * root

    found = moments(df, group, vector, lambda x: 1 / np.maximum(x.sum(axis=1), 1e-300))
    return _applied(df, key, group, vector, {g: transform(*v) for g, v in found.items()}, into)


def differences(df: DataFrame, key: str, group: str, vector: str, into: str = "difference") -> DataFrame:
    """(group, difference) of spectra that follow each other by key in their group. Keys are ordered within blocks; the last of a
    block meets the first of the group's next block, which a table with a row per block knows."""
    blocks = df.select(group, key, vector, F.floor(F.col(key) / ID_BLOCK).alias("__block"))
    heads = blocks.groupBy(group, "__block").agg(F.min_by(vector, key).alias("head"))
    heads = heads.withColumn("after", F.lead("head").over(Window.partitionBy(group).orderBy("__block"))).select(F.col(group).alias("__group"), F.col("__block").alias("__b"), "after")
    nxt = F.lead(vector).over(Window.partitionBy(group, "__block").orderBy(key))
    rows = blocks.withColumn("__next", nxt).join(heads, F.col(group).eqNullSafe(F.col("__group")) & (F.col("__block") == F.col("__b")))
    after = F.coalesce("__next", "after")
    return rows.where(after.isNotNull()).select(group, F.zip_with(after, F.col(vector), lambda a, b: a.cast("double") - b.cast("double")).alias(into))


def mnf(df: DataFrame, key: str, group: str, vector: str, keep: int, into: str = "rebuilt", floor: float = 1e-6) -> DataFrame:
    """(key, vector, rebuilt): the first ``keep`` minimum noise fractions of each group's spectra, the noise from the differences of
    spectra that follow each other. A group with fewer than two rows more than channels has its channels' noise counted as
    independent; one with fewer than three rows is returned as it is."""
    noise = moments(differences(df, key, group, vector), group, "difference")

    def covariance(n: int, s: np.ndarray, m: np.ndarray) -> np.ndarray:
        return (m - np.outer(s, s) / n) / (n - 1)

    def transform(g: object, n: int, s: np.ndarray, m: np.ndarray) -> Callable[[np.ndarray], np.ndarray]:
        if n < 3:
            return lambda x: x
        cov = covariance(*noise[g]) / 2
        if n - 2 < len(s):
            cov = np.diag(np.diag(cov))
        root = np.linalg.cholesky(cov + np.eye(len(s)) * floor)
        inverse = np.linalg.inv(root)
        _, vectors = np.linalg.eigh(inverse @ covariance(n, s, m) @ inverse.T)
        best = vectors[:, ::-1][:, :keep]
        whole, mean = inverse.T @ best @ best.T @ root.T, s / n
        return lambda x: (x - mean) @ whole + mean

    return _applied(df, key, group, vector, {g: transform(g, *v) for g, v in moments(df, group, vector).items()}, into)
