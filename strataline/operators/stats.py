"""Aggregates, histograms and stretches."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.numbers import is_finite


def channel_quality(df: DataFrame, value: str, keys: Sequence[str] = (), expected_minimum: float = 0.0) -> DataFrame:
    """Cells, finite, missing and low cells, and the statistics of the finite ones (population deviation, exact percentiles)."""
    v = F.when(is_finite(F.col(value)), F.col(value))
    return df.groupBy(*keys).agg(
        F.count("*").alias("cells"),
        F.count(v).alias("finite_cells"),
        (F.count("*") - F.count(v)).alias("missing_cells"),
        F.count_if(v < expected_minimum).alias("negative_cells"),
        F.min(v).alias("minimum"),
        F.max(v).alias("maximum"),
        F.avg(v).alias("mean"),
        F.stddev_pop(v).alias("standard_deviation"),
        *[F.percentile(v, F.lit(p)).alias(n) for p, n in ((0.02, "p02"), (0.5, "median"), (0.98, "p98"))],
    )


def stretch_bounds(df: DataFrame, values: Sequence[str], low: float = 0.02, high: float = 0.98) -> DataFrame:
    """One row: the percentiles of each column."""
    return df.agg(*[F.percentile(F.col(v), F.lit(p)).alias(f"{v}_{n}") for v in values for p, n in ((low, "low"), (high, "high"))])


def stretched(value: str) -> Column:
    """0 to 1 between the bounds of :func:`stretch_bounds`; 0 where they are equal."""
    lo, hi, v = F.col(f"{value}_low"), F.col(f"{value}_high"), F.col(value)
    return F.when(v.isNull(), None).when(hi <= lo, 0.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.try_divide(v - lo, hi - lo))))


def histogram(df: DataFrame, value: str, start: float, width: float, n: int, keys: Sequence[str] = ()) -> DataFrame:
    """Counts of bins [start + i width, ...); the last bin is closed; values outside don't count."""
    b = F.floor((F.col(value) - start) / width)
    b = F.when((F.col(value) >= start) & (F.col(value) <= start + width * n), F.least(b, F.lit(n - 1)))
    return df.withColumn("bin", b.cast("int")).where(F.col("bin").isNotNull()).groupBy(*keys, "bin").agg(F.count("*").alias("n"))


def entropy(df: DataFrame, keys: Sequence[str], category: str) -> DataFrame:
    """Shannon entropy in bits of a category in each group."""
    counts = df.groupBy(*keys, category).agg(F.count("*").alias("n"))
    share = F.col("n") / F.sum("n").over(Window.partitionBy(*keys))
    return counts.withColumn("p", share).groupBy(*keys).agg((-F.sum(F.col("p") * F.log2("p"))).alias("entropy"), F.count("*").alias("categories"))


def axial_mean(degrees: Column) -> Column:
    """Mean of directions without sense, 0 to 180, by doubled angles."""
    doubled = F.radians(degrees * 2)
    return F.pmod(F.degrees(F.atan2(F.avg(F.sin(doubled)), F.avg(F.cos(doubled)))) / 2, F.lit(180.0))


def axis_of_points(df: DataFrame, keys: Sequence[str], x: str, y: str) -> DataFrame:
    """Principal direction of each group's points (closed form of the 2 x 2 covariance), degrees from north, and its centre."""
    sums = df.groupBy(*keys).agg(F.var_pop(x).alias("xx"), F.var_pop(y).alias("yy"), F.covar_pop(x, y).alias("xy"), F.avg(x).alias("cx"), F.avg(y).alias("cy"), F.count("*").alias("n"))
    angle = F.degrees(F.atan2(F.col("xy") * 2, F.col("yy") - F.col("xx"))) / 2
    root = F.sqrt(F.pow(F.col("xx") - F.col("yy"), F.lit(2.0)) + F.pow(F.col("xy") * 2, F.lit(2.0)))
    return sums.select(*keys, "cx", "cy", "n", F.pmod(angle, F.lit(180.0)).alias("azimuth"), ((F.col("xx") + F.col("yy") + root) / 2).alias("major"), ((F.col("xx") + F.col("yy") - root) / 2).alias("minor"))


def robust_keep(df: DataFrame, value: str, sigmas: float) -> DataFrame:
    """With ``accepted``: within ``sigmas`` of 1.4826 MAD of the median of the whole column (a MAD of 0 keeps all)."""
    middle = df.agg(F.percentile(F.col(value), F.lit(0.5)).alias("__m"))
    out = df.crossJoin(F.broadcast(middle)).withColumn("__off", F.abs(F.col(value) - F.col("__m")))
    spread = out.agg(F.percentile(F.col("__off"), F.lit(0.5)).alias("__mad"))
    out = out.crossJoin(F.broadcast(spread))
    return out.withColumn("accepted", (F.col("__mad") == 0) | (F.col("__off") <= F.col("__mad") * (sigmas * 1.4826))).drop("__m", "__off", "__mad")


def weighted_median(df: DataFrame, keys: Sequence[str], value: str, weight: str) -> DataFrame:
    """The least value at which the running weight reaches half of the group's."""
    w = Window.partitionBy(*keys)
    run = F.sum(weight).over(w.orderBy(value).rangeBetween(Window.unboundedPreceding, 0))
    return df.withColumn("__run", run).withColumn("__all", F.sum(weight).over(w)).where(F.col("__run") >= F.col("__all") / 2).groupBy(*keys).agg(F.min(value).alias("weighted_median"))


def components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """(node, component) of an undirected graph; the component is its least node. Label
    propagation with pointer jumping; each round's labels are cut from their lineage by checkpoint()."""
    both = edges.select(F.col(a).alias("a"), F.col(b).alias("b")).union(edges.select(F.col(b).alias("a"), F.col(a).alias("b"))).distinct()
    labels = both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("component")).checkpoint()
    while True:
        near = both.join(labels.select(F.col("node").alias("b"), "component"), "b").groupBy(F.col("a").alias("node")).agg(F.min("component").alias("nearest"))
        step = labels.join(near, "node").select("node", F.col("component").alias("old"), F.least("component", "nearest").alias("component"))
        jump = labels.select(F.col("node").alias("component"), F.col("component").alias("further"))
        step = step.join(jump, "component", "left").select("node", "old", F.least("component", F.coalesce("further", "component")).alias("component")).checkpoint()
        labels = step.select("node", "component")
        if step.where("component != old").isEmpty():
            return labels
