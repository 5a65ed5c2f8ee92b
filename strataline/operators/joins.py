"""Joins of surveys, each as an equi-join on buckets followed by the exact predicate."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.numbers import is_finite


def interpolate(left: DataFrame, right: DataFrame, time: str, base_time: str, base_value: str, bucket: float, keys: Sequence[str] = (), into: str = "interpolated") -> DataFrame:
    """Linear interpolation of ``right`` at the times of ``left`` without extrapolation; equal
    base times are averaged, the last base time counts. A base interval is listed in
    every bucket of ``bucket`` seconds it touches (so choose it near the base's step), and
    left rows meet the intervals of their bucket only."""
    keys = list(keys)
    base = right.where(F.col(base_time).isNotNull() & F.col(base_value).isNotNull()).groupBy(*keys, F.col(base_time).alias("t0")).agg(F.avg(base_value).alias("v0"))
    # The next base sample comes from the same span of 256 buckets, or else from the first
    # sample of the next span: only spans (few) are ever ordered as a whole.
    base = base.withColumn("span", F.floor(F.col("t0") / (256 * bucket)))
    w = Window.partitionBy(*keys, "span").orderBy("t0")
    heads = base.groupBy(*keys, "span").agg(F.min(F.struct("t0", "v0")).alias("head"))
    heads = heads.withColumn("next", F.lead("head").over(Window.partitionBy(*(keys or [F.lit(0)])).orderBy("span"))).drop("head")
    base = base.withColumn("inner", F.lead(F.struct("t0", "v0")).over(w)).join(heads.select(*[F.col(k).alias(f"__{k}") for k in keys], F.col("span").alias("__span"), "next"), [F.col("span") == F.col("__span"), *(F.col(k).eqNullSafe(F.col(f"__{k}")) for k in keys)])
    after = F.coalesce("inner", "next")
    base = base.select(*keys, "t0", "v0", after["t0"].alias("t1"), after["v0"].alias("v1"))
    pieces = base.withColumn("bucket", F.explode(F.sequence(F.floor(F.col("t0") / bucket), F.floor(F.coalesce("t1", "t0") / bucket))))
    inside = (F.col(time) >= F.col("t0")) & (F.col(time) < F.col("t1")) | (F.col(time) == F.col("t0")) & F.col("t1").isNull()
    seen = left.withColumn("bucket", F.floor(F.col(time) / bucket))
    same = [seen["bucket"] == pieces["bucket"], *(seen[k].eqNullSafe(pieces[k]) for k in keys)]
    condition = same[0]
    for c in same[1:]:
        condition = condition & c
    joined = seen.join(pieces, condition & inside, "left")
    value = F.when(F.col("t1").isNull(), F.col("v0")).otherwise(F.col("v0") + (F.col("v1") - F.col("v0")) * F.try_divide(F.col(time) - F.col("t0"), F.col("t1") - F.col("t0")))
    return joined.select(*[seen[c] for c in left.columns], value.alias(into))


def _places(points: DataFrame, x: str, y: str) -> DataFrame:
    """The rows that have a place: others are no distance from anything."""
    return points.where(is_finite(F.col(x)) & is_finite(F.col(y)))


def _close_places(left: DataFrame, right: DataFrame, reach: float, k: int) -> DataFrame:
    """(__x, __y, close, found): the k nearest places of ``right`` (__rx, __ry, __first, __n) within ``reach`` of each place of ``left``,
    and the rows they have. Left places probe the nine cells of side ``reach`` around them."""
    cell = lambda c: F.floor(F.col(c) / reach)
    points = right.select("__rx", "__ry", "__first", "__n", cell("__rx").alias("__cx"), cell("__ry").alias("__cy"))
    shifts = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (-1, 0, 1) for j in (-1, 0, 1)]))
    probes = left.select("__x", "__y", shifts.alias("__s")).select("__x", "__y", (cell("__x") + F.col("__s.i")).alias("__cx"), (cell("__y") + F.col("__s.j")).alias("__cy"))
    met = probes.join(points.hint("merge"), ["__cx", "__cy"]).withColumn("distance", F.hypot(F.col("__x") - F.col("__rx"), F.col("__y") - F.col("__ry"))).where(F.col("distance") <= reach)
    rank = F.row_number().over(Window.partitionBy("__x", "__y").orderBy("distance", "__first"))
    close = met.withColumn("__rank", rank).where(F.col("__rank") <= k)
    return close.groupBy("__x", "__y").agg(F.collect_list(F.struct("distance", "__rx", "__ry")).alias("close"), F.sum("__n").alias("found"))


def neighbours(left: DataFrame, right: DataFrame, x: str, y: str, right_id: str, radius: float, k: int = 1, left_id: str = "row_id", right_x: str | None = None, right_y: str | None = None, carry: Sequence[str] = (), keep: Sequence[str] = ()) -> DataFrame:
    """The k nearest rows of ``right`` within ``radius`` of each left row (ties by id). Columns: left_id,
    right_id, distance, rank, ``carry`` from the right and ``keep`` from the left. A left id that occurs twice is answered once.

    Places meet, not rows: rows of one place have the same neighbours, and of a place's right rows only the k
    least ids can be among the k nearest, so no more than k places count (by distance and least id). Left places
    look within a quarter of the radius first; only those that find fewer than k rows there look further. No side is
    broadcast: a small file may have more rows than the driver can hold."""
    rx, ry = right_x or x, right_y or y
    rows = _places(right, rx, ry).select(F.col(right_id).alias("__rid"), F.col(rx).alias("__rx"), F.col(ry).alias("__ry"), *carry)
    least = F.row_number().over(Window.partitionBy("__rx", "__ry").orderBy("__rid"))
    rows = rows.withColumn("__k", least).where(F.col("__k") <= k).drop("__k")
    places = rows.groupBy("__rx", "__ry").agg(F.min(F.struct("__rid")).alias("__first"), F.count("*").alias("__n"))
    asked = _places(left, x, y).select(F.col(left_id), F.col(x).alias("__x"), F.col(y).alias("__y"), *keep)
    probes = asked.select("__x", "__y").distinct()
    enough = _close_places(probes, places, radius / 4, k).where(F.col("found") >= k)
    close = enough.unionByName(_close_places(probes.join(enough.hint("merge"), ["__x", "__y"], "left_anti"), places, radius, k))
    met = close.select("__x", "__y", F.inline("close")).join(rows.hint("merge"), ["__rx", "__ry"])
    nearest = F.row_number().over(Window.partitionBy("__x", "__y").orderBy("distance", "__rid"))
    met = met.withColumn("rank", nearest).where(F.col("rank") <= k).drop("rank", "__rx", "__ry")
    rank = F.row_number().over(Window.partitionBy(left_id).orderBy("distance", "__rid"))
    out = asked.join(met.hint("merge"), ["__x", "__y"]).withColumn("rank", rank).where(F.col("rank") <= k)
    return out.select(left_id, F.col("__rid").alias(right_id), "distance", "rank", *carry, *keep)


def overlaps(left: DataFrame, right: DataFrame, left_range: tuple[str, str], right_range: tuple[str, str], bucket: float) -> DataFrame:
    """Pairs of intervals with a common part of positive length, with ``overlap``; each pair
    once, in the bucket where the later of the two starts."""
    (a0, a1), (b0, b1) = left_range, right_range
    spread = lambda lo, hi: F.explode(F.sequence(F.floor(F.col(lo) / bucket), F.floor(F.col(hi) / bucket)))
    l, r = left.withColumn("__bucket", spread(a0, a1)), right.withColumn("__bucket", spread(b0, b1))  # noqa: E741
    met = l.join(r, "__bucket")
    start, end = F.greatest(a0, b0), F.least(a1, b1)
    return met.where((F.floor(start / bucket) == F.col("__bucket")) & (end > start)).withColumn("overlap", end - start).drop("__bucket")


def inverse_distance(near: DataFrame, left_id: str, value: str, power: float = 2.0, tiny: float = 1e-12) -> DataFrame:
    """Weighted mean of the neighbours; an exact hit wins."""
    exact = F.col("distance") <= tiny
    weight = F.pow(F.when(exact, None).otherwise(F.col("distance")), F.lit(-power))
    return near.groupBy(left_id).agg(F.coalesce(F.avg(F.when(exact, F.col(value))), F.try_divide(F.sum(weight * F.col(value)), F.sum(weight))).alias("estimate"), F.count("*").alias("n_near"))


def reciprocal_errors(df: DataFrame, a: str, b: str, m: str, n: str, resistance: str) -> DataFrame:
    """Pairs of quadrupoles with current and potential electrodes exchanged; swapping a pair
    flips the sign; repeats are averaged first. One row per pair (the smaller first)."""
    low, high = lambda p, q: F.least(p, q), lambda p, q: F.greatest(p, q)
    sign = F.when(F.col(a) < F.col(b), 1.0).otherwise(-1.0) * F.when(F.col(m) < F.col(n), 1.0).otherwise(-1.0)
    means = df.select(low(a, b).alias("a"), high(a, b).alias("b"), low(m, n).alias("m"), high(m, n).alias("n"), (sign * F.col(resistance)).alias("r"))
    means = means.groupBy("a", "b", "m", "n").agg(F.avg("r").alias("r"), F.count("*").alias("repeats"))
    other = means.select(F.col("m").alias("a"), F.col("n").alias("b"), F.col("a").alias("m"), F.col("b").alias("n"), F.col("r").alias("r_back"), F.col("repeats").alias("repeats_back"))
    both = means.join(other, ["a", "b", "m", "n"]).where(F.struct("a", "b") < F.struct("m", "n"))
    return both.withColumn("error_percent", F.try_divide(F.abs(F.col("r") - F.col("r_back")) * 200, F.abs("r") + F.abs("r_back")))


def variogram(points: DataFrame, point_id: str, x: str, y: str, value: str, width: float, n_lags: int) -> DataFrame:
    """Semivariance by lag bin [i width, (i + 1) width), the last bin closed: each pair of rows with different ids once.

    Places meet in cells of the largest lag, not rows: the squared differences of all pairs between two places are
    exact sums of the places' counts, means and variances, of which none cancel. Pairs of rows with one id are taken off."""
    reach = width * n_lags
    rows = _places(points, x, y).where(F.col(point_id).isNotNull()).select(F.col(point_id).alias("id"), F.col(x).alias("x"), F.col(y).alias("y"), F.col(value).alias("v"))

    def lags(places: DataFrame, keys: Sequence[str]) -> DataFrame:
        """(lag, pairs, h, valued, g): pairs within and between the places, of one value of the keys."""
        cell = lambda c: F.floor(F.col(c) / reach)
        a = places.select(*keys, *[F.col(c).alias(f"{c}a") for c in ("x", "y", "n", "m", "mean", "m2")], cell("x").alias("cx"), cell("y").alias("cy"))
        shifts = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i, j in ((0, 0), (0, 1), (1, -1), (1, 0), (1, 1))]))
        b = places.select(*keys, *[F.col(c).alias(f"{c}b") for c in ("x", "y", "n", "m", "mean", "m2")], shifts.alias("s"))
        b = b.select("*", (cell("xb") + F.col("s.i")).alias("cx"), (cell("yb") + F.col("s.j")).alias("cy"), ((F.col("s.i") == 0) & (F.col("s.j") == 0)).alias("own")).drop("s")
        met = a.join(b, [*keys, "cx", "cy"]).where(~F.col("own") | (F.struct("xa", "ya") < F.struct("xb", "yb")))
        met = met.withColumn("h", F.hypot(F.col("xa") - F.col("xb"), F.col("ya") - F.col("yb"))).where(F.col("h") <= reach)
        n, m = F.col("na") * F.col("nb"), F.col("ma") * F.col("mb")
        g = F.when(m > 0, F.col("mb") * F.col("m2a") + F.col("ma") * F.col("m2b") + m * F.pow(F.col("meana") - F.col("meanb"), F.lit(2.0)))
        between = met.select("h", n.alias("n"), m.alias("m"), g.alias("g"))
        half = lambda c: F.floor(F.col(c) * (F.col(c) - 1) / 2)
        within = places.where("n > 1").select(F.lit(0.0).alias("h"), half("n").alias("n"), half("m").alias("m"), F.when(F.col("m") > 1, F.col("m") * F.col("m2")).alias("g"))
        lag = F.least(F.floor(F.col("h") / width), F.lit(n_lags - 1)).cast("int")
        return between.unionByName(within).groupBy(lag.alias("lag")).agg(F.sum("n").alias("pairs"), F.sum(F.col("h") * F.col("n")).alias("h"), F.sum("m").alias("valued"), F.sum("g").alias("g"))

    def placed(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
        m = F.count("v")
        return rows.groupBy(*keys, "x", "y").agg(F.count("*").alias("n"), m.alias("m"), F.avg("v").alias("mean"), (F.var_pop("v") * m).alias("m2"))

    repeated = rows.join(rows.groupBy("id").count().where("count > 1").select("id"), "id")
    same = lags(placed(repeated, ["id"]), ["id"])
    signed = lags(placed(rows, []), []).unionByName(same.select("lag", *[(-F.col(c)).alias(c) for c in ("pairs", "h", "valued", "g")]))
    total = signed.groupBy("lag").agg(*[F.sum(c).alias(c) for c in ("pairs", "h", "valued", "g")]).where("pairs > 0")
    return total.select("lag", "pairs", (F.col("h") / F.col("pairs")).alias("mean_distance"), (F.try_divide("g", "valued") / 2).alias("semivariance"))


def missing_keys(df: DataFrame, table: DataFrame, key: str) -> DataFrame:
    """Keys of ``df`` that the lookup table lacks (a guard: it should be empty)."""
    return df.select(key).distinct().join(table.select(key), key, "left_anti")


def lookup(df: DataFrame, table: DataFrame, key: str, value: str, default: float | None = None) -> DataFrame:
    """Left lookup of one value per key; ``default`` where the key is missing."""
    out = df.join(table.select(key, value), key, "left")
    return out if default is None else out.withColumn(value, F.coalesce(F.col(value), F.lit(default)))
