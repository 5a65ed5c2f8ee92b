"""Survey tracks as segments: crossovers of lines, their adjacency, and positions along lines."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.numbers import is_finite


def track_distance(df: DataFrame, keys: Sequence[str], x: str, y: str, row_id: str = "row_id", into: str = "distance") -> DataFrame:
    """Distance along each line from its first row, over the rows with a position."""
    w = Window.partitionBy(*keys).orderBy(row_id)
    step = F.hypot(F.col(x) - F.last(x, True).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.col(y) - F.last(y, True).over(w.rowsBetween(Window.unboundedPreceding, -1)))
    placed = F.col(x).isNotNull() & F.col(y).isNotNull()
    return df.withColumn("__step", F.when(placed, F.coalesce(step, F.lit(0.0)))).withColumn(into, F.when(placed, F.sum("__step").over(w.rowsBetween(Window.unboundedPreceding, 0)))).drop("__step")


def segments(df: DataFrame, line: str, x: str, y: str, value: str, row_id: str = "row_id", max_length: float | None = None) -> DataFrame:
    """Each two rows of a line that follow each other: line, row_id of the first, x0, y0, x1, y1, s0 (distance along the
    line to the first), v0, v1. Longer ones than ``max_length`` are gaps, not track."""
    w = Window.partitionBy(line).orderBy(row_id)
    good = df.where(is_finite(F.col(x)) & is_finite(F.col(y)) & F.col(line).isNotNull())
    out = track_distance(good, [line], x, y, row_id, "s0").select(line, row_id, F.col(x).cast("double").alias("x0"), F.col(y).cast("double").alias("y0"), "s0", F.col(value).alias("v0"), F.lead(x).over(w).cast("double").alias("x1"), F.lead(y).over(w).cast("double").alias("y1"), F.lead(value).over(w).alias("v1"))
    length = F.hypot(F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0"))
    return out.where((length > 0) & (length <= max_length if max_length is not None else F.lit(True)))


def _boxes(s: DataFrame, cell: float) -> DataFrame:
    """Segments in every cell that their box touches."""
    span = lambda a, b: F.sequence(F.floor(F.least(a, b) / cell), F.floor(F.greatest(a, b) / cell))
    return s.withColumn("__cx", F.explode(span("x0", "x1"))).withColumn("__cy", F.explode(span("y0", "y1")))


def crossovers(traverses: DataFrame, ties: DataFrame, cell: float) -> DataFrame:
    """Points where a segment of a traverse crosses one of a tie (tables of :func:`segments` with ``line``): traverse, tie,
    x, y, traverse_distance, tie_distance, traverse_value, tie_value (linear within the segments) and residual.

    Segments meet in the cells (of side ``cell``, best a few segment lengths) that both boxes touch, and a
    pair counts in the one that has the lower corner of the boxes' common part. A crossing belongs to the segment on whose
    start or inside it lies, so a point that two segments share is found once. Parallel segments don't cross."""
    t = _boxes(traverses, cell).select("__cx", "__cy", F.col("line").alias("traverse"), *[F.col(c).alias(f"a_{c}") for c in ("x0", "y0", "x1", "y1", "s0", "v0", "v1")])
    u = _boxes(ties, cell).select("__cx", "__cy", F.col("line").alias("tie"), *[F.col(c).alias(f"b_{c}") for c in ("x0", "y0", "x1", "y1", "s0", "v0", "v1")])
    low = lambda p: F.greatest(F.least(f"a_{p}0", f"a_{p}1"), F.least(f"b_{p}0", f"b_{p}1"))
    met = t.join(u, ["__cx", "__cy"]).where((F.floor(low("x") / cell) == F.col("__cx")) & (F.floor(low("y") / cell) == F.col("__cy")))
    return _crossed(met)


def _crossed(met: DataFrame) -> DataFrame:
    c = F.col
    ax, ay, bx, by = c("a_x1") - c("a_x0"), c("a_y1") - c("a_y0"), c("b_x1") - c("b_x0"), c("b_y1") - c("b_y0")
    dx, dy = c("b_x0") - c("a_x0"), c("b_y0") - c("a_y0")
    cross = ax * by - ay * bx
    p, q = F.try_divide(dx * by - dy * bx, cross), F.try_divide(dx * ay - dy * ax, cross)
    met = met.withColumn("p", p).withColumn("q", q).where("p >= 0 and p < 1 and q >= 0 and q < 1")
    along: dict[str, Column] = {"x": c("a_x0") + ax * c("p"), "y": c("a_y0") + ay * c("p"), "traverse_distance": c("a_s0") + F.hypot(ax, ay) * c("p"), "tie_distance": c("b_s0") + F.hypot(bx, by) * c("q")}
    out = met.select("traverse", "tie", *[e.alias(n) for n, e in along.items()], (c("a_v0") + (c("a_v1") - c("a_v0")) * c("p")).alias("traverse_value"), (c("b_v0") + (c("b_v1") - c("b_v0")) * c("q")).alias("tie_value"))
    return out.withColumn("residual", c("traverse_value") - c("tie_value"))


def adjacency(crossings: DataFrame, line: str = "traverse", distance: str = "traverse_distance") -> DataFrame:
    """Crossings with ``rank`` along their line and the gaps to the one before and after (``back``, ``ahead``)."""
    w = Window.partitionBy(line).orderBy(distance, "tie", "tie_distance")
    return crossings.withColumn("rank", F.row_number().over(w)).withColumn("back", F.col(distance) - F.lag(distance).over(w)).withColumn("ahead", F.lead(distance).over(w) - F.col(distance))


def leveled(df: DataFrame, corrections: DataFrame, line: str, value: str, into: str = "leveled") -> DataFrame:
    """The value with its line's correction (line as text, correction); lines without one keep theirs."""
    table = corrections.select(F.col("line").alias("__line"), "correction")
    return df.join(F.broadcast(table), F.col(line).cast("string") == F.col("__line"), "left").withColumn(into, F.col(value) + F.coalesce("correction", F.lit(0.0))).drop("__line", "correction")


def inside_polygon(x: Column, y: Column, ring: Sequence[tuple[float, float]]) -> Column:
    """Whether a point is in a polygon (first corner not repeated), its boundary included. Null coordinates are outside."""
    if len(ring) < 3:
        raise ValueError("a polygon has three corners at least")
    odd, edge = F.lit(0), F.lit(False)
    for (x0, y0), (x1, y1) in zip(ring, [*ring[1:], ring[0]]):
        side = (x - x0) * (y1 - y0) - (y - y0) * (x1 - x0)
        edge = edge | ((side == 0) & x.between(min(x0, x1), max(x0, x1)) & y.between(min(y0, y1), max(y0, y1)))
        if y0 != y1:
            spans = (y >= min(y0, y1)) & (y < max(y0, y1))
            odd = odd + F.when(spans & (x < (y - y0) * ((x1 - x0) / (y1 - y0)) + x0), 1).otherwise(0)
    return F.coalesce(edge | (odd % 2 == 1), F.lit(False))


def clip(df: DataFrame, x: str, y: str, rings: Sequence[Sequence[tuple[float, float]]], signals: Sequence[str]) -> DataFrame:
    """All rows; the signals of those outside every polygon are null."""
    inside = F.lit(False)
    for ring in rings:
        inside = inside | inside_polygon(F.col(x), F.col(y), ring)
    return df.withColumns({s: F.when(inside, F.col(s)) for s in signals})


def normal_id(value: Column) -> Column:
    """An id as text without a needless fraction: 2.0, ' 2 ' and 2 are the same."""
    text = F.trim(value.cast("string"))
    return F.when(text.rlike(r"^[+-]?\d+\.0*$"), F.regexp_replace(text, r"\.0*$", "")).otherwise(text)


def exclude_sensors(df: DataFrame, sensor: str, excluded: Sequence[object], signals: Sequence[str]) -> DataFrame:
    """All rows; the signals of the excluded sensors are null."""
    names = [str(int(e)) if isinstance(e, float) and e == int(e) else str(e).strip() for e in excluded]
    out = F.coalesce(normal_id(F.col(sensor)).isin(names), F.lit(False))
    return df.withColumns({s: F.when(~out, F.col(s)) for s in signals})


def without_dummies(df: DataFrame, signals: Sequence[str], dummies: Sequence[float], tolerance: float = 0.0) -> DataFrame:
    """All rows; values that stand for "none" (within ``tolerance``), NaN and infinities are null."""
    clean = lambda s: F.when(is_finite(F.col(s)) & ~F.greatest(*[F.abs(F.col(s) - d) <= tolerance for d in dummies], F.lit(False)), F.col(s))
    return df.withColumns({s: clean(s) for s in signals})


def accepted(filters: Sequence[tuple[str, Sequence[object]]]) -> dict[str, list[object]]:
    """Filters (channel, accepted values) as one per channel: several of one channel intersect."""
    out: dict[str, list[object]] = {}
    for name, values in filters:
        known = list(dict.fromkeys(values))
        out[name] = [v for v in out[name] if v in known] if name in out else known
    return out


def along_distance(left: DataFrame, right: DataFrame, keys: Sequence[str], distance: str, right_distance: str, right_value: str, bucket: float, into: str = "interpolated") -> DataFrame:
    """The right line's value at the left rows' distances, linear, without extrapolation (see :func:`joins.interpolate`)."""
    from .joins import interpolate

    return interpolate(left, right, distance, right_distance, right_value, bucket, keys, into)


def metre_median_residual(df: DataFrame, keys: Sequence[str], distance: str, value: str, half: float, into: str = "residual") -> DataFrame:
    """Value less the median of the values up to ``half`` metres away along the line, in whole millimetres; null where the line doesn't reach that far on both sides."""
    reach, at = round(half * 1000), F.round(F.col(distance) * 1000).cast("long")
    near = F.percentile(F.col(value), F.lit(0.5)).over(Window.partitionBy(*keys).orderBy("__mm").rangeBetween(-reach, reach))
    line = Window.partitionBy(*keys)
    whole = (F.col("__mm") - reach >= F.min("__mm").over(line)) & (F.col("__mm") + reach <= F.max("__mm").over(line))
    return df.withColumn("__mm", at).withColumn(into, F.when(whole, F.col(value) - near)).drop("__mm")


def threshold_despike(df: DataFrame, keys: Sequence[str], value: str, limit: float, row_id: str = "row_id", into: str = "despiked", flag: str = "spike") -> DataFrame:
    """A value more than ``limit`` from the mean of its two neighbours, on the same side of both, becomes that
    mean. The first and last value of a line have no two neighbours: they are kept untested."""
    w = Window.partitionBy(*keys).orderBy(row_id)
    before, after = F.lag(value).over(w), F.lead(value).over(w)
    mean = (before + after) / 2
    spike = F.coalesce((F.abs(F.col(value) - mean) > limit) & ((F.col(value) - before) * (F.col(value) - after) > 0), F.lit(False))
    return df.withColumn("__mean", mean).withColumn(flag, spike).withColumn(into, F.when(F.col(flag), F.col("__mean")).otherwise(F.col(value))).drop("__mean")


def default_gaps(df: DataFrame, keys: Sequence[str], axis: str, row_id: str = "row_id", times: float = 2.0) -> DataFrame:
    """The keys and ``max_gap``: ``times`` the median positive step of the axis along each line."""
    step = F.col(axis) - F.lag(axis).over(Window.partitionBy(*keys).orderBy(row_id))
    return df.withColumn("__step", step).where("__step > 0").groupBy(*keys).agg((F.percentile("__step", F.lit(0.5)) * times).alias("max_gap"))


def profile_parity(df: DataFrame, sensor: str, profile: str, row_id: str = "row_id") -> DataFrame:
    """(sensor, profile, number, parity): profiles of a sensor in the order they were flown, odd ones 1."""
    first = df.groupBy(sensor, profile).agg(F.min(row_id).alias("first"))
    number = F.row_number().over(Window.partitionBy(sensor).orderBy("first"))
    return first.withColumn("number", number).withColumn("parity", F.col("number") % 2).drop("first")


def envelope(df: DataFrame, segment: str, position: str, value: str, points: int, keys: Sequence[str] = ()) -> DataFrame:
    """Least and greatest value of the bins of each segment for a display of about ``points`` points: a segment gets bins
    in proportion to its rows, one at least. Segments are counted first; a bin never crosses a segment."""
    sizes = df.where(F.col(segment).isNotNull()).groupBy(*keys, segment).agg(F.count("*").alias("__n"), F.min(position).alias("__lo"), F.max(position).alias("__hi"))
    total = Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))
    sizes = sizes.withColumn("__bins", F.greatest(F.lit(1), F.floor(F.lit(points / 2) * F.col("__n") / F.sum("__n").over(total))).cast("int"))
    share = F.try_divide(F.col(position) - F.col("__lo"), F.col("__hi") - F.col("__lo"))
    at = F.least(F.floor(F.coalesce(share, F.lit(0.0)) * F.col("__bins")), F.col("__bins") - 1).cast("int")
    return df.join(sizes, [*keys, segment]).groupBy(*keys, segment, at.alias("bin")).agg(F.min(value).alias("low"), F.max(value).alias("high"), F.count(value).alias("n"))


def grid_despike(cells: DataFrame, radius: int, threshold: float, rows: int, cols: int, keys: Sequence[str] = ()) -> DataFrame:
    """2-D Hampel filter of a grid of ``rows`` x ``cols`` cells from (0, 0) with edges mirrored without repeating them: a value further than ``threshold``
    1.4826 MAD from the median of its (2 radius + 1)^2 window becomes the median."""
    mirror = lambda p, n: F.when(p < 0, -p).when(p >= n, 2 * (n - 1) - p).otherwise(p)
    shifts = [(i, j) for i in range(-radius, radius + 1) for j in range(-radius, radius + 1)]
    spread = cells.select(*keys, "r", "c", "z", F.inline(F.array(*[F.struct((F.col("r") + i).alias("r1"), (F.col("c") + j).alias("c1")) for i, j in shifts])))
    asked = spread.select(*keys, "r", "c", "z", mirror(F.col("r1"), rows).alias("r2"), mirror(F.col("c1"), cols).alias("c2"))
    near = asked.join(cells.select(*keys, F.col("r").alias("r2"), F.col("c").alias("c2"), F.col("z").alias("zn")), [*keys, "r2", "c2"]).where("zn is not null")
    stats = near.groupBy(*keys, "r", "c").agg(F.first("z").alias("z"), F.percentile("zn", F.lit(0.5)).alias("m"), F.collect_list("zn").alias("around"))
    mad = F.expr("array_sort(transform(around, v -> abs(v - m)))")
    stats = stats.withColumn("d", mad).withColumn("n", F.size("d"))
    middle = (F.element_at("d", F.floor((F.col("n") + 1) / 2).cast("int")) + F.element_at("d", F.floor(F.col("n") / 2).cast("int") + 1)) / 2
    spike = F.col("z").isNotNull() & (F.abs(F.col("z") - F.col("m")) > F.greatest(middle * (1.4826 * threshold), F.lit(1e-12)))
    return stats.select(*keys, "r", "c", spike.alias("spike"), F.when(spike, F.col("m")).otherwise(F.col("z")).alias("despiked"))


def bin_visits(df: DataFrame, keys: Sequence[str], distance: str, size: float, row_id: str = "row_id") -> DataFrame:
    """(keys, bin, row_id): the first row of each bin of ``size`` metres that a line visits, in the order of the rows."""
    rows = df.where(F.col(distance).isNotNull()).withColumn("bin", F.floor(F.col(distance) / size))
    return rows.groupBy(*keys, "bin").agg(F.min(row_id).alias(row_id))
