"""Operators on ordered survey lines.

A table has a dense ``row_id`` in acquisition order; a line is a set of key
columns. All windows are partitioned by the line and ordered by row_id, so one
shuffle by the line serves every operator stacked on it.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, WindowSpec, functions as F

from ..functions.geophysics import angle_between, azimuth
from ..functions.numbers import finite, flag_bits, is_finite

INVALID, TIME_GAP, SPACING, SPEED, TURN, CLEARANCE, VALUE_RATE = 1, 2, 4, 8, 16, 32, 64
BASE_INVALID, BASE_GAP, BASE_SPIKE, BASE_RATE, BASE_DRIFT = 1, 2, 4, 8, 16
MAD_SCALE = 1.4826


def along(keys: Sequence[str], order: Sequence[str] = ("row_id",)) -> WindowSpec:
    return Window.partitionBy(*keys).orderBy(*order)


def add_segments(df: DataFrame, keys: Sequence[str], value: str, axis: str | None = None, max_gap: float | None = None, row_id: str = "row_id", into: str = "segment", increasing: bool = True, finite_only: bool = True) -> DataFrame:
    """Runs of a line: rows next to each other in acquisition order, of one line, with
    finite values (and axis) and no axis step over ``max_gap``. A line that comes back
    starts a new run. Because row ids are dense, a row of another line shows as a gap in
    this line's ids, so the window needs no global order. Rows outside runs get null.
    ``increasing``: an axis that stands still or goes back within a run is an error; else it stays in its run.
    ``finite_only``: else any value that is not null counts, and a row without an axis stays in its run.
    Rows of one id are numbered alike."""
    w = along(keys, [row_id])
    good = is_finite(F.col(value)) if finite_only else F.col(value).isNotNull()
    if axis is not None and finite_only:
        good = good & is_finite(F.col(axis))
    out = df.withColumn("__good", good)
    starts = (F.col(row_id) - F.lag(row_id).over(w) != 1) | ~F.lag("__good").over(w) | F.lag(row_id).over(w).isNull()
    if axis is not None:
        step = F.col(axis) - F.lag(axis).over(w)
        if increasing:
            wrong = F.col("__good") & F.lag("__good").over(w) & (F.col(row_id) - F.lag(row_id).over(w) == 1) & (step <= 0)
            starts = starts | F.when(wrong, F.raise_error(F.lit("the axis of a run does not increase")).cast("boolean")).otherwise(False)
        if max_gap is not None:
            starts = starts | F.coalesce(step > max_gap, F.lit(False))
    out = out.withColumn("__start", (F.col("__good") & starts).cast("int"))
    number = F.sum("__start").over(w)
    return out.withColumn(into, F.when(F.col("__good"), number)).drop("__good", "__start")


def _frame(keys: Sequence[str], half: int, row_id: str = "row_id") -> WindowSpec:
    return along(keys, [row_id]).rowsBetween(-half, half)


def moving_mean(value: str, keys: Sequence[str], width: int) -> Column:
    """Centred; null where the window isn't complete."""
    w = _frame(keys, _half(width))
    return F.when(F.count(value).over(w) == width, F.avg(value).over(w))


def moving_median(value: str, keys: Sequence[str], width: int) -> Column:
    w = _frame(keys, _half(width))
    return F.when(F.count(value).over(w) == width, F.percentile(F.col(value), F.lit(0.5)).over(w))


def _half(width: int) -> int:
    if width < 3 or width % 2 == 0 or width > 1001:
        raise ValueError("a window is odd, from 3 to 1001")
    return width // 2


def _median(sorted_values: Column) -> Column:
    n = F.size(sorted_values)
    middle = (n / 2).cast("int")
    return F.when(n > 0, (F.get(sorted_values, middle) + F.get(sorted_values, F.floor((n - 1) / 2).cast("int"))) / 2)


def add_local_spread(df: DataFrame, value: str, keys: Sequence[str], half: int, row_id: str = "row_id", median: str = "local_median", sigma: str = "local_sigma", count: str = "local_count") -> DataFrame:
    """Median and 1.4826 MAD (around that median) of the rows up to ``half`` away; edges use what is there."""
    w = _frame(keys, half, row_id)
    out = df.withColumn("__window", F.array_sort(F.collect_list(finite(F.col(value))).over(w)))
    out = out.withColumn(count, F.size("__window")).withColumn(median, _median(F.col("__window")))
    away = F.array_sort(F.transform("__window", lambda v: F.abs(v - F.col(median))))
    return out.withColumn("__away", away).withColumn(sigma, _median(F.col("__away")) * MAD_SCALE).drop("__window", "__away")


def hampel(df: DataFrame, value: str, keys: Sequence[str], half: int = 3, threshold: float = 4.5, complete: bool = False, into: str = "filtered", flag: str = "replaced") -> DataFrame:
    """Values further than ``threshold`` sigmas from the local median become the median.
    ``complete``: only full windows are judged, the others' values are null."""
    out = add_local_spread(df, value, keys, half)
    v, m = F.col(value), F.col("local_median")
    enough = F.col("local_count") == 2 * half + 1 if complete else F.col("local_count") >= 3
    floor = F.greatest(F.abs(m), F.lit(1.0)) * 2.220446049250313e-16
    limit = F.col("local_sigma") * threshold if complete else F.greatest(F.col("local_sigma"), floor) * threshold
    spike = F.coalesce(is_finite(v) & enough & (F.abs(v - m) > limit), F.lit(False))
    kept = F.when(spike, m).otherwise(v)
    return out.withColumn(flag, spike).withColumn(into, F.when(enough, kept) if complete else kept).drop("local_median", "local_sigma", "local_count")


ROW_BLOCK = 1 << 16


def in_row_blocks(df: DataFrame, reach: int, row_id: str = "row_id", size: int = ROW_BLOCK) -> DataFrame:
    """Rows in blocks of ``size`` row ids, those within ``reach`` of a border in the next block too: columns __block and
    __own. Windows that stay within ``reach`` rows are partitioned by the block, so a line of any length is many bounded tasks."""
    if not 0 <= reach < size:
        raise ValueError("the reach is less than a block")
    first, last = F.floor((F.col(row_id) - reach) / size), F.floor((F.col(row_id) + reach) / size)
    out = df.withColumn("__block", F.explode(F.sequence(first, last)))
    return out.withColumn("__own", F.floor(F.col(row_id) / size) == F.col("__block"))


def filter_runs(df: DataFrame, value: str, keys: Sequence[str], width: int, kind: str = "mean", *, axis: str | None = None, max_gap: float | None = None, row_id: str = "row_id", into: str = "filtered", size: int = ROW_BLOCK) -> DataFrame:
    """``mean`` or ``median`` of complete centred windows within runs: rows with ids that follow each other, of one line, with
    finite values (and axis) and no axis step over ``max_gap``. Null where the window isn't complete. One shuffle by
    blocks of rows, whatever the number and length of the lines."""
    half = _half(width)
    if kind not in ("mean", "median"):
        raise ValueError("mean or median")
    w = Window.partitionBy("__block").orderBy(row_id)
    before = lambda c: F.lag(c).over(w)
    good = is_finite(F.col(value)) & (is_finite(F.col(axis)) if axis is not None else F.lit(True))
    out = in_row_blocks(df, half + 1, row_id, size).withColumn("__good", good)
    same = (F.col(row_id) - before(row_id) == 1) & F.col("__good") & before("__good")
    for k in keys:
        same = same & F.col(k).eqNullSafe(before(k))
    if axis is not None and max_gap is not None:
        same = same & (F.col(axis) - before(axis) <= max_gap)
    out = out.withColumn("__run", F.sum((~F.coalesce(same, F.lit(False))).cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    frame = Window.partitionBy("__block", "__run").orderBy(row_id).rowsBetween(-half, half)
    middle = F.avg(value).over(frame) if kind == "mean" else F.percentile(F.col(value), F.lit(0.5)).over(frame)
    out = out.withColumn(into, F.when(F.col("__good") & (F.count(value).over(frame) == width), middle))
    return out.where("__own").drop("__block", "__own", "__good", "__run")


def detrend(value: str, axis: str, keys: Sequence[str]) -> Column:
    """Residual of the least-squares line on the axis, by run."""
    w = Window.partitionBy(*keys)
    slope, level = F.regr_slope(F.col(value), F.col(axis)).over(w), F.regr_intercept(F.col(value), F.col(axis)).over(w)
    return F.col(value) - (level + slope * F.col(axis))


def unwrap_time(df: DataFrame, time: str, keys: Sequence[str], period: float = 86400.0, row_id: str = "row_id", into: str = "unwrapped") -> DataFrame:
    """Adds a period at each step back of more than half a period."""
    w = along(keys, [row_id])
    back = F.when(F.col(time) < F.last(time, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1)) - period / 2, 1).otherwise(0)
    out = df.withColumn("__back", back)
    return out.withColumn(into, F.col(time) + F.sum("__back").over(w.rowsBetween(Window.unboundedPreceding, 0)) * period).drop("__back")


def flight_metrics(df: DataFrame, keys: Sequence[str], x: str, y: str, time: str, value: str | None = None, order: Sequence[str] | None = None) -> DataFrame:
    """interval, spacing, speed, azimuth, turn and value_rate of each step of a line."""
    w = along(keys, order or [time, "row_id"])
    dx, dy = F.col(x) - F.lag(x).over(w), F.col(y) - F.lag(y).over(w)
    out = df.withColumn("interval", F.col(time) - F.lag(time).over(w)).withColumn("spacing", F.hypot(dx, dy)).withColumn("azimuth", azimuth(dx, dy))
    step = F.when(F.col("interval") > 0, F.col("interval"))
    out = out.withColumn("speed", F.try_divide("spacing", step)).withColumn("turn", F.abs(angle_between(F.col("azimuth"), F.lag("azimuth").over(w))))
    rate = F.try_divide(F.abs(F.col(value) - F.lag(value).over(w)), step) if value else F.lit(None).cast("double")
    return out.withColumn("value_rate", rate)


def flight_flags(df: DataFrame, keys: Sequence[str], time: str, *, order: Sequence[str] | None = None, clearance: str | None = None, max_gap: float = 0, max_spacing: float = 0, min_speed: float = 0, max_speed: float = 0, max_turn: float = 0, min_clearance: float = 0, max_clearance: float = 0, max_rate: float = 0) -> Column:
    """Bits of the failed checks of :func:`flight_metrics`; a limit of 0 is off."""
    first = F.lag("row_id").over(along(keys, order or [time, "row_id"])).isNull()
    c = F.col
    checks = [(INVALID, ~first & ~F.coalesce(c("interval") > 0, F.lit(False)))]
    if max_gap > 0:
        checks.append((TIME_GAP, c("interval") > max_gap))
    if max_spacing > 0:
        checks.append((SPACING, c("spacing") > max_spacing))
    if min_speed > 0:
        checks.append((SPEED, c("speed") < min_speed))
    if max_speed > 0:
        checks.append((SPEED, c("speed") > max_speed))
    if max_turn > 0:
        checks.append((TURN, c("turn") > max_turn))
    if clearance and min_clearance:
        checks.append((CLEARANCE, c(clearance) < min_clearance))
    if clearance and max_clearance > 0:
        checks.append((CLEARANCE, c(clearance) > max_clearance))
    if max_rate > 0:
        checks.append((VALUE_RATE, c("value_rate") > max_rate))
    return flag_bits(*checks)


def line_summary(flagged: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Samples, failures and ranges of each line; needs the metrics and ``flags``."""
    bad = F.count_if(F.col("flags") != 0)
    return flagged.groupBy(*keys).agg(
        F.count("*").alias("samples"),
        bad.alias("failed"),
        (F.lit(100.0) * (F.count("*") - bad) / F.count("*")).alias("pass_pct"),
        F.avg("speed").alias("mean_speed"),
        F.max("interval").alias("max_gap"),
        F.max("spacing").alias("max_space"),
    )


def base_quality(df: DataFrame, keys: Sequence[str], time: str, value: str, *, half: int = 5, max_gap: float = 0, spike_sigma: float = 0, max_rate: float = 0, max_drift: float = 0) -> DataFrame:
    """Base-station checks: interval, rate, local_median, residual, drift_rate and flags."""
    w, whole = along(keys, [time, "row_id"]), Window.partitionBy(*keys)
    good = is_finite(F.col(time)) & is_finite(F.col(value))
    out = add_local_spread(df, value, keys, half)
    interval = F.col(time) - F.lag(time).over(w)
    out = out.withColumn("interval", interval).withColumn("rate", F.try_divide(F.abs(F.col(value) - F.lag(value).over(w)), F.when(F.col("interval") > 0, F.col("interval"))))
    out = out.withColumn("residual", F.col(value) - F.col("local_median")).withColumn("drift_rate", F.regr_slope(F.col(value), F.col(time)).over(whole))
    # lines without a local spread fall back to the spread of the whole line
    middle = F.percentile(F.col(value), F.lit(0.5)).over(whole)
    out = out.withColumn("__off", F.abs(F.col(value) - middle))
    scale = F.when(F.col("local_sigma") > 0, F.col("local_sigma")).otherwise(F.percentile(F.col("__off"), F.lit(0.5)).over(whole) * MAD_SCALE)
    out = out.withColumn("__scale", scale)
    first = F.lag("row_id").over(w).isNull()
    checks = [(BASE_INVALID, ~good | (~first & ~F.coalesce(F.col("interval") > 0, F.lit(False))))]
    if max_gap > 0:
        checks.append((BASE_GAP, F.col("interval") > max_gap))
    if spike_sigma > 0:
        checks.append((BASE_SPIKE, (F.col("__scale") > 0) & (F.abs("residual") > F.col("__scale") * spike_sigma)))
    if max_rate > 0:
        checks.append((BASE_RATE, F.col("rate") > max_rate))
    if max_drift > 0:
        checks.append((BASE_DRIFT, good & (F.abs("drift_rate") > max_drift)))
    return out.withColumn("flags", flag_bits(*checks)).drop("__off", "__scale", "local_sigma", "local_count")


def cumulative_distance(keys: Sequence[str], x: str, y: str, order: Sequence[str] = ("row_id",)) -> Column:
    """Along the line; a step with a missing end adds nothing. The step column is named ``__step`` by :func:`add_distance`."""
    return F.sum("__step").over(along(keys, order).rowsBetween(Window.unboundedPreceding, 0))


def add_distance(df: DataFrame, keys: Sequence[str], x: str, y: str, order: Sequence[str] = ("row_id",), into: str = "distance") -> DataFrame:
    w = along(keys, order)
    step = F.coalesce(F.hypot(F.col(x) - F.lag(x).over(w), F.col(y) - F.lag(y).over(w)), F.lit(0.0))
    return df.withColumn("__step", step).withColumn(into, cumulative_distance(keys, x, y, order)).drop("__step")


def gradient(value: str, keys: Sequence[str], order: Sequence[str] = ("row_id",)) -> Column:
    """Central differences of samples, one-sided at the ends of a line."""
    w = along(keys, order)
    before, after, here = F.lag(value).over(w), F.lead(value).over(w), F.col(value)
    first, last = F.lag(F.lit(1)).over(w).isNull(), F.lead(F.lit(1)).over(w).isNull()
    return F.when(first & last, None).when(first, after - here).when(last, here - before).otherwise((after - before) / 2)


def fourth_difference(value: str, keys: Sequence[str]) -> Column:
    w = along(keys)
    return F.lag(value, 2).over(w) - F.lag(value).over(w) * 4 + F.col(value) * 6 - F.lead(value).over(w) * 4 + F.lead(value, 2).over(w)


def sta_lta(value: str, keys: Sequence[str], short: int, long: int) -> Column:
    """Ratio of the trailing mean squares of ``short`` and ``long`` samples; null until the long window is full."""
    w = along(keys)
    energy = F.pow(F.col(value), F.lit(2.0))
    sta = F.avg(energy).over(w.rowsBetween(-(short - 1), 0))
    lta_frame = w.rowsBetween(-(long - 1), 0)
    return F.when(F.count(value).over(lta_frame) == long, F.try_divide(sta, F.avg(energy).over(lta_frame)))


def first_crossing(df: DataFrame, keys: Sequence[str], ratio_col: str, threshold: float) -> DataFrame:
    """The first row of each line whose ratio reaches the threshold (null: none)."""
    hit = F.when(F.col(ratio_col) >= threshold, F.col("row_id"))
    return df.groupBy(*keys).agg(F.min(hit).alias("pick"))


def line_spacing(lines: DataFrame, x: str, y: str, azimuth_col: str, expected: float = 0.0, tolerance: float = 0.25) -> DataFrame:
    """offset across the survey azimuth (axial mean), spacing to the line before it by offset,
    and whether it is further from the nominal spacing than the tolerance. One row per line:
    the table is small (lines, not samples), so one ordered window is right here."""
    doubled = F.radians(F.col(azimuth_col) * 2)
    survey = lines.agg(F.pmod(F.degrees(F.atan2(F.avg(F.sin(doubled)), F.avg(F.cos(doubled)))) / 2, F.lit(180.0)).alias("survey_azimuth"))
    out = lines.crossJoin(F.broadcast(survey))
    out = out.withColumn("offset", F.col(x) * F.cos(F.radians("survey_azimuth")) - F.col(y) * F.sin(F.radians("survey_azimuth")))
    out = out.withColumn("spacing", F.col("offset") - F.lag("offset").over(Window.partitionBy(F.lit(1)).orderBy("offset")))
    nominal = F.lit(expected) if expected > 0 else F.percentile(F.when(F.col("spacing") > 0, F.col("spacing")), F.lit(0.5)).over(Window.partitionBy(F.lit(1)))
    out = out.withColumn("nominal", nominal)
    return out.withColumn("flag", F.coalesce(F.abs(F.col("spacing") - F.col("nominal")) > F.col("nominal") * tolerance, F.lit(False)))


def level_by_median(value: str, keys: Sequence[str], target: float | None = None) -> Column:
    """Takes off the group's median (adds ``target``)."""
    m = F.percentile(F.col(value), F.lit(0.5)).over(Window.partitionBy(*keys))
    return F.col(value) - m + (target or 0.0)


def level_by_background(value: str, keys: Sequence[str], low: float, high: float, kind: str = "mean") -> Column:
    """Takes off the mean or median of the group's values from ``low`` to ``high``."""
    w = Window.partitionBy(*keys)
    inside = F.when(F.col(value).between(low, high), F.col(value))
    return F.col(value) - (F.avg(inside).over(w) if kind == "mean" else F.percentile(inside, F.lit(0.5)).over(w))


def trajectory(df: DataFrame, hole: str, depth: str, inclination: str, azimuth_col: str) -> DataFrame:
    """Minimum-curvature path of each hole: east, north, tvd from its collar."""
    w = along([hole], [depth])
    i1, i2 = F.radians(F.lag(inclination).over(w)), F.radians(inclination)
    a1, a2 = F.radians(F.lag(azimuth_col).over(w)), F.radians(azimuth_col)
    cosine = F.cos(i2 - i1) - F.sin(i1) * F.sin(i2) * (1 - F.cos(a2 - a1))
    out = df.withColumn("__beta", F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), cosine))))
    out = out.withColumn("__half", (F.col(depth) - F.lag(depth).over(w)) / 2 * F.when(F.col("__beta") <= 1e-7, 1.0).otherwise(F.tan(F.col("__beta") / 2) * 2 / F.col("__beta")))
    parts = {
        "north": F.sin(i1) * F.cos(a1) + F.sin(i2) * F.cos(a2),
        "east": F.sin(i1) * F.sin(a1) + F.sin(i2) * F.sin(a2),
        "tvd": F.cos(i1) + F.cos(i2),
    }
    for name, direction in parts.items():
        out = out.withColumn(f"__{name}", F.coalesce(F.col("__half") * direction, F.lit(0.0)))
    running = w.rowsBetween(Window.unboundedPreceding, 0)
    for name in parts:
        out = out.withColumn(name, F.sum(f"__{name}").over(running))
    return out.drop("__beta", "__half", "__north", "__east", "__tvd")


def growing_ratio(df: DataFrame, keys: Sequence[str], channels: Sequence[str], thresholds: Sequence[float], max_radius: int, row_id: str = "row_id") -> DataFrame:
    """For each row the least radius (at most ``max_radius``) whose window of its run has sums of all
    channels at their thresholds, with those sums. ``keys`` name the run. Prefix sums at
    all radii are compared; null where none reaches."""
    w = along(keys, [row_id])
    tries = []
    for r in range(max_radius + 1):
        frame = w.rowsBetween(-r, r)
        sums = [F.sum(c).over(frame) for c in channels]
        reached = sums[0] >= thresholds[0]
        for s, t in zip(sums[1:], thresholds[1:]):
            reached = reached & (s >= t)
        tries.append(F.when(reached, F.struct(F.lit(r).alias("radius"), F.count("*").over(frame).alias("samples"), *[s.alias(f"sum_{c}") for s, c in zip(sums, channels)])))
    return df.withColumn("__grown", F.coalesce(*tries)).select("*", "__grown.*").drop("__grown")
