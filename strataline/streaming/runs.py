"""Structured Streaming on survey samples and events.

Built-in event-time windows and sessions with watermarks where they express the
operator; :func:`moving_mean` keeps the open run of each line as state.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def tumbling(df: DataFrame, time: str, width: str, late: str, keys: list[str], *aggregates: Column) -> DataFrame:
    """Totals by window; rows later than ``late`` are dropped by the watermark."""
    return df.withWatermark(time, late).groupBy(F.window(time, width), *keys).agg(*aggregates)


def sessions(df: DataFrame, time: str, gap: str, late: str, keys: list[str], *aggregates: Column) -> DataFrame:
    """Runs of each key without a gap of ``gap`` or more."""
    return df.withWatermark(time, late).groupBy(F.session_window(time, gap), *keys).agg(*aggregates)


def distinct_events(df: DataFrame, time: str, late: str, keys: list[str]) -> DataFrame:
    return df.withWatermark(time, late).dropDuplicatesWithinWatermark(keys)


def interval_join(left: DataFrame, right: DataFrame, key: str, left_time: str, right_time: str, seconds: int, late: str) -> DataFrame:
    """Rows of both streams with one key whose times differ by at most ``seconds``."""
    l, r = left.withWatermark(left_time, late), right.withWatermark(right_time, late)  # noqa: E741
    near = (l[left_time] >= r[right_time] - F.expr(f"interval {seconds} seconds")) & (l[left_time] <= r[right_time] + F.expr(f"interval {seconds} seconds"))
    return l.join(r, (l[key] == r[key]) & near).drop(r[key])


def moving_mean(df: DataFrame, key: str, row_id: str, value: str, width: int, max_gap: int | None = None) -> DataFrame:
    """Centred means of complete windows within runs of each line, as rows arrive. State: the last
    ``width`` - 1 rows of the open run. A row that isn't after the line's last one is an error; a missing
    value or a step of row ids over ``max_gap`` ends the run. Results come width // 2 rows late."""
    kind = df.schema[key].dataType.simpleString()

    def step(k: tuple, pdfs: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        ids, values, last = state.get if state.exists else ([], [], None)
        ids, values, out = list(ids), list(values), []
        for pdf in pdfs:
            for i, v in pdf.sort_values(row_id)[[row_id, value]].itertuples(index=False):
                if last is not None and i <= last:
                    raise ValueError(f"row {i} of line {k[0]} comes after row {last}")
                if pd.isna(v) or (max_gap is not None and ids and i - ids[-1] > max_gap):
                    ids, values = [], []
                last = int(i)
                if pd.isna(v):
                    continue
                ids.append(int(i))
                values.append(float(v))
                if len(ids) == width:
                    out.append((k[0], ids[width // 2], sum(values) / width))
                    ids, values = ids[1:], values[1:]
        state.update((ids, values, last))
        yield pd.DataFrame(out, columns=[key, row_id, "mean"])

    return df.groupBy(key).applyInPandasWithState(step, f"{key} {kind}, {row_id} long, mean double", "ids array<long>, vals array<double>, last long", "append", GroupStateTimeout.NoTimeout)
