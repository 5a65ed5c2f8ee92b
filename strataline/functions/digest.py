"""Digests: of typed parameter trees, and of tables whatever the order of their rows."""

from __future__ import annotations

import hashlib
import json
import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F


def _typed(value: object) -> object:
    if value is None or isinstance(value, (bool, str)):
        return [type(value).__name__, value]
    if isinstance(value, int):
        return ["int", str(value)]
    if isinstance(value, float):
        if not math.isfinite(value):
            raise ValueError("a number that isn't finite has no digest")
        return ["float", value.hex()]
    if isinstance(value, dict):
        if not all(isinstance(k, str) for k in value):
            raise ValueError("keys are text")
        return ["dict", [[k, _typed(value[k])] for k in sorted(value)]]
    if isinstance(value, (list, tuple)):
        return ["list", [_typed(v) for v in value]]
    raise ValueError(f"a tree has no {type(value).__name__}")


def tree_digest(value: object) -> str:
    """SHA-256 of a tree of null, booleans, text, numbers, lists and dicts: 1, 1.0, True and "1" differ, the order of keys doesn't count."""
    return hashlib.sha256(json.dumps(_typed(value), separators=(",", ":"), ensure_ascii=True).encode()).hexdigest()


def row_digest(columns: Sequence[str]) -> Column:
    """60 bits of the MD5 of a row's columns as text (null as a zero character), as a long."""
    text = F.concat_ws("\x1f", *[F.coalesce(F.col(c).cast("string"), F.lit("\x00")) for c in columns])
    return F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("long")


def table_digest(df: DataFrame, columns: Sequence[str], keys: Sequence[str] = ()) -> DataFrame:
    """(keys, rows, digest): one partial sum a task, whatever the order of the rows. Equal pairs of rows cancel in the digest, so compare the counts too."""
    return df.groupBy(*keys).agg(F.count("*").alias("rows"), F.bit_xor(row_digest(columns)).alias("digest"))
