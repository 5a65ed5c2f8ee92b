"""Operations by name and recipes of them.

A recipe is a list of steps ``{"operation": name, "parameters": {...}}``; a parameter
``{"$result": k}`` is the table of an earlier step, ``{"$input": name}`` a given one. All steps make
one lazy plan. Consecutive Fourier filters with the same preparation are fused: one
forward and one inverse transform for all of them.
"""

from __future__ import annotations

import inspect
from collections.abc import Callable

from pyspark.sql import DataFrame

from ..functions.digest import tree_digest
from ..operators import grids, joins, lines, models, solve, stats, tracks
from .catalogue import OPERATIONS

MAX_STEPS = 16
_MODULES = (grids, joins, lines, models, solve, stats, tracks)


def operations() -> dict[str, Callable]:
    """name -> function of the operator modules, named module.function, and of the catalogue, by its domain names."""
    out = dict(OPERATIONS)
    for m in _MODULES:
        short = m.__name__.rpartition(".")[2]
        for n, f in inspect.getmembers(m, inspect.isfunction):
            if f.__module__ == m.__name__ and not n.startswith("_"):
                out[f"{short}.{n}"] = f
    return out


def describe(name: str) -> dict[str, str]:
    f = operations()[name]
    return {"name": name, "signature": str(inspect.signature(f)), "about": inspect.getdoc(f) or ""}


TRANSFERS = {n: getattr(grids, n) for n in ("derivative", "continuation", "downward", "butterworth", "gaussian", "ideal", "cosine_rolloff", "directional", "microlevel", "integration", "field_transform", "pseudogravity", "airy_flexure")}


def _check(steps: list[dict]) -> None:
    if not 1 <= len(steps) <= MAX_STEPS:
        raise ValueError(f"a recipe has 1 to {MAX_STEPS} steps")
    known = operations()
    for i, s in enumerate(steps):
        if s["operation"] not in known and s["operation"] != "fft":
            raise ValueError(f"unknown operation {s['operation']!r}")
        for v in s.get("parameters", {}).values():
            if isinstance(v, dict) and "$result" in v and not 0 <= v["$result"] < i:
                raise ValueError("a result comes from an earlier step")


def fused(steps: list[dict]) -> list[dict]:
    """``fft`` steps ({"filter", "arguments"} and preparation) that follow each other on the same chain become one with a list of filters."""
    out: list[dict] = []
    where: dict[int, int] = {}
    for i, s in enumerate(steps):
        p = dict(s.get("parameters", {}))
        source = p.get("cells")
        mine = {k: v for k, v in p.items() if k not in ("cells", "filter", "arguments")}
        last = out[-1] if out else None
        if s["operation"] == "fft" and last and last["operation"] == "fft" and source == {"$result": i - 1} and last["preparation"] == mine and not any({"$result": i - 1} in t.get("parameters", {}).values() for t in steps[i + 1 :]):
            last["filters"].append((p["filter"], p.get("arguments", [])))
        elif s["operation"] == "fft":
            out.append({"operation": "fft", "cells": source, "filters": [(p["filter"], p.get("arguments", []))], "preparation": mine})
        else:
            out.append({"operation": s["operation"], "parameters": p})
        where[i] = len(out) - 1
    for s in out:
        s["where"] = where
    return out


def provenance(steps: list[dict], versions: dict[str, str]) -> dict:
    """What a result came from: its steps, the versions of its inputs, and the digest of both."""
    tree = {"steps": steps, "versions": versions}
    return tree | {"digest": tree_digest(tree)}


def run(steps: list[dict], inputs: dict[str, DataFrame], *, versions: dict[str, str] | None = None, expected: dict[str, str] | None = None) -> DataFrame:
    """The last step's table. ``expected`` are the versions of the inputs that the recipe was made for: it is refused where
    ``versions``, those at hand, differ."""
    _check(steps)
    stale = sorted(n for n, v in (expected or {}).items() if (versions or {}).get(n) != v)
    if stale:
        raise ValueError(f"other versions of the inputs than the recipe's: {stale}")
    known, results = operations(), []

    def resolve(v, where):
        if isinstance(v, dict) and "$result" in v:
            got = results[where[v["$result"]]]
            return got
        return inputs[v["$input"]] if isinstance(v, dict) and "$input" in v else v

    for s in fused(steps):
        if s["operation"] == "fft":
            cells = resolve(s["cells"], s["where"])
            if "filtered" in cells.columns:
                cells = cells.drop("z").withColumnRenamed("filtered", "z")
            results.append(grids.fft_filter(cells, [TRANSFERS[n](*a) for n, a in s["filters"]], **s["preparation"]))
        else:
            results.append(known[s["operation"]](**{k: resolve(v, s["where"]) for k, v in s["parameters"].items()}))
    return results[-1]
