"""Registered queries: each operator on the given tables, with the SQL that gives the same rows."""

from . import fields, lines, relations, scalars, shapes, soundings, tracks  # noqa: F401
from .registry import ORACLE, QUERIES

__all__ = ["ORACLE", "QUERIES"]
