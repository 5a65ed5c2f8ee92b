"""Names and numbers in survey text files."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

_ACCENTS = ("áàâäãéèêëíìîïóòôöõúùûüñç", "aaaaaeeeeiiiiooooouuuunc")


def role_key(name: Column) -> Column:
    """Lower case, without accents, letters and digits only."""
    return F.regexp_replace(F.translate(F.lower(F.trim(name)), *_ACCENTS), "[^a-z0-9]", "")


def line_kind(name: Column) -> Column:
    """``tie`` for names that begin with T or TL, ``traverse`` for L or FL, else ``other``."""
    n = F.upper(F.trim(name))
    return F.when(n.rlike("^TL?"), "tie").when(n.rlike("^F?L"), "traverse").otherwise("other")


def trailing_number(name: Column) -> Column:
    return F.regexp_extract(name, "([0-9]+)$", 1).try_cast("bigint")


def strict_long(text: Column) -> Column:
    """Null unless the whole text is a decimal integer in range."""
    return F.when(text.rlike("^[+-]?[0-9]+$"), text.try_cast("bigint"))


def strict_double(text: Column, decimal_comma: bool = False) -> Column:
    """Null unless the whole text is a decimal number (no thousands, no infinities)."""
    t = F.replace(text, F.lit(","), F.lit(".")) if decimal_comma else text
    return F.when(t.rlike(r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"), t.try_cast("double"))


def iso_seconds(text: Column) -> Column:
    return F.unix_micros(F.try_to_timestamp(text)) / 1e6
