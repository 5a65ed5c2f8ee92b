"""A small safe formula language over channels: ``c('mag') - c('base')``.

Grammar: numbers, ``c('name')``, + - * /, unary signs, ``**`` with a whole constant
from 0 to 16, parentheses, and abs, sqrt, log10 of one argument. A formula has at least
one channel, at most 2048 characters and 128 parts. Nothing is evaluated by
Python; a formula becomes one Spark expression. A result that isn't finite is null.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, functions as F

from .numbers import finite

MAX_LENGTH, MAX_PARTS, MAX_POWER = 2048, 128, 16
FUNCTIONS = {"abs": F.abs, "sqrt": lambda x: F.sqrt(F.when(x >= 0, x)), "log10": lambda x: F.log10(F.when(x > 0, x))}
_TOKEN = re.compile(r"\s*(?:(\d+\.?\d*(?:[eE][+-]?\d+)?|\.\d+(?:[eE][+-]?\d+)?)|(\*\*|[-+*/()])|([A-Za-z_][A-Za-z_0-9]*)|('[^'\\]*'|\"[^\"\\]*\"))")


class FormulaError(ValueError):
    pass


class _Parser:
    """Recursive descent; precedence from low to high: + -, * /, signs, **."""

    def __init__(self, text: str):
        if len(text) > MAX_LENGTH:
            raise FormulaError(f"a formula has at most {MAX_LENGTH} characters")
        self.tokens: list[tuple[int, str]] = []
        at, end = 0, len(text.rstrip())
        while at < end:
            m = _TOKEN.match(text, at)
            if not m:
                raise FormulaError(f"unexpected character at {at}: {text[at]!r}")
            self.tokens.append((m.lastindex, m[m.lastindex]))
            at = m.end()
        self.at = self.parts = 0
        self.channels: dict[str, None] = {}

    def peek(self) -> str:
        return self.tokens[self.at][1] if self.at < len(self.tokens) and self.tokens[self.at][0] == 2 else ""

    def take(self, kind: int, value: str | None = None) -> str:
        if self.at >= len(self.tokens) or self.tokens[self.at][0] != kind or value not in (None, self.tokens[self.at][1]):
            found = self.tokens[self.at][1] if self.at < len(self.tokens) else "the end"
            raise FormulaError(f"expected {value or 'something else'}, found {found}")
        self.at += 1
        return self.tokens[self.at - 1][1]

    def count(self) -> None:
        self.parts += 1
        if self.parts > MAX_PARTS:
            raise FormulaError(f"a formula has at most {MAX_PARTS} parts")

    def whole(self) -> Column:
        out = self.sum()
        if self.at < len(self.tokens):
            raise FormulaError(f"unexpected {self.tokens[self.at][1]!r}")
        if not self.channels:
            raise FormulaError("a formula has at least one channel")
        return out

    def sum(self) -> Column:
        left = self.product()
        while self.peek() in ("+", "-"):
            sign, right = self.take(2), None
            right = self.product()
            self.count()
            left = left + right if sign == "+" else left - right
        return left

    def product(self) -> Column:
        left = self.signed()
        while self.peek() in ("*", "/"):
            sign = self.take(2)
            right = self.signed()
            self.count()
            left = left * right if sign == "*" else F.try_divide(left, right)
        return left

    def signed(self) -> Column:
        if self.peek() in ("+", "-"):
            sign = self.take(2)
            self.count()
            inner = self.signed()
            return inner if sign == "+" else -inner
        return self.power()

    def power(self) -> Column:
        base = self.atom()
        if self.peek() == "**":
            self.take(2)
            exponent = self.take(1)
            self.count()
            if not exponent.isdigit() or int(exponent) > MAX_POWER:
                raise FormulaError(f"an exponent is a whole number from 0 to {MAX_POWER}")
            return F.pow(base, F.lit(float(exponent)))
        return base

    def atom(self) -> Column:
        self.count()
        if self.at >= len(self.tokens):
            raise FormulaError("a formula ends too early")
        kind, value = self.tokens[self.at]
        if kind == 1:
            self.at += 1
            return F.lit(float(value))
        if value == "(":
            self.at += 1
            out = self.sum()
            self.take(2, ")")
            return out
        name = self.take(3)
        self.take(2, "(")
        if name == "c":
            channel = self.take(4)[1:-1]
            self.take(2, ")")
            self.channels[channel] = None
            return F.col(f"`{channel.replace('`', '``')}`").cast("double")
        if name not in FUNCTIONS:
            raise FormulaError(f"unknown function {name!r}")
        inner = self.sum()
        self.take(2, ")")
        return FUNCTIONS[name](inner)


def compile_formula(text: str) -> tuple[Column, list[str]]:
    """(the expression, the channels it reads)."""
    parser = _Parser(text)
    return finite(parser.whole()), list(parser.channels)
