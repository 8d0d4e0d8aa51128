"""Allele pairs: structs (a, b) as values, compared and combined as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def pair(a: Column, b: Column) -> Column:
    return F.struct(a.alias("a"), b.alias("b"))


def added(x: Column, y: Column) -> Column:
    return pair(x["a"] + y["a"], x["b"] + y["b"])


def scaled(x: Column, factor: float) -> Column:
    return pair(x["a"] * factor, x["b"] * factor)


def difference(x: Column, y: Column) -> Column:
    """Absolute differences of either component."""
    return pair(F.abs(x["a"] - y["a"]), F.abs(x["b"] - y["b"]))


def near(x: Column, y: Column, epsilon: float = 0.0) -> Column:
    """Whether both components are equal, to epsilon."""
    return (F.abs(x["a"] - y["a"]) <= epsilon) & (F.abs(x["b"] - y["b"]) <= epsilon)


def apart(x: Column, y: Column, epsilon: float = 0.0) -> Column:
    """Whether either component differs by more than epsilon."""
    return ~near(x, y, epsilon)


def at_most(x: Column, limit: float) -> Column:
    """A pair is compared with a number by its total."""
    return x["a"] + x["b"] <= limit


def at_least(x: Column, limit: float) -> Column:
    return x["a"] + x["b"] >= limit
