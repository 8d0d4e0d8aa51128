"""Overlap of closed intervals and its scores, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def overlaps(s1: Column, e1: Column, s2: Column, e2: Column) -> Column:
    return (s1 <= e2) & (s2 <= e1)


def intersection(s1: Column, e1: Column, s2: Column, e2: Column) -> Column:
    return F.greatest(F.least(e1, e2) - F.greatest(s1, s2) + 1, F.lit(0))


def score(kind: str, qs: Column, qe: Column, rs: Column, re: Column) -> Column:
    """How much a query and a reference interval overlap: a share of the reference, the query, their union, the longer
    (min), the shorter (max), or twice the intersection over both lengths (dice); in double precision."""
    i, q, r = intersection(qs, qe, rs, re), qe - qs + 1, re - rs + 1
    over = {"reference": r, "query": q, "union": q + r - i, "min": F.greatest(q, r), "max": F.least(q, r)}
    return (2 * i) / (q + r).cast("double") if kind == "dice" else i / over[kind].cast("double")


def start_bounds(kind: str, t: float, qs: Column, qe: Column, rs: Column, re: Column) -> Column:
    """A condition that every pair with a score of t or more meets, and that is cheaper to test."""
    q, r = (qe - qs + 1).cast("double"), (re - rs + 1).cast("double")
    if t <= 0:
        return F.lit(True)
    if kind == "dice":
        return (rs >= qs - 2 * (1 - t) / t * q) & (rs <= qs + 2 * (1 - t) / (2 - t) * q)
    if kind in ("union", "min"):
        return (r >= t * q) & (q >= t * r)
    return {"reference": q >= t * r, "query": r >= t * q}.get(kind, F.lit(True))
