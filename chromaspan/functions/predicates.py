"""Segment predicates and states, as column expressions."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce
from math import log2

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def spurious(n_markers: Column, least: int) -> Column:
    return n_markers < least


def small(start: Column, end: Column, least: int) -> Column:
    return end - start + 1 < least


def is_aberrant(state: Column, reference: float, deviation: float) -> Column:
    """At the deviation or beyond, on either side; a missing number isn't."""
    return ((state <= reference - deviation) | (state >= reference + deviation)) & ~F.isnan(state.cast("double"))


#: The filter's traditional name, though it is the aberrant segments that it flags.
balanced = is_aberrant


def total(state: Column) -> Column:
    """An allele pair counts by its sum."""
    return state["a"] + state["b"]


def chain(flags: list[Column], inverse: bool = False) -> Column:
    """Whether a row goes: all flags, or, inverted, not all of them."""
    f = reduce(lambda a, b: a & b, flags)
    return ~f if inverse else f


def ensure_log_scale(raw: DataFrame) -> DataFrame:
    """raw as it is, if it has finite values below and above zero; an error else."""
    fine = F.col("value").isNotNull() & ~F.isnan("value") & (F.abs("value") < float("inf"))
    low, high = raw.filter(fine).agg(F.max(F.col("value") < 0), F.max(F.col("value") > 0)).first()
    if not (low and high):
        raise ValueError("values are not on a log scale: some below and some above zero are needed")
    return raw


@dataclass(frozen=True)
class StateThresholds:
    gain: float = 0.2
    loss: float = -0.2
    gain_high: float = log2(5 / 2)
    loss_high: float = log2(0.7 / 2)
    gain_size: int = 12_000_000
    loss_size: int = 12_000_000


def state_score(state: Column, start: Column, end: Column, t: StateThresholds = StateThresholds()) -> Column:
    """-3 to 3: one for passing the threshold, one more if shorter than the size limit, one more if beyond the high threshold too."""
    size = end - start + 1

    def steps(passes: Column, short: Column, high: Column) -> Column:
        return F.when(passes, F.when(short, F.when(high, 3).otherwise(2)).otherwise(1)).otherwise(0)

    return F.when(state > 0, steps(state > t.gain, size < t.gain_size, state > t.gain_high)).otherwise(-steps(state < t.loss, size < t.loss_size, state < t.loss_high))


def colour(value: Column, limit: float = 0.2) -> Column:
    return F.when(value > limit, "red").when(value < -limit, "blue").otherwise("grey")


def log_ratio(y: Column) -> Column:
    return F.log2(y / 2)


def label_state(c: Column) -> Column:
    return F.when(F.contains(c, F.lit("Amplification")), 1).when(F.contains(c, F.lit("Deletion")), -1).otherwise(0)
