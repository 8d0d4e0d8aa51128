"""Scans along chromosomes with carries between bins, and bins with a halo of their neighbours' rows.

A scan's rows are dealt into bins by key and position. What the bins before (or behind) hand on comes from a summary
row for each bin, and stands in an extra row at the begin of the bin, so that a window over (key, bin) sees it as its
first row. Only summaries meet by key: as positions are bounded, a key has at most (length of a chromosome) / (width of
a bin) of them, however many rows there are.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from operator import and_

import pandas as pd
from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

BIN = 20_000
Handed = dict[str, Column]


def _binned(df: DataFrame, order: list[str], width: int) -> DataFrame:
    return df.withColumn("_bin", F.expr(f"`{order[0]}` div {width}"))


def deal(df: DataFrame, keys: list[str], order: list[str], width: int = BIN) -> DataFrame:
    """df with _bin, dealt to tasks by key and bin. Scans of such rows (`dealt`) keep _bin and leave the rows where they
    are: a bin's summary is made by the task that has the bin, and only summaries are shuffled."""
    return _binned(df, order, width).repartition(*keys, "_bin")


def headed(rows: DataFrame, extra: DataFrame, keys: list[str], order: list[str]) -> tuple[DataFrame, WindowSpec]:
    """rows (_own is 1) and the bins' extra rows (_own is 0), and a bin's window, in which its extra row is the first.
    Where both come by key and bin (see deal), they stay where they are."""
    both = rows.withColumn("_own", F.lit(1)).unionByName(extra.withColumn("_own", F.lit(0)), allowMissingColumns=True)
    return both, Window.partitionBy(*keys, "_bin").orderBy("_own", *order)


def scanned(
    df: DataFrame, keys: list[str], order: list[str], each: dict[str, Column], handed: dict[str, Callable[[WindowSpec, WindowSpec], Column]],
    result: dict[str, Callable[[WindowSpec, WindowSpec, Handed], Column]], width: int = BIN, dealt: bool = False, of_key: DataFrame | None = None,
) -> DataFrame:
    """df with the columns of `result`; order: the position, then what breaks its ties. dealt: df comes from deal() or
    from a scan of such rows, by the same keys, place and width. of_key: a row for each value of one or more of the keys'
    columns; its other columns are handed on, too, so that only summaries are joined with it.

    each: aggregates over a bin's rows. handed: of the summaries, by two windows: the bins before, and all of the key's;
    later ones may use earlier ones by name. result: of the rows, by two windows over the bin's extra row and its rows
    in order: without a frame, and up to each row; and of what was handed on. In the extra row _own is 0 (else 1) and
    df's columns are null, so sums and averages pass over it. Null keys are keys, a null position stands first.
    """
    rows = df if dealt else _binned(df, order, width)
    by_key = Window.partitionBy(*keys)
    before = by_key.orderBy("_bin").rowsBetween(Window.unboundedPreceding, -1)
    bins = rows.groupBy(*keys, "_bin").agg(*(c.alias(n) for n, c in each.items()))
    if of_key is not None:
        of, new = [k for k in keys if k in of_key.columns], [c for c in of_key.columns if c not in keys]
        bins = bins.join(of_key.withColumnsRenamed({k: f"_of_{k}" for k in of}), reduce(and_, (F.col(k).eqNullSafe(F.col(f"_of_{k}")) for k in of)), "left")
        handed, result = handed | {c: (lambda *_, c=c: F.col(c)) for c in new}, result | {c: (lambda _, __, given, c=c: given[c]) for c in new}
    for n, f in handed.items():
        bins = bins.withColumn(n, f(before, by_key))
    extra = bins.select(*keys, "_bin", F.struct(*handed).alias("_handed"))
    both, place = headed(rows, extra.repartition(*keys, "_bin") if dealt else extra, keys, order)
    upto = place.rowsBetween(Window.unboundedPreceding, 0)
    given = {n: F.first(F.col("_handed")[n]).over(upto) for n in handed}
    out = both.withColumns({n: f(place, upto, given) for n, f in result.items()})
    return out.filter("_own = 1").drop("_own", "_handed", *([] if dealt else ["_bin"]))


def _zero(c: Column) -> Column:
    return F.coalesce(c, F.lit(0))


def lagged(df: DataFrame, keys: list[str], order: list[str], columns: dict[str, str], exists: str = "_lagged", width: int = BIN, dealt: bool = False) -> DataFrame:
    """df with each column's value in the row before, by its new name, and whether there is such a row.

    Carry: a bin's last row.
    """
    each = {"_tail": F.max_by(F.struct(*columns), F.struct(*order))}
    handed = {"_last": lambda before, _: F.last("_tail").over(before), "_bins": lambda before, _: F.count(F.lit(1)).over(before)}

    def lag(n: str):
        return lambda place, _, given: F.when(F.lag("_own").over(place) == 0, given["_last"][n]).otherwise(F.lag(n).over(place))

    there = lambda place, _, given: (F.lag("_own").over(place) == 1) | (given["_bins"] > 0)
    return scanned(df, keys, order, each, handed, {new: lag(n) for n, new in columns.items()} | {exists: there}, width, dealt)


def prefix(df: DataFrame, keys: list[str], order: list[str], sums: dict[str, Column] | None = None, count: str | None = None, totals: dict[str, Column] | None = None, width: int = BIN, **dealt) -> DataFrame:
    """df with the sums of columns over all rows up to each, and the number of rows; nulls are passed over, a sum of no
    values is null. totals: sums over all rows of the key, handed on to each bin as well. dealt: as in scanned().

    Carry: the bins' sums.
    """
    sums, totals = sums or {}, totals or {}
    d = df.withColumns({f"_s_{n}": c for n, c in sums.items()} | {f"_t_{n}": c for n, c in totals.items()})
    each = {f"_sum_{n}": F.sum(f"_s_{n}") for n in sums} | {f"_total_{n}": F.sum(f"_t_{n}") for n in totals} | {"_rows": F.count(F.lit(1))}
    handed = {f"_all_{n}": (lambda before, _, n=n: F.sum(f"_sum_{n}").over(before)) for n in sums}
    handed |= {f"_whole_{n}": (lambda _, whole, n=n: F.sum(f"_total_{n}").over(whole)) for n in totals}
    handed["_earlier"] = lambda before, _: _zero(F.sum("_rows").over(before))

    def added(n: str):
        def f(_, upto, given):
            own, earlier = F.sum(f"_s_{n}").over(upto), given[f"_all_{n}"]
            return F.coalesce(own + earlier, own, earlier)

        return f

    result = {n: added(n) for n in sums} | {n: (lambda _, __, given, n=n: given[f"_whole_{n}"]) for n in totals}
    if count:
        result[count] = lambda _, upto, given: F.sum("_own").over(upto) + given["_earlier"]
    return scanned(d, keys, order, each, handed, result, width, **dealt).drop(*(f"_s_{n}" for n in sums), *(f"_t_{n}" for n in totals))


def moments(df: DataFrame, keys: list[str], order: list[str], value: str, width: int = BIN) -> DataFrame:
    """df with _n, _mean and _m2: of the values up to each row their number, mean and sum of squared deviations.

    Carry: the three for all bins before, joined as two groups are: nothing is squared that isn't a difference of means.
    """
    v = F.col(value)
    each = {"_cn": F.count(v), "_cm": F.coalesce(F.avg(v), F.lit(0.0)), "_c2": _zero(F.var_pop(v) * F.count(v))}
    handed = {
        "_middle": lambda _, whole: F.coalesce(F.sum(F.col("_cn") * F.col("_cm")).over(whole) / F.nullif(F.sum("_cn").over(whole), F.lit(0)), F.lit(0.0)),
        "_n0": lambda before, _: _zero(F.sum("_cn").over(before)),
        "_d0": lambda before, _: F.coalesce(F.sum(F.col("_cn") * (F.col("_cm") - F.col("_middle"))).over(before) / F.nullif(F.col("_n0"), F.lit(0)), F.lit(0.0)),
        "_q0": lambda before, _: _zero(F.sum(F.col("_c2") + F.col("_cn") * (F.col("_cm") - F.col("_middle")) ** 2).over(before)) - F.col("_n0") * F.col("_d0") ** 2,
    }
    own = {"_own_n": lambda _, upto, __: F.count(v).over(upto), "_own_m": lambda _, upto, __: F.avg(v).over(upto), "_own_2": lambda _, upto, __: F.var_pop(v).over(upto)}
    out = scanned(df, keys, order, each, handed, own | {n: (lambda _, __, given, n=n: given[n]) for n in ("_middle", "_n0", "_d0", "_q0")}, width)
    n, apart = F.col("_own_n") + F.col("_n0"), _zero(F.col("_own_m") - F.col("_middle") - F.col("_d0"))
    mean = F.when(n > 0, F.col("_middle") + F.col("_d0") + apart * F.col("_own_n") / n)
    m2 = _zero(F.col("_own_2") * F.col("_own_n")) + F.greatest("_q0", F.lit(0.0)) + F.when(n > 0, apart * apart * F.col("_n0") * F.col("_own_n") / n).otherwise(0.0)
    return out.withColumns({"_n": n, "_mean": mean, "_m2": m2}).drop("_own_n", "_own_m", "_own_2", "_middle", "_n0", "_d0", "_q0")


def changes(df: DataFrame, keys: list[str], order: list[str], columns: list[str], same: Callable[[Column, Column], Column], new: str = "_new", width: int = BIN, dealt: bool = False) -> DataFrame:
    """df with a flag (1 or 0) where any of the columns isn't the same as in the row before, or there is none."""
    names = {c: f"_lag{k}" for k, c in enumerate(columns)}
    d = lagged(df, keys, order, names, width=width, dealt=dealt)
    alike = reduce(and_, (same(F.col(n), F.col(c)) for c, n in names.items()))
    return d.withColumn(new, (~(F.col("_lagged") & alike)).cast("long")).drop("_lagged", *names.values())


def halo(df: DataFrame, keys: list[str], order: list[str], reach: int, rows: int = 100_000, width: int = BIN, **dealt) -> DataFrame:
    """Rows of df in bins of `rows` rows by their place (_i, from 0) in the key, each bin with copies of the `reach` rows
    before and behind it: adds _i, _part and _inner (false for copies). What looks no further than `reach` rows can be
    computed by (keys, _part). `reach` is at most `rows`. dealt: as in scanned()."""
    if reach > rows:
        raise ValueError(f"a reach of {reach} rows is beyond a bin of {rows}")
    d = prefix(df, keys, order, count="_i", width=width, **dealt).withColumn("_i", F.col("_i") - 1).drop("_bin")
    at = F.expr(f"_i % {rows}")
    own = F.expr(f"_i div {rows}")
    parts = F.array_compact(F.array(own, F.when(at < reach, own - 1), F.when(at >= rows - reach, own + 1)))
    return d.withColumn("_part", F.explode(F.filter(parts, lambda x: x >= 0))).withColumn("_inner", F.col("_part") == own)


def by_halo(df: DataFrame, keys: list[str], order: list[str], reach: int, f: Callable[[pd.DataFrame], pd.DataFrame], schema, rows: int = 100_000, width: int = BIN, **dealt) -> DataFrame:
    """f over each bin's rows with its halo, in order; f's result has a row for each of them, of which the bin's own stay.
    dealt: as in scanned()."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("_i", ignore_index=True)
        return f(pdf)[pdf["_inner"].to_numpy()]

    return halo(df, keys, order, reach, rows, width, **dealt).groupBy(*keys, "_part").applyInPandas(run, schema)
