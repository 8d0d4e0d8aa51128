"""Statistics and positional summaries."""

from __future__ import annotations

import warnings
from functools import cache, reduce
from operator import and_
from statistics import NormalDist

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import scan


def _same(keys: list[str]) -> Column:
    """Equal keys, nulls included, of a side whose keys are called _of0, _of1 and so on."""
    return reduce(and_, (F.col(k).eqNullSafe(F.col(f"_of{i}")) for i, k in enumerate(keys)))


def variance(c: str, sample: bool = True) -> Column:
    """0 for fewer than two values."""
    return F.coalesce(F.var_samp(c) if sample else F.var_pop(c), F.lit(0.0))


def running(df: DataFrame, keys: list[str], order: list[str], value: str, width: int = scan.BIN) -> DataFrame:
    """Mean, standard deviations and variance of all values up to each row."""
    d = scan.moments(df, keys, order, value, width)
    n, m2 = F.col("_n"), F.col("_m2")
    over = lambda by: F.when(n > 0, F.coalesce(m2 / F.nullif(by, F.lit(0)), F.lit(0.0)))
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    return d.withColumns({"run_mean": F.col("_mean"), "run_sd": zero(F.sqrt(over(n - 1))), "run_psd": F.sqrt(over(n)), "run_var": zero(over(n - 1))}).drop("_n", "_mean", "_m2")


def differences(df: DataFrame, keys: list[str], order: list[str], value: str, width: int = scan.BIN, dealt: bool = False) -> DataFrame:
    return scan.lagged(df, keys, order, {value: "_before"}, width=width, dealt=dealt).withColumn("diff", F.col(value) - F.col("_before")).drop("_before", "_lagged")


def datum_variance(df: DataFrame, keys: list[str], order: list[str], value: str) -> DataFrame:
    """Half the variance of adjacent differences."""
    return differences(df, keys, order, value).groupBy(*keys).agg((variance("diff") / 2).alias("datum_var"))


@cache
def inflation(trim: float, cells: int = 10_000) -> float:
    """What variance gains when the outer `trim` on either side of a normal distribution is left out."""
    n = NormalDist()
    a = n.inv_cdf(1 - trim)
    h = 2 * a / cells
    mids = (-a + h * (k + 0.5) for k in range(cells))
    return 1 / (sum(x * x * n.pdf(x) for x in mids) * h / (1 - 2 * trim))


def trimmed_squares(sizes: DataFrame, keys: list[str], trim: float) -> DataFrame:
    """(keys, _variance) of absolute differences (keys, a), without the largest of them: half their mean square, inflated
    for what was trimmed. Equal ones are counted; the others are ranked within cells of size (32 for each doubling), of
    which a key has some thousands, whose counts alone meet by key."""
    d = sizes.groupBy(*keys, "a").agg(F.count("*").alias("_k"))
    d = d.withColumn("_cell", F.when(F.col("a") > 0, F.floor(F.log2("a") * 32)).otherwise(-100_000))
    d = scan.prefix(d, keys, ["_cell", "a"], {"_upto": F.col("_k")}, totals={"_all": F.col("_k")}, width=1)
    keep, before = F.floor((1 - 2 * trim) * F.col("_all") + 0.5), F.col("_upto") - F.col("_k")
    squares = F.sum(F.col("a") * F.col("a") * F.least("_k", keep - before))
    return d.filter(before < keep).groupBy(*keys).agg((F.lit(inflation(trim)) * squares / (2 * F.max(keep))).alias("_variance"))


def trimmed_variance(df: DataFrame, keys: list[str], order: list[str], value: str, trim: float = 0.025, width: int = scan.BIN) -> DataFrame:
    """From the smallest absolute adjacent differences: half their mean square, inflated for what was trimmed."""
    d = differences(df, keys, order, value, width).filter("diff is not null").select(*keys, F.abs("diff").alias("a"))
    return trimmed_squares(d, keys, trim).withColumnRenamed("_variance", "trimmed_var")


def run_ids(df: DataFrame, keys: list[str], order: list[str], value: str, width: int = scan.BIN) -> DataFrame:
    """Numbers of runs of equal values, and their lengths.

    Rows are dealt into bins once, and runs are numbered and counted within their bin. Only a bin's first and last run
    may go on in other bins: these pieces, two a bin at most, are put together and numbered by key, and come back to
    their bin as extra rows.
    """
    same = lambda a, b: a.eqNullSafe(b)
    in_bin = Window.partitionBy(*keys, "_bin")
    place = in_bin.orderBy("_own", *order)
    upto = place.rowsBetween(Window.unboundedPreceding, 0)
    quoted = lambda *names: ", ".join(f"`{n}`" for n in names)
    next_from = F.expr(f"lead(_from) ignore nulls over (partition by {quoted(*keys, '_bin')} order by {quoted('_own', *order)})")

    def in_bins(d: DataFrame) -> DataFrame:
        """d with _n and _k, number and length of the row's run in its bin, _from, where a run begins, and _runs, the bin's number of runs."""
        goes_on = F.lag("_own").over(place).eqNullSafe(F.lit(1)) & same(F.lag(value).over(place), F.col(value))
        d = d.withColumn("_from", F.when((F.col("_own") == 1) & ~goes_on, F.row_number().over(place)))
        d = d.withColumns({"_n": F.count("_from").over(upto), "_k": F.coalesce(next_from, F.count(F.lit(1)).over(in_bin) + 1) - F.last("_from", ignorenulls=True).over(upto)})
        return d.withColumn("_runs", F.max("_n").over(in_bin))

    rows = scan.deal(df, keys, order, width)
    ends = in_bins(rows.withColumn("_own", F.lit(1))).filter("_from is not null and (_n = 1 or _n = _runs)")
    at = ["_place", "_piece"]
    pieces = scan.deal(ends.select(*keys, F.col("_bin").alias("_place"), F.col("_n").alias("_piece"), F.col(value).alias("_value"), F.col("_k").alias("_count")), keys, at, width)
    pieces = scan.changes(pieces, keys, at, ["_value"], same, width=width, dealt=True)
    # All runs of a bin but the first begin in it.
    begun = F.when(F.col("_piece") > 1, F.col("_piece") - 1).otherwise(F.col("_new"))
    pieces = scan.prefix(pieces, keys, at, {"run_id": begun}, width=width, dealt=True).withColumn("run_length", F.sum("_count").over(Window.partitionBy(*keys, "run_id")))
    extra = pieces.select(*keys, F.col("_place").alias("_bin"), F.struct("_piece", "run_id", "run_length").alias("_ends")).repartition(*keys, "_bin")

    both, _ = scan.headed(rows, extra, keys, order)
    d = in_bins(both).withColumns({"_first": F.min("_ends").over(in_bin), "_last": F.max("_ends").over(in_bin)}).filter("_own = 1")
    length = F.when(F.col("_n") == 1, F.col("_first.run_length")).when(F.col("_n") == F.col("_runs"), F.col("_last.run_length")).otherwise(F.col("_k"))
    return d.select(*df.columns, (F.col("_first.run_id") + F.col("_n") - 1).alias("run_id"), length.alias("run_length"))


def peaks(df: DataFrame, keys: list[str], order: list[str], value: str, alpha: float = 0.05, width: int = scan.BIN) -> DataFrame:
    """Runs above mean + z(1 - alpha) * standard error: first and last index (from 0), by key."""
    z = NormalDist().inv_cdf(1 - alpha)
    limit = df.groupBy(*(F.col(k).alias(f"_of{i}") for i, k in enumerate(keys))).agg((F.avg(value) + z * F.sqrt(variance(value) / F.count(value))).alias("_limit"))
    marked = df.join(limit, _same(keys)).withColumn("_high", F.coalesce(F.col(value) > F.col("_limit"), F.lit(False)).cast("long"))
    d = scan.prefix(marked, keys, order, {"_highs": F.col("_high")}, count="_i", width=width).filter("_high = 1")
    # A run's rows have one difference of their index and their number among the high ones.
    return d.groupBy(*keys, (F.col("_i") - F.col("_highs")).alias("_run")).agg(F.min(F.col("_i") - 1).alias("peak_start"), F.max(F.col("_i") - 1).alias("peak_end")).drop("_run")


def every_nth(df: DataFrame, keys: list[str], order: list[str], n: int, width: int = scan.BIN) -> DataFrame:
    """The first row of each key and every nth after it."""
    return scan.prefix(df, keys, order, count="_i", width=width).filter(F.col("_i") % n == 1 % n).drop("_i")


def neighbour_median(df: DataFrame, keys: list[str], order: list[str], value: str, reach: int = 5, rows: int = 100_000, width: int = scan.BIN) -> DataFrame:
    """df with med: the median of the values of the row, `reach` rows before and `reach` behind it; null where all are null."""

    columns = df.columns

    def medians(pdf: pd.DataFrame) -> pd.DataFrame:
        v = np.concatenate([np.full(reach, np.nan), pdf[value].to_numpy(float, na_value=np.nan), np.full(reach, np.nan)])
        around = np.lib.stride_tricks.sliding_window_view(v, 2 * reach + 1)
        with warnings.catch_warnings():
            warnings.simplefilter("ignore", RuntimeWarning)  # windows of nulls alone
            return pdf[columns].assign(med=np.nanmedian(around, axis=1))

    names = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)
    return scan.by_halo(df, keys, order, reach, medians, f"{names}, med double", rows, width).withColumn("med", F.nanvl("med", F.lit(None).cast("double")))


def prefix_sums(df: DataFrame, keys: list[str], order: list[str], value: str, width: int = scan.BIN) -> DataFrame:
    return scan.prefix(df, keys, order, {"prefix_sum": F.col(value)}, width=width)


def breakpoints(segments: DataFrame) -> DataFrame:
    """All starts and ends, each once."""
    return segments.select("chrom", F.explode(F.array("seg_start", "seg_end")).alias("pos")).distinct()


def _covering_nodes(first: str, last: str, fanout: int, levels: int) -> Column:
    """Structs (level, node) that cover the bins first..last once: at each level the nodes of fanout**level bins that no
    node of the level above covers, so 2 * fanout of each level at most (of the top one as many as it takes)."""
    parts = []
    for k in range(levels):
        w, wide = fanout**k, fanout ** (k + 1)
        lo, hi = f"(({first}) + {w - 1}) div {w}", f"(({last}) + 1) div {w}"
        lo_up, hi_up = f"((({first}) + {wide - 1}) div {wide}) * {fanout}", f"((({last}) + 1) div {wide}) * {fanout}"
        ranges = [(lo, hi)] if k == levels - 1 else [(lo, f"if({lo_up} < {hi_up}, {lo_up}, {hi})"), (f"if({lo_up} < {hi_up}, {hi_up}, {hi})", hi)]
        parts += [f"transform(if({x} < {y}, sequence({x}, {y} - 1), array()), x -> struct({k} as level, cast(x as long) as node))" for x, y in ranges]
    return F.expr(f"concat({', '.join(parts)})")


def covered_sums(segments: DataFrame, points: DataFrame, values: dict[str, Column], width: int = scan.BIN, fanout: int = 16, levels: int = 4) -> DataFrame:
    """points (chrom, pos; each once) with _covering, how many segments (chrom, seg_start, seg_end) cover each, and the
    sums of values over these (nulls are 0); no pairs of points and segments arise.

    A segment adds its values at its start and takes them back behind its end; such steps are summed by place. Bins
    along the chromosome begin anew: what a segment that began before a bin adds to it comes from sums over nodes, each
    of some bins, that only add. So rounding errors of what is taken back stay in their bin. Null and unknown
    chromosomes match nothing; a segment that ends before it starts covers nothing.
    """
    names = ["_covering", *values]
    given = segments.filter("chrom is not null and seg_start <= seg_end").select("chrom", "seg_start", "seg_end", F.lit(1).alias("_covering"), *(F.coalesce(c, F.lit(0)).alias(n) for n, c in values.items()))
    a, b = f"seg_start div {width}", f"seg_end div {width}"
    on = given.select("chrom", F.col("seg_start").alias("pos"), *names)
    off = given.filter(f"{a} = (seg_end + 1) div {width}").select("chrom", (F.col("seg_end") + 1).alias("pos"), *(-F.col(n) for n in names))
    # A segment that began before the bin in which it ends was added there by nodes.
    later = given.filter(f"{a} < (seg_end + 1) div {width} and (seg_end + 1) div {width} = {b}").select("chrom", (F.col("seg_end") + 1).alias("pos"), *(-F.col(n) for n in names))
    cols = [F.col("chrom"), F.col("pos"), *(F.col(c).alias(n) for c, n in zip(off.columns[2:], names, strict=True))]
    steps = on.unionByName(off.select(*cols)).unionByName(later.select(*cols)).groupBy("chrom", "pos").agg(*(F.sum(n).alias(n) for n in names))
    nodes = given.filter(f"{a} < {b}").select("chrom", F.explode(_covering_nodes(f"{a} + 1", b, fanout, levels)).alias("_node"), *names)
    nodes = nodes.groupBy("chrom", "_node").agg(*(F.sum(n).alias(n) for n in names))
    bins = points.select("chrom", F.expr(f"pos div {width}").alias("_bin")).distinct()
    above = bins.select("chrom", "_bin", F.explode(F.array(*(F.struct(F.lit(k).alias("level"), F.expr(f"_bin div {fanout**k}").cast("long").alias("node")) for k in range(levels)))).alias("_node"))
    base = above.join(nodes, ["chrom", "_node"]).groupBy("chrom", "_bin").agg(*(F.sum(n).alias(n) for n in names))
    at_bin = F.expr(f"pos div {width}").alias("_bin")
    rows = points.select("chrom", "pos", at_bin, F.lit(2).alias("_kind"), *(F.lit(0).alias(n) for n in names))
    rows = rows.unionByName(steps.select("chrom", "pos", at_bin, F.lit(1).alias("_kind"), *names))
    rows = rows.unionByName(base.select("chrom", F.lit(None).cast("long").alias("pos"), "_bin", F.lit(0).alias("_kind"), *names))
    upto = Window.partitionBy("chrom", "_bin").orderBy("pos", "_kind").rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumns({n: F.sum(n).over(upto) for n in names}).filter("_kind = 2").select("chrom", "pos", *names)


def summarize(segments: DataFrame, direction: int, cutoff: float, positions: DataFrame | None = None, width: int = scan.BIN) -> DataFrame:
    """(chrom, pos, value): the sum of exp(direction * state) of the covering segments beyond the cutoff (strictly),
    over the number of all covering ones; 0 where none passes. Positions default to all starts and ends."""
    points = breakpoints(segments) if positions is None else positions.select("chrom", "pos").distinct()
    x = F.col("state") * direction
    passes = F.coalesce((x > cutoff) & ~F.isnan("state"), F.lit(False))
    # What is added is taken back again, so it is added exactly, in decimals; values beyond these, which double precision
    # can't add to smaller ones anyway, are added by themselves.
    value, large = F.exp(x), passes & (F.exp(x) >= 1e20)
    sums = {"_passing": passes.cast("long"), "_sum": F.when(passes & ~large, value).cast("decimal(38,12)"), "_larger": large.cast("long"), "_large": F.when(large, value)}
    got = covered_sums(segments, points, sums, width)
    total = F.col("_sum").cast("double") + F.when(F.col("_larger") > 0, F.col("_large")).otherwise(0.0)
    value = F.when(F.col("_passing") > 0, total / F.col("_covering")).otherwise(0.0)
    return got.select("chrom", "pos", value.alias("value"))


def best_split(df: DataFrame, keys: list[str], order: list[str], value: str, width: int = scan.BIN) -> DataFrame:
    """(keys, split_stat): how far apart the best cut in two sets the means, with two values at least on either side;
    0 for fewer than four values. Sums are taken of the values less their mean, so that they stay small."""
    mean = df.groupBy(*(F.col(k).alias(f"_of{i}") for i, k in enumerate(keys))).agg(F.avg(value).alias("_mean"), F.count(value).alias("_n"))
    d = df.join(mean, _same(keys)).select(*keys, *order, (F.col(value) - F.col("_mean")).alias("_x"), "_n")
    d = scan.prefix(d, keys, order, {"_s": F.col("_x"), "_i": F.col("_x").isNotNull().cast("long")}, width=width)
    inner = F.when(F.col("_i").between(2, F.col("_n") - 2), F.col("_n") * F.col("_s") * F.col("_s") / (F.col("_i") * (F.col("_n") - F.col("_i"))))
    return d.groupBy(*keys).agg(F.sqrt(F.coalesce(F.max(inner), F.lit(0.0))).alias("split_stat"))
