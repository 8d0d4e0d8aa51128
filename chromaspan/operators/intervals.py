"""Interval joins: overlap, existence, stabbing and predecessor lookup.

Intervals are closed. Both sides are dealt into bins of `bin_width` along the chromosome, so that a join's key is
(chromosome, bin) and no task holds a whole chromosome; a pair that shares several bins counts in the last bin that
both begin in or before. An interval of more than `most_bins` bins is looked up by a wider bin of its own.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import LongType, StructField, StructType

from ..functions.overlap import overlaps, score, start_bounds
from ..functions.predicates import is_aberrant
from . import scan

BIN = scan.BIN
LEVEL = 64  # a level's bins are so many times as wide as those of the one before
HOME = 4  # the same where rows have one bin only


def _level(start: str, end: str, width: int, levels: int) -> Column:
    size = F.col(end) - F.col(start)
    return reduce(lambda rest, k: F.when(size <= 8 * width * LEVEL**k, F.lit(k)).otherwise(rest), reversed(range(levels - 1)), F.lit(levels - 1))


def _binned(df: DataFrame, start: str, end: str, width: int, levels: int, own: bool) -> DataFrame:
    """Rows by (_level, _bin). own: in the level that suits their length; else in all levels."""
    level = F.array(_level(start, end, width, levels)) if own else F.sequence(F.lit(0), F.lit(levels - 1))
    out = df.withColumn("_level", F.explode(level))
    w = (F.lit(width) * F.pow(F.lit(LEVEL), F.col("_level"))).cast("long")
    out = out.withColumn("_w", w).withColumn("_first", F.expr(f"{start} div _w"))
    return out.withColumn("_bin", F.explode(F.expr(f"sequence(_first, {end} div _w)"))).drop("_w")


def _ordered(df: DataFrame, *order: str) -> DataFrame:
    """df's rows of each task in order, also below a join. Spark takes sorts out there, but not from below a filter by
    what it can't know; as the order begins with the join's keys, it doesn't sort again."""
    return df.sortWithinPartitions(*order).withColumn("_task", F.spark_partition_id()).filter("_task >= 0").drop("_task")


def bins(q: DataFrame, r: DataFrame, q_cols: tuple[str, str, str], r_cols: tuple[str, str, str], levels: int = 4) -> tuple[int, int]:
    """How wide bins are for overlap_join, and how many levels, of at most so many, rows of r may have."""
    long = [d.agg(F.avg(F.col(e) - F.col(s)), F.max(F.col(e) - F.col(s))).first() for d, (_, s, e) in ((q, q_cols), (r, r_cols))]
    width = int(min(BIN, max(1000, sum(x[0] or 0 for x in long) / 2)))
    return width, next((k + 1 for k in range(levels - 1) if (long[1][1] or 0) <= 8 * width * LEVEL**k), levels)


def overlap_join(q: DataFrame, r: DataFrame, q_cols: tuple[str, str, str], r_cols: tuple[str, str, str], condition: Column | None = None, bin_width: int | None = None, levels: int = 4, how: str = "inner") -> DataFrame:
    """All pairs of rows of q and r that overlap on the same chromosome (and meet the condition).

    cols: the names of chromosome, start and end; the two sides share no other column names. A row of r stands in the
    level of bins that suits its length, in a few bins there; q is dealt to every level, so long rows of q cost bins.
    how="left_semi" gives the rows of q that have a pair, once for each bin and level where they have one. Bins are as
    wide as the two sides' rows are long on average, at most BIN, unless their width is given; then q is dealt only to
    levels that rows of r may have.
    """
    (qc, qs, qe), (rc, rs, re) = q_cols, r_cols
    if bin_width is None:
        bin_width, levels = bins(q, r, q_cols, r_cols, levels)
    if how == "inner":  # null matches nothing; Spark finds that out above the sorts only
        q, r = q.dropna(subset=[*q_cols]), r.dropna(subset=[*r_cols])
    a = _binned(q, qs, qe, bin_width, levels, own=False)
    b = _binned(r, rs, re, bin_width, levels, own=True).withColumnsRenamed({"_level": "_rlevel", "_first": "_rfirst", "_bin": "_rbin"})
    on = (F.col(qc) == F.col(rc)) & (F.col("_level") == F.col("_rlevel")) & (F.col("_bin") == F.col("_rbin")) & overlaps(F.col(qs), F.col(qe), F.col(rs), F.col(re))
    if how == "inner":
        on &= F.col("_bin") == F.greatest("_first", "_rfirst")
        # Spark takes a side's size from its file, before bins multiply its rows, and would broadcast it through the driver.
        # In order of starts neighbours have nearly the same partners in the same order, so that written pairs are small.
        a = _ordered(spread(a, qc, "_level", "_bin"), qc, "_level", "_bin", qs).hint("merge")
        b = _ordered(spread(b, rc, "_rlevel", "_rbin"), rc, "_rlevel", "_rbin", rs)
    if condition is not None:
        on &= condition
    return a.join(b, on, how).drop("_level", "_first", "_bin", "_rlevel", "_rfirst", "_rbin")


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """df dealt by keys to as many tasks as shuffles have at most: what it is few bytes of may be much to do, so the
    number doesn't follow the bytes."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)


def at_home(q: DataFrame, r: DataFrame, q_cols: tuple[str, str, str], r_cols: tuple[str, str, str], f: Callable[[pd.DataFrame, pd.DataFrame], Iterator[pd.DataFrame]], schema: StructType, bin_width: int = BIN, levels: int = 14, lone: bool = False) -> DataFrame:
    """What f yields for the rows of q in a bin and all rows of r that may overlap them, for each bin that has both (lone:
    that has rows of q). A task holds a bin's rows and one part of what f yields.

    A row of q stands in one bin only, that of its start, in the level of bins that suits its length; rows of r are dealt
    to the bins that they, lengthened by the level's longest row of q, reach. So what f tells of a row of q is whole, and
    no pairs are shuffled. f gets q's columns with _s and _e for its interval, and r's likewise. Nulls match nothing.
    """
    (qc, qs, qe), (rc, rs, re) = q_cols, r_cols
    long = F.col("_e") - F.col("_s")
    level = reduce(lambda rest, k: F.when(long <= bin_width * HOME**k, F.lit(k)).otherwise(rest), reversed(range(levels - 1)), F.lit(levels - 1))
    a = q.select(*q.columns, F.col(qc).alias("_c"), F.col(qs).alias("_s"), F.col(qe).alias("_e")).dropna(subset=["_c", "_s", "_e"]).withColumn("_level", level)
    reach = {x._level: max(0, x.n) for x in a.groupBy("_level").agg(F.max(long).alias("n")).collect()} or {0: 0}
    a = a.withColumn("_bin", F.expr(f"_s div ({bin_width} * cast(pow({HOME}, _level) as long))"))
    b = r.select(*r.columns, F.col(rc).alias("_c"), F.col(rs).alias("_s"), F.col(re).alias("_e")).dropna(subset=["_c", "_s", "_e"])
    places = F.array(*(F.struct(F.lit(k).alias("level"), F.lit(bin_width * HOME**k).cast("long").alias("w"), F.lit(n).cast("long").alias("reach")) for k, n in sorted(reach.items())))
    b = b.withColumn("_at", F.explode(places)).withColumn("_bin", F.explode(F.expr("sequence((_s - _at.reach) div _at.w, _e div _at.w)"))).withColumn("_level", F.col("_at.level")).drop("_at")
    key = ["_c", "_level", "_bin"]

    x, y = (F.struct(*d.columns, "_s", "_e") for d in (q, r))
    both = a.select(*key, x.alias("_q")).unionByName(b.select(*key, y.alias("_r")), allowMissingColumns=True)
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = pa.Table.from_batches(batches)
        x, y = (_frame(t[c].combine_chunks()) for c in ("_q", "_r"))
        if len(x) and (lone or len(y)):
            for part in f(x, y):
                if len(part):
                    yield pa.RecordBatch.from_pandas(part, arrow, preserve_index=False, nthreads=1)

    return spread(both, *key).groupBy(*key).applyInArrow(run, schema)


def _frame(structs: pa.StructArray) -> pd.DataFrame:
    """A row for each struct, without nulls."""
    structs = structs.drop_null()
    return pa.Table.from_arrays(structs.flatten(), [f.name for f in structs.type]).to_pandas()


def _hits(asked: DataFrame, r: DataFrame, kind: str, threshold: float, optimize: bool, q_cols, r_cols, bin_width: int) -> tuple[DataFrame, Column]:
    """The distinct intervals (_k0, _k1, _k2) of `asked` that have a reference row, and how they are joined to it."""
    ref = r.select(*(F.col(c).alias(f"_r{k}") for k, c in enumerate(r_cols))).distinct()
    cols = [F.col(c) for c in (*q_cols[1:], "_r1", "_r2")]
    met = score(kind, *cols) >= threshold
    if optimize:
        met = start_bounds(kind, threshold, *cols) & met
    keys = asked.select(*q_cols).distinct()
    hit = overlap_join(keys, ref, q_cols, ("_r0", "_r1", "_r2"), met, bin_width, how="left_semi").select(*(F.col(c).alias(f"_k{k}") for k, c in enumerate(q_cols))).distinct()
    return hit, reduce(lambda a, b: a & b, (F.col(c) == F.col(f"_k{k}") for k, c in enumerate(q_cols)))


def exists_filter(q: DataFrame, r: DataFrame, kind: str = "dice", threshold: float = 0.5, inverse: bool = False, aberrant: tuple[float, float] | None = None, optimize: bool = True, q_cols=("chrom", "seg_start", "seg_end"), r_cols=("chrom", "seg_start", "seg_end"), bin_width: int = BIN) -> DataFrame:
    """Rows of q without a reference row that overlaps with a score of threshold or more (inverse: those with one).

    aberrant: (reference state, deviation); then only aberrant rows can be flagged, and the others bypass the join.
    optimize adds the cheaper necessary condition, which changes no result. A null or unknown chromosome never matches.
    """
    asked = q if aberrant is None else q.filter(is_aberrant(F.col("state"), *aberrant))
    hit, same = _hits(asked, r, kind, threshold, optimize, q_cols, r_cols, bin_width)
    out = asked.join(hit, same, "left_semi" if inverse else "left_anti")
    if aberrant is not None and not inverse:
        out = out.unionByName(q.filter(~F.coalesce(is_aberrant(F.col("state"), *aberrant), F.lit(False))))
    return out


def exists_flag(q: DataFrame, r: DataFrame, flag: str, kind: str = "dice", threshold: float = 0.5, inverse: bool = False, aberrant: tuple[float, float] | None = None, optimize: bool = True, q_cols=("chrom", "seg_start", "seg_end"), r_cols=("chrom", "seg_start", "seg_end"), bin_width: int = BIN) -> DataFrame:
    """q with a flag where exists_filter would leave the row out, whatever is null in it."""
    asked = F.lit(True) if aberrant is None else F.coalesce(is_aberrant(F.col("state"), *aberrant), F.lit(False))
    hit, same = _hits(q.filter(asked), r, kind, threshold, optimize, q_cols, r_cols, bin_width)
    met = asked & F.col("_k0").isNotNull()
    return q.join(hit, same, "left").withColumn(flag, ~met if inverse else met).drop("_k0", "_k1", "_k2")


def for_each_sample(rows: DataFrame, of: DataFrame, most: int = 100_000) -> DataFrame:
    """A row for each of rows and each sample of `of`: what asks for it returns so many. The samples are broadcast once
    they are known to be `most` at most; more meet the rows by a key of hundredths instead."""
    samples = of.select("sample").distinct()
    if samples.limit(most + 1).count() <= most:
        return rows.crossJoin(F.broadcast(samples))
    dealt = samples.withColumn("_deal", F.pmod(F.xxhash64("sample"), F.lit(100)))
    return rows.withColumn("_deal", F.explode(F.sequence(F.lit(0), F.lit(99)))).withColumn("_deal", F.col("_deal").cast("long")).join(dealt, "_deal").drop("_deal")


def marker_filter(raw: DataFrame, reference: DataFrame) -> DataFrame:
    """Rows whose marker isn't in the reference (marker)."""
    return raw.join(reference.select("marker").distinct(), "marker", "left_anti")


def stab(points: DataFrame, segments: DataFrame, cols=("chrom", "seg_start", "seg_end"), bin_width: int | None = None) -> DataFrame:
    """Pairs of points (p_chrom, pos) and segments that cover them."""
    return overlap_join(points.withColumn("_end", F.col("pos")), segments, ("p_chrom", "pos", "_end"), cols, bin_width=bin_width).drop("_end")


def running_count(df: DataFrame, keys: list[str], position: str, order: list[str], one: Column, bin_width: int = BIN) -> DataFrame:
    """df with _n: the sum of `one` over the rows of the same keys up to each, by position and order, scanned in bins."""
    return scan.prefix(df, keys, [position, *order], {"_n": one.cast("long")}, width=bin_width).select(*df.columns, "_n")


def predecessor(points: DataFrame, starts: DataFrame, keys: list[str], bin_width: int = BIN) -> DataFrame:
    """points with ordinal: how many distinct starts (keys, start) come before the last one that is at pos or before it
    (0 where none is). Sorted in bins along the chromosome, no pairs."""
    both = points.withColumns({"_p": F.col("pos"), "_of": F.lit(1)}).unionByName(starts.select(*keys, F.col("start").alias("_p")).distinct().withColumn("_of", F.lit(0)), allowMissingColumns=True)
    counted = running_count(both, keys, "_p", ["_of"], 1 - F.col("_of"), bin_width)
    return counted.filter("_of = 1").withColumn("ordinal", F.greatest(F.col("_n") - 1, F.lit(0)).cast("long")).drop("_p", "_of", "_n")


def is_valid(start: str = "seg_start", end: str = "seg_end") -> Column:
    """Whether an interval doesn't end before it starts."""
    return F.col(start) <= F.col(end)


def validated(df: DataFrame, start: str = "seg_start", end: str = "seg_end") -> DataFrame:
    """df, whose evaluation fails on an interval that ends before it starts."""
    ok = F.assert_true(is_valid(start, end), F.lit("interval ends before it starts"))
    return df.withColumn(start, F.when(ok.isNull(), F.col(start)))


def _least_around(rows: list[tuple], strict: bool) -> list[tuple | None]:
    """For each of rows (stratum, end, what) by stratum the least `what` of earlier strata whose end is no less (strict:
    greater): ends are ranked, and a tree over ranks holds least ones of what was met so far."""
    ends = sorted({r[1] for r in rows}, reverse=True)
    rank = {e: k + 1 for k, e in enumerate(ends)}
    tree: list[tuple | None] = [None] * (len(ends) + 1)
    out: list[tuple | None] = [None] * len(rows)
    at = 0
    while at < len(rows):
        upto = at
        while upto < len(rows) and rows[upto][0] == rows[at][0]:
            k = rank[rows[upto][1]] - strict
            while k:
                if tree[k] is not None and (out[upto] is None or tree[k] < out[upto]):
                    out[upto] = tree[k]
                k -= k & -k
            upto += 1
        for _, end, what in rows[at:upto]:
            k = rank[end]
            while k < len(tree):
                if tree[k] is None or what < tree[k]:
                    tree[k] = what
                k += k & -k
        at = upto
    return out


def self_containment(df: DataFrame, id_col: str, cols=("chrom", "seg_start", "seg_end"), bin_width: int = BIN) -> DataFrame:
    """(child, parent): the shortest other interval that contains each (ties: smallest id); of equal intervals the smaller id contains.

    What contains an interval begins in the bin where that begins, or ends in the bin where that ends, or begins in an
    earlier and ends in a later bin. The first two are found within bins of starts and of ends, in order of start, with
    the least length so far by end; the third needs no places, only each pair of bins' shortest interval. So there are
    three rows an interval, however many contain it. Null chromosomes and places match nothing.
    """
    c, s, e = cols
    kind = df.schema[id_col].dataType
    d = df.select(F.col(id_col).alias("child"), F.col(c).alias("_c"), F.col(s).cast("long").alias("_s"), F.col(e).cast("long").alias("_e")).dropna(subset=["_c", "_s", "_e"])
    d = d.withColumns({"_sb": F.floor(F.col("_s") / bin_width), "_eb": F.floor(F.col("_e") / bin_width)})
    result = StructType([StructField("child", kind), StructField("_size", LongType()), StructField("parent", kind)])

    def found(pdf: pd.DataFrame, around: list) -> pd.DataFrame:
        rows = [(i, *x) for i, x in zip(pdf["child"].tolist(), around, strict=True) if x is not None]
        return pd.DataFrame(rows, columns=["child", "_size", "parent"])

    def from_starts(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["_s", "_e", "child"], ascending=[True, False, True])
        return found(pdf, _least_around([(k, b, (b - a, i)) for k, (a, b, i) in enumerate(zip(pdf["_s"].tolist(), pdf["_e"].tolist(), pdf["child"].tolist(), strict=True))], False))

    def from_ends(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("_sb")
        return found(pdf, _least_around([(k, b, (b - a, i)) for k, a, b, i in zip(pdf["_sb"].tolist(), pdf["_s"].tolist(), pdf["_e"].tolist(), pdf["child"].tolist(), strict=True)], False))

    def from_cells(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("_sb")
        around = _least_around([(k, b, (n, i)) for k, b, n, i in zip(pdf["_sb"].tolist(), pdf["_eb"].tolist(), pdf["_size"].tolist(), pdf["child"].tolist(), strict=True)], True)
        return pdf[["_c", "_sb", "_eb"]].assign(_size=[x and x[0] for x in around], parent=[x and x[1] for x in around]).dropna(subset=["_size"])

    cells = d.groupBy("_c", "_sb", "_eb").agg(F.min(F.struct((F.col("_e") - F.col("_s")).alias("_size"), "child")).alias("_m")).select("_c", "_sb", "_eb", "_m._size", "_m.child")
    shape = StructType([StructField("_c", d.schema["_c"].dataType), StructField("_sb", LongType()), StructField("_eb", LongType()), *result.fields[1:]])
    far = d.join(cells.groupBy("_c").applyInPandas(from_cells, shape), ["_c", "_sb", "_eb"]).select("child", "_size", "parent")
    near = d.groupBy("_c", "_sb").applyInPandas(from_starts, result).unionByName(d.groupBy("_c", "_eb").applyInPandas(from_ends, result))
    return near.unionByName(far).groupBy("child").agg(F.min_by("parent", F.struct("_size", "parent")).alias("parent"))
