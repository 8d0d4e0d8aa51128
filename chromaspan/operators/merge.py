"""Islands and merging: raw values to segments and back, removal of flagged segments."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from operator import and_

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import StructType

from ..functions.predicates import is_aberrant, small, spurious
from . import scan
from .best import first_to_start
from .intervals import at_home, for_each_sample, spread

EPSILON = 2.0**-23  # how far apart equal values may be: the precision of 32-bit floats


def runs(raw: DataFrame, value: str = "value", epsilon: float = EPSILON, width: int = scan.BIN) -> DataFrame:
    """Segments of adjacent values no more than epsilon apart (of a struct all components), by sample and chromosome;
    nulls are alike. A segment has its first value.

    Runs are put together within bins, which are dealt to as many tasks as shuffles have. Only a bin's first and last
    runs meet those of its neighbours, two rows a bin at most.
    """
    keys, order = ["sample", "chrom"], ["pos", "marker"]
    kind = raw.schema[value].dataType
    names = [f.name for f in kind.fields] if isinstance(kind, StructType) else []
    own = [f"_v{k}" for k in range(len(names) or 1)]
    first, last = [f"_a{k}" for k in range(len(own))], [f"_z{k}" for k in range(len(own))]

    def alike(before: list[Column], now: list[str]) -> Column:
        return reduce(and_, (F.coalesce(F.abs(F.col(b) - a) <= epsilon, a.eqNullSafe(F.col(b))) for a, b in zip(before, now, strict=True)))

    parts = [F.col(value)[n] for n in names] or [F.col(value)]
    d = raw.select(*keys, *order, F.col(value).isNotNull().alias("_there"), *(c.alias(n) for c, n in zip(parts, own, strict=True)), F.expr(f"pos div {width}").alias("_bin"))
    place = Window.partitionBy(*keys, "_bin").orderBy(*order)
    d = spread(d, *keys, "_bin").withColumns({"_first": F.row_number().over(place) == 1, "_last": F.lead(F.lit(1)).over(place).isNull(), "_same": alike([F.lag(n).over(place) for n in own], own)})
    d = d.withColumn("_new", F.col("_first") | ~F.col("_same"))
    d = d.withColumn("_run", F.sum(F.col("_new").cast("long")).over(place.rowsBetween(Window.unboundedPreceding, 0)))
    ends = [F.max(F.when(F.col(at), F.col(n))).alias(to) for at, to_all in (("_new", first), ("_last", last)) for n, to in zip(own, to_all, strict=True)]
    d = d.groupBy(*keys, "_bin", "_run").agg(
        F.min("pos").alias("seg_start"), F.max("pos").alias("seg_end"), F.count("*").alias("n_markers"), F.max("_first").alias("_first"), F.max("_last").alias("_last"), F.max(F.when(F.col("_new"), F.col("_there"))).alias("_there"), *ends,
    )
    of_bins = Window.partitionBy(*keys).orderBy("_bin", "_run")
    tied = d.filter("_first or _last").withColumn("_on", F.col("_first") & F.lag(F.lit(True), 1, False).over(of_bins) & alike([F.lag(n).over(of_bins) for n in last], first))
    tied = tied.withColumn("_run", F.sum((~F.col("_on")).cast("long")).over(of_bins.rowsBetween(Window.unboundedPreceding, 0)))
    head = [F.max(F.when(~F.col("_on"), F.col(n))).alias(n) for n in ("_there", *first)]
    tied = tied.groupBy(*keys, "_run").agg(F.min("seg_start").alias("seg_start"), F.max("seg_end").alias("seg_end"), F.sum("n_markers").alias("n_markers"), *head)
    cols = [*keys, "seg_start", "seg_end", "n_markers", "_there", *first]
    state = F.when(F.col("_there"), F.struct(*(F.col(a).alias(n) for a, n in zip(first, names, strict=True)))) if names else F.col(first[0])
    return d.filter("not (_first or _last)").select(*cols).unionByName(tied.select(*cols)).select(*cols[:5], state.alias("state"))


def to_raw(segments: DataFrame, markers: DataFrame) -> DataFrame:
    """The state of each sample at each marker; null where no segment covers it (of several the first to start)."""
    points = markers.select(F.col("chrom").alias("p_chrom"), "pos", "marker")
    kind = segments.schema["state"].dataType
    parts = [f"_state.state.{f.name}" for f in kind.fields] if isinstance(kind, StructType) else ["_state.state"]
    held = segments.groupBy("sample", "chrom", "seg_start", "seg_end").agg(F.min(F.struct("state")).alias("_state"))
    held = held.select("sample", "chrom", "seg_start", "seg_end", F.col("_state.state").isNotNull().alias("_there"), *(F.col(c).alias(f"_v{k}") for k, c in enumerate(parts)))
    values = ["_there", *(f"_v{k}" for k in range(len(parts)))]
    schema = StructType([*points.schema.fields, held.schema["sample"], *held.select(*values).schema.fields])
    got = at_home(points.distinct().withColumn("_end", F.col("pos")), held, ("p_chrom", "pos", "_end"), ("chrom", "seg_start", "seg_end"), first_to_start(points.columns, values), schema)
    state = F.struct(*(F.col(f"_v{k}").alias(f.name) for k, f in enumerate(kind.fields))) if isinstance(kind, StructType) else F.col("_v0")
    covered = got.select("sample", F.col("p_chrom").alias("chrom"), "pos", "marker", F.when(F.col("_there"), state).alias("value"))
    every = for_each_sample(points.withColumnRenamed("p_chrom", "chrom"), segments)
    return every.join(covered, ["sample", "chrom", "pos", "marker"], "left").select("sample", "marker", "chrom", "pos", "value")


def pooled(segments: DataFrame) -> DataFrame:
    """All samples as one reference sample, positions only."""
    return segments.select(F.lit("ALL").alias("sample"), "chrom", "seg_start", "seg_end", F.lit(0).cast("long").alias("n_markers"), F.lit(0.0).alias("state"))


class Merging:
    """Segments of one chromosome by start, one after the other, without the flagged ones, whose neighbours take their place.

    A kept segment joins the next one if that is kept and alike (then done with: merging is by pairs). A run of flagged
    segments either joins the kept ones on both sides, if they are alike, or goes to the longer of them: upstream
    extends to the end of the run's first segment only, downstream to its start. The joint state weighs the first
    segment with the summed count, as the counts are added before the mean is taken. A null state is like no other; with
    a null count the joint count is null, and so is the joint state of different ones.

    All that is held is the last kept segment (start, end, count, state), whether it may still join the next one, and
    the first one of an open run.
    """

    def __init__(self, deviation: float):
        self.deviation = deviation
        self.reset()

    def reset(self) -> None:
        self.last, self.single, self.run = None, False, None

    def _alike(self, row: tuple) -> bool:
        return self.last is not None and self.last[3] is not None and row[3] is not None and abs(self.last[3] - row[3]) <= self.deviation

    def _join(self, row: tuple) -> None:
        start, _, count, state = self.last
        n = None if count is None or row[2] is None else count + row[2]
        if state != row[3]:
            state = None if n is None or n + row[2] == 0 else (state * n + row[3] * row[2]) / (n + row[2])
        self.last, self.single = (start, row[1], n, state), False

    def add(self, row: tuple, flag: bool) -> tuple | None:
        """Takes the next segment; returns one that nothing can change any more, or None."""
        if flag:
            self.run = self.run or row
            return None
        run, self.run = self.run, None
        if self._alike(row) and (run or self.single):
            self._join(row)
            return None
        done = self.last
        if run and done and done[1] - done[0] >= row[1] - row[0]:
            done = (done[0], run[1], *done[2:])
        elif run and row[0] > run[0]:
            row = (run[0], *row[1:])
        self.last, self.single = row, True
        return done

    def end(self) -> tuple | None:
        """The last segment, as nothing follows."""
        done, run = self.last, self.run
        self.reset()
        return (done[0], run[1], *done[2:]) if done and run else done


def islands(segments: DataFrame, flag: str, deviation: float, width: int = scan.BIN) -> DataFrame:
    """segments with _island: neighbours are in one island if either is flagged or they are alike. Merging never
    reaches from one island to the next."""
    order = ["seg_start", "seg_end", "n_markers", "state"]
    d = scan.lagged(segments, ["sample", "chrom"], order, {flag: "_flag", "state": "_state"}, "_follows", width)
    tied = F.col(flag) | F.col("_flag") | F.coalesce(F.abs(F.col("_state") - F.col("state")) <= deviation, F.lit(False))
    d = d.withColumn("_cut", (~(F.col("_follows") & tied)).cast("long")).drop("_flag", "_state", "_follows")
    return scan.prefix(d, ["sample", "chrom"], order, {"_island": F.col("_cut")}, width=width).drop("_cut")


def remove_flagged(segments: DataFrame, flag: Column, deviation: float = -1.0, merge: bool = False, width: int = scan.BIN) -> DataFrame:
    """Segments (sample, chrom, seg_start, seg_end, n_markers, state) without those flagged; merge: see Merging.

    Without merge it is a filter. With it, segments are dealt by islands, and each task takes its islands' segments in
    order; a kept segment that is an island by itself passes at once.
    """
    cols = ["sample", "chrom", "seg_start", "seg_end", "n_markers", "state"]
    if not merge:
        return segments.filter(~F.coalesce(flag, F.lit(False))).select(*cols)
    d = islands(segments.select(*cols, F.coalesce(flag, F.lit(False)).alias("_flagged")), "_flagged", deviation, width)
    key = ["sample", "chrom", "_island"]
    schema = pa.schema([(f.name, to_arrow_type(f.dataType)) for f in segments.select(*cols).schema.fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fold, at = Merging(deviation), None
        out: list[tuple] = []
        for b in batches:
            table = b.to_pydict()
            for island, row, flagged in zip(zip(*(table[k] for k in key), strict=True), zip(*(table[c] for c in cols[2:]), strict=True), table["_flagged"], strict=True):
                if island != at:
                    if done := fold.end():
                        out.append((*at[:2], *done))
                    at = island
                if done := fold.add(row, flagged):
                    out.append((*at[:2], *done))
            yield pa.RecordBatch.from_pylist([dict(zip(cols, r, strict=True)) for r in out], schema)
            out = []
        if done := fold.end():
            yield pa.RecordBatch.from_pylist([dict(zip(cols, (*at[:2], *done), strict=True))], schema)

    d = d.repartition(*key).withColumn("_alone", (F.count(F.lit(1)).over(Window.partitionBy(*key)) == 1) & ~F.col("_flagged"))
    merged = d.filter(~F.col("_alone")).drop("_alone").sortWithinPartitions(*key, *cols[2:]).mapInArrow(run, segments.select(*cols).schema)
    return d.filter("_alone").select(*cols).unionByName(merged)


def clean(segments: DataFrame, min_count: int | None = None, min_length: int | None = None, aberrant: bool = False, reference: float = 0.0, deviation: float = 0.2, merge: bool = False) -> DataFrame:
    """Passes in order: few markers, short segments, and (never merging) aberrant ones."""
    out = segments
    if min_count is not None:
        out = remove_flagged(out, spurious(F.col("n_markers"), min_count), deviation, merge)
    if min_length is not None:
        out = remove_flagged(out, small(F.col("seg_start"), F.col("seg_end"), min_length), deviation, merge)
    return remove_flagged(out, is_aberrant(F.col("state"), reference, deviation)) if aberrant else out
