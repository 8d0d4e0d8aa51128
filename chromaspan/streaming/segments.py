"""Streams of segments and raw values: predicates and reference filters on rows as they arrive, and runs kept as state."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators import intervals, scan
from ..operators.merge import EPSILON

SCHEMA = "sample string, chrom int, seg_start long, seg_end long, n_markers long, state double"
RAW = "sample string, marker string, chrom int, pos long, value double"
BIN_RUNS = "sample string, chrom int, bin long, version long, seg_start long, first_marker string, seg_end long, n_markers long, first double, last double"
STATE_BIN = 100 * scan.BIN  # a bin is a call of Python for each micro-batch: it should hold hundreds of markers


def read(spark: SparkSession, path: str, schema: str = SCHEMA, **options) -> DataFrame:
    return spark.readStream.schema(schema).options(**options).parquet(path)


def without_markers(stream: DataFrame, reference: DataFrame) -> DataFrame:
    """A stream of raw values without a static reference's markers."""
    return intervals.marker_filter(stream, reference)


def counts(stream: DataFrame) -> DataFrame:
    """Running number, mean and variance of each sample's states."""
    return stream.groupBy("sample").agg(F.count("*").alias("n"), F.avg("state").alias("mean_state"), F.coalesce(F.var_samp("state"), F.lit(0.0)).alias("var_state"))


def filter_into(stream: DataFrame, reference: DataFrame, out: str, checkpoint: str, available_now: bool = False, **options) -> StreamingQuery:
    """Write the segments of a stream that have no similar reference segment (options: as for exists_filter) to the
    Parquet folder `out`, in a folder batch=... for each micro-batch.

    Rows are judged one by one, so there is no state: each batch meets the static reference in bins, by the plan of
    exists_filter. A batch that is tried again after a failure replaces its own folder, so no row is written twice.
    """

    def batch(df: DataFrame, number: int) -> None:
        intervals.exists_filter(df, reference, **options).write.mode("overwrite").parquet(f"{out}/batch={number}")

    writer = stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def _bin_runs(pos: np.ndarray, marker: list[str], value: np.ndarray, epsilon: float) -> pd.DataFrame:
    """The runs of a bin's values, sorted by place and marker; nulls are alike."""
    order = sorted(range(len(pos)), key=lambda k: (pos[k], marker[k]))
    p, v = pos[order], value[order]
    none = np.isnan(v)
    same = (np.abs(np.diff(v)) <= epsilon) | (none[1:] & none[:-1])
    begin = np.flatnonzero(np.append(True, ~same))
    end = np.append(begin[1:], len(p))
    return pd.DataFrame({"seg_start": p[begin], "first_marker": [marker[order[k]] for k in begin], "seg_end": p[end - 1], "n_markers": end - begin, "first": v[begin], "last": v[end - 1]})


def bin_runs(stream: DataFrame, epsilon: float = EPSILON, width: int = STATE_BIN) -> DataFrame:
    """The runs of equal values (as merge.runs has them) of a stream of raw values (sample, marker, chrom, pos, value),
    by bins along the chromosome, in update mode: a bin with new values is given anew, as its next version.

    The state of a bin is its values so far; so late and interleaved rows may extend, split or join its runs, and no
    state grows beyond a bin's markers. A marker that comes again replaces its value. Rows without a place are passed over.
    """

    def update(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        version, pos, markers, values = state.get if state.exists else (0, [], [], [])
        known = {(p, m): v for p, m, v in zip(pos, markers, values, strict=True)}
        for pdf in frames:
            known.update({(int(p), m): v for p, m, v in zip(pdf["pos"], pdf["marker"], pdf["value"].astype(float), strict=True)})
        places, values = list(known), [float(v) for v in known.values()]
        state.update((version + 1, [p for p, _ in places], [m for _, m in places], values))
        runs = _bin_runs(np.array([p for p, _ in places], np.int64), [m for _, m in places], np.array(values), epsilon)
        sample, chrom, at = key
        yield runs.assign(sample=sample, chrom=chrom, bin=at, version=version + 1)[[c.split()[0] for c in BIN_RUNS.split(", ")]]

    value = F.col("value").cast("double").alias("value")
    rows = stream.filter("pos is not null").select("sample", "chrom", F.expr(f"pos div {width}").alias("bin"), "pos", F.coalesce("marker", F.lit("")).alias("marker"), value)
    by = rows.groupBy("sample", "chrom", "bin")
    return by.applyInPandasWithState(update, BIN_RUNS, "version long, pos array<long>, marker array<string>, value array<double>", "update", GroupStateTimeout.NoTimeout)


def runs_into(stream: DataFrame, out: str, checkpoint: str, available_now: bool = False, **options) -> StreamingQuery:
    """Write the versions of bin_runs to the Parquet folder `out`, in a folder batch=... for each micro-batch."""

    def batch(df: DataFrame, number: int) -> None:
        df.write.mode("overwrite").parquet(f"{out}/batch={number}")

    writer = bin_runs(stream, **options).writeStream.foreachBatch(batch).outputMode("update").option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def segments_of(versions: DataFrame, epsilon: float = EPSILON, width: int = STATE_BIN) -> DataFrame:
    """The segments (as merge.runs has them) by the last version of each bin: a bin's first run goes on from the run
    before it, if it begins as that ends."""
    last = versions.groupBy("sample", "chrom", "bin").agg(F.max("version").alias("_last")).withColumnsRenamed({c: f"_{c}" for c in ("sample", "chrom", "bin")})
    on = F.col("sample").eqNullSafe(F.col("_sample")) & F.col("chrom").eqNullSafe(F.col("_chrom")) & (F.col("bin") == F.col("_bin")) & (F.col("version") == F.col("_last"))
    rows = versions.join(last, on).select("sample", "chrom", "seg_start", "first_marker", "seg_end", "n_markers", *(F.nanvl(c, F.lit(None).cast("double")).alias(c) for c in ("first", "last")))
    keys, order = ["sample", "chrom"], ["seg_start", "first_marker"]
    d = scan.lagged(rows, keys, order, {"last": "_before"}, "_follows", width)
    same = F.col("_follows") & F.coalesce(F.abs(F.col("first") - F.col("_before")) <= epsilon, F.col("first").eqNullSafe(F.col("_before")))
    d = scan.prefix(d.withColumn("_new", (~same).cast("long")), keys, order, {"_run": F.col("_new")}, width=width)
    return d.groupBy(*keys, "_run").agg(F.min("seg_start").alias("seg_start"), F.max("seg_end").alias("seg_end"), F.sum("n_markers").alias("n_markers"), F.min_by("first", F.struct(*order)).alias("state")).drop("_run")
