"""Streams of files against the same work on tables."""

import random

from pyspark.sql import functions as F

from chromaspan.operators import intervals, merge
from chromaspan.streaming import segments


def key(row):
    return tuple((x is not None, x) for x in row)


def test_counts_follow_the_files(spark, tmp_path):
    rows = [("A", 1, 1, 9, 3, 0.5), ("A", 1, 10, 20, 3, 1.5), ("B", 2, 1, 5, 1, 2.0)]
    spark.createDataFrame(rows, segments.SCHEMA).write.parquet(str(tmp_path / "in"))
    q = segments.counts(segments.read(spark, str(tmp_path / "in"))).writeStream.format("memory").queryName("counts").outputMode("complete").option("checkpointLocation", str(tmp_path / "state")).start()
    q.processAllAvailable()
    q.stop()
    assert sorted(tuple(r) for r in spark.table("counts").collect()) == [("A", 2, 1.0, 0.5), ("B", 1, 2.0, 0.0)]


def some_values():
    r = random.Random(12)
    rows = []
    for sample, chrom in (("A", 1), ("A", 2), (None, 1), ("B", None)):
        pos = 0
        for k in range(70):
            pos += r.choice([0, 1, 2, 40])
            rows.append((sample, f"m{k:02d}", chrom, pos, r.choice([None, 0.5, 0.5, 0.5, 2.0])))
    r.shuffle(rows)
    return [*rows, ("C", "x", 1, None, 1.0)]


def test_runs_of_any_split_equal_those_of_the_table(spark, tmp_path):
    """Late and interleaved rows, several splits into batches, a stop and a restart in between."""
    rows = some_values()
    want = sorted(map(tuple, merge.runs(spark.createDataFrame(rows, segments.RAW).filter("pos is not null")).collect()), key=key)
    for name, cuts in (("one", [0, len(rows)]), ("five", [0, 3, 90, 91, 200, len(rows)])):
        given, out, state = (str(tmp_path / f"{name}-{x}") for x in ("in", "out", "state"))
        for a, b in zip(cuts, cuts[1:], strict=False):
            spark.createDataFrame(rows[a:b], segments.RAW).coalesce(1).write.mode("append").parquet(given)
            # Each call is a new query that goes on from the checkpoint.
            segments.runs_into(segments.read(spark, given, segments.RAW), out, state, available_now=True, width=30).awaitTermination()
        got = segments.segments_of(spark.read.schema(segments.BIN_RUNS + ", batch long").parquet(out), width=30).collect()
        assert sorted(map(tuple, got), key=key) == want, name


def test_filters_of_a_stream_equal_those_of_the_table(spark, tmp_path):
    r = random.Random(2)
    rows = [("S", r.choice([1, 2, None]), s := r.randrange(1, 60_000), s + r.randrange(1, 900), 5, r.uniform(-1, 1)) for _ in range(300)]
    reference = spark.createDataFrame([("R", c, s + r.randrange(-50, 50), e + r.randrange(-50, 50), 1, 0.0) for _, c, s, e, _, _ in rows[::2]], segments.SCHEMA)
    df = spark.createDataFrame(rows, segments.SCHEMA)
    df.repartition(4).write.parquet(str(tmp_path / "in"))
    for k, options in enumerate(({"kind": "dice", "threshold": 0.8}, {"kind": "query", "threshold": 0.5, "inverse": True, "aberrant": (0.0, 0.3)})):
        out, state = str(tmp_path / f"out{k}"), str(tmp_path / f"state{k}")
        for _ in range(2):  # the second one finds nothing new
            segments.filter_into(segments.read(spark, str(tmp_path / "in"), maxFilesPerTrigger=1), reference, out, state, available_now=True, **options).awaitTermination()
        got = spark.read.schema(segments.SCHEMA + ", batch long").parquet(out).drop("batch").collect()
        want = intervals.exists_filter(df, reference, **options).collect()
        assert sorted(map(tuple, got), key=key) == sorted(map(tuple, want), key=key) and len(want) > 20


def test_marker_filter_on_a_stream(spark, tmp_path):
    rows = [("A", m, 1, k, 0.5) for k, m in enumerate(["a", "b", "c", None])]
    spark.createDataFrame(rows, segments.RAW).write.parquet(str(tmp_path / "in"))
    known = spark.createDataFrame([("b",), ("b",), (None,)], "marker string")
    out = segments.without_markers(segments.read(spark, str(tmp_path / "in"), segments.RAW), known)
    out.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start().awaitTermination()
    got = spark.read.parquet(str(tmp_path / "out")).agg(F.array_sort(F.collect_list(F.coalesce("marker", F.lit("-"))))).first()[0]
    assert got == ["-", "a", "c"]
