"""What the training-data operators share: scratch tables, text batches and connected components."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text handled at once by the Python side of an operator.
SLICE_BYTES = 2_000_000


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder of spark.checkpoint.dir; a folder of this machine only where that is unset, as in tests."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        base = tempfile.mkdtemp(prefix="chromaspan-")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """df written as a table in the shared folder and read again: its lineage ends there and survives lost executors."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def remove(spark: SparkSession, path: str) -> None:
    """Delete a scratch table, wherever it is."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def bounded_batches(spark: SparkSession) -> None:
    """Arrow batches by bytes as well as rows, so that very long texts don't pile up in a worker."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2000")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(4 * SLICE_BYTES))


def slices(texts: list, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of texts that hold about limit bytes each; a longer text stands alone."""
    start, size = 0, 0
    for i, t in enumerate(texts):
        if size and size + len(t) > limit:
            yield start, i
            start, size = i, 0
        size += len(t)
    if start < len(texts):
        yield start, len(texts)


def _with_least(rows: DataFrame, low: DataFrame, hot: int, most: int) -> DataFrame:
    """rows (u, v) with m of low (u, m, n), where n is the number of u's links, `most` at most.

    A node with `hot` links or more meets them by a broadcast, all others by a shuffle: a hub's rows stay in the tasks
    that hold them. No more than (sum of n) / hot nodes are broadcast, and nothing where `most` tells that there is no
    hub: each broadcast takes some MB of the driver's memory, however little it holds.
    """
    few = low.select("u", "m").hint("merge")
    if most < hot:
        return rows.join(few, "u")
    hubs = F.broadcast(low.filter(F.col("n") >= hot).select("u", F.col("m").alias("hub")))
    e = rows.join(hubs, "u", "left")
    rest = e.filter("hub is null").select("u", "v").join(low.filter(F.col("n") < hot).select("u", "m").hint("merge"), "u")
    return e.filter("hub is not null").select("u", "v", F.col("hub").alias("m")).unionByName(rest)


def connected_components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(id, component_id) of every node of edges (a, b): the smallest id that its links reach.

    Large-star and small-star steps alternate until the edges are stars, in which every node points at the smallest of
    its component; each step groups with partial minima and broadcasts the minima of hubs (nodes with a 500th of all
    edges; 1000 nodes at most), so that a hub's edges never meet in one task. A node without edges isn't returned.
    """
    e = stored(edges.filter("a <> b").selectExpr("greatest(a, b) u", "least(a, b) v").distinct(), "edges")
    for turn in range(rounds + 1):
        ends = e.selectExpr("inline(array(struct(u AS id, 1 AS up, 0 AS down), struct(v AS id, 0 AS up, 1 AS down)))").groupBy("id").agg(F.sum("up").alias("up"), F.sum("down").alias("down"))
        # No star: a node that points at two, or at one that points on.
        n, most, most_up, open_ = ends.agg(F.coalesce(F.sum("up"), F.lit(0)), F.max(F.col("up") + F.col("down")), F.max("up"), F.count_if(F.expr("up > 1 or up = 1 and down > 0"))).first()
        if not open_:
            break
        if turn == rounds:
            raise RuntimeError(f"components have not settled after {rounds} rounds")
        hot = max(100, n // 500)
        least = e.selectExpr("inline(array(struct(u AS u, v AS v), struct(v AS u, u AS v)))").groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"), F.count("*").alias("n"))
        large = _with_least(e.selectExpr("v u", "u v"), least, hot, most).selectExpr("v u", "m v").filter("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n"))
        # A node's links in large are the minima of the smaller nodes that it was linked with.
        small = _with_least(large, low, hot, most_up).selectExpr("v u", "m v").unionByName(low.selectExpr("u", "m v"))
        e = stored(small.filter("u <> v").selectExpr("greatest(u, v) u", "least(u, v) v").distinct(), "edges")
    return e.selectExpr("u id", "v component_id").unionByName(e.selectExpr("v id", "v component_id").distinct())
