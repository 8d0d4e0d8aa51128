"""Line deduplication over levelled sorted runs of line hashes."""

from __future__ import annotations

import uuid
from collections.abc import Iterator, Sequence
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import bounded_batches, remove, scratch

BLANK = b" \t\n\x0b\x0c\r"
ANY = "h1 long, h2 int"
LEAST_ID = -(1 << 63)  # stands for a null doc_id


def line_keys(text: bytes, least: int) -> list[tuple[int, int] | None]:
    """Of each line its key's 96-bit hash; None where the key has fewer than least code points."""
    import xxhash

    out: list[tuple[int, int] | None] = []
    for line in text.split(b"\n"):
        key = line.strip(BLANK).lower()  # bytes.lower changes A-Z only
        if len(key) < least or not key.isascii() and len(key) - sum(1 for x in key if x & 0xC0 == 0x80) < least:
            out.append(None)
            continue
        h = xxhash.xxh128_intdigest(key)
        out.append((((h >> 64) & 0xFFFFFFFFFFFFFFFF) - (1 << 63), (h & 0xFFFFFFFF) - (1 << 31)))
    return out


class LineRuns:
    """Runs of line hashes in levels: tables bucketed by the hash and sorted in each bucket.

    A new batch is counted by line and merge-joined with every run, bucket by bucket; the runs are neither shuffled nor
    sorted for it. Its lines that no run has (the anti-join) are new; they alone are what later batches are joined
    with, so every line is new once. Its other lines are repeats: they keep the batch's count and the count `had` by
    the run that met them first. What is new and what repeats become one run of level 0; as soon as a level has
    `fanout` runs, these are merged into one of the next level, before the next batch comes. So a line is rewritten
    once a level, and a batch meets few runs.
    """

    def __init__(self, spark: SparkSession, fanout: int = 2):
        self.spark, self.fanout, self.levels = spark, fanout, []
        self.buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))

    @contextmanager
    def _sorted(self) -> Iterator[None]:
        """Lets scans of buckets that are one file each keep their order."""
        name = "spark.sql.legacy.bucketedTableScan.outputOrdering"
        before = self.spark.conf.get(name)
        self.spark.conf.set(name, "true")
        try:
            yield
        finally:
            self.spark.conf.set(name, before)

    def _write(self, rows: DataFrame) -> tuple[str, str]:
        name, path = f"chromaspan_run_{uuid.uuid4().hex}", scratch(self.spark, "run")
        rows = rows.select("h1", "h2", "known", "n_docs", "max_doc", "had").repartition(self.buckets, "h1", "h2")
        rows.write.bucketBy(self.buckets, "h1", "h2").sortBy("h1", "h2").option("path", path).saveAsTable(name)
        return name, path

    def runs(self) -> list[str]:
        return [name for level in self.levels for name, _ in level]

    def _drop(self, runs: list[tuple[str, str]]) -> None:
        for name, path in runs:
            self.spark.sql(f"DROP TABLE {name}")
            remove(self.spark, path)

    def met(self, lines: DataFrame) -> DataFrame:
        """Lines (h1, h2, doc_id), each once a document, counted, with known (0: no run has it) and had."""
        out = lines.groupBy("h1", "h2").agg(F.count("*").alias("n_docs"), F.max("doc_id").alias("max_doc")).withColumn("had", F.lit(None).cast("long"))
        for name in self.runs():
            run = self.spark.table(name).filter("known = 0").selectExpr("h1 r1", "h2 r2", "n_docs r_docs", "max_doc r_max").hint("merge")
            out = out.join(run, (F.col("h1") == F.col("r1")) & (F.col("h2") == F.col("r2")), "left")
            out = out.select("h1", "h2", "n_docs", F.greatest("max_doc", "r_max").alias("max_doc"), F.coalesce("had", "r_docs").alias("had"))
        return out.select("h1", "h2", F.col("had").isNotNull().cast("int").alias("known"), "n_docs", "max_doc", F.coalesce("had", F.lit(0)).cast("long").alias("had"))

    def add(self, lines: DataFrame) -> None:
        """A new batch: lines (h1, h2, doc_id), each line once a document."""
        with self._sorted():
            add, level = [self._write(self.met(lines))], 0
            while add:
                if level == len(self.levels):
                    self.levels.append([])
                runs = self.levels[level] = self.levels[level] + add
                add = []
                if len(runs) >= self.fanout:
                    rows = self._all([name for name, _ in runs]).groupBy("h1", "h2", "known")
                    add = [self._write(rows.agg(F.sum("n_docs").alias("n_docs"), F.max("max_doc").alias("max_doc"), F.max("had").alias("had")))]
                    self._drop(runs)
                    self.levels[level] = []
                level += 1

    def _all(self, names: list[str]) -> DataFrame:
        out = self.spark.table(names[0])
        for name in names[1:]:
            out = out.unionByName(self.spark.table(name))
        return out

    def repeated(self, min_docs: int) -> DataFrame:
        """h1, h2, max_doc and n_docs of the lines that min_docs documents hold at least.

        A line of one batch alone has its count where it is new; the joins have told all others, and only these are
        grouped: what they had when they were new, and every repeat's own count.
        """
        rows = self._all(self.runs())
        total = F.max("had") + F.sum("n_docs")
        again = rows.filter("known = 1").groupBy("h1", "h2").agg(total.alias("n_docs"), F.max("max_doc").alias("max_doc"))
        both = rows.filter("known = 0").select("h1", "h2", "n_docs", "max_doc").unionByName(again).filter(F.col("n_docs") >= min_docs)
        return both.groupBy("h1", "h2").agg(F.max("n_docs").alias("n_docs"), F.max("max_doc").alias("max_doc"))

    def close(self) -> None:
        for level in self.levels:
            self._drop(level)
        self.levels = []


def dedup_lines(docs: DataFrame, least: int = 20, min_docs: int = 3, fanout: int = 2, batch_docs: int = 4096, keep: Sequence[str] = ()) -> DataFrame:
    """doc_id, text (of the lines kept, joined by newlines), n_lines and n_dropped of every row of docs (doc_id, text), and its columns to keep.

    A line's key is the line without blanks at its ends and with A-Z lower-cased. A key of at least `least` code
    points that at least min_docs documents hold loses all its lines except in the largest doc_id holding it.

    A null or empty text is one empty line; a very long text is split as a whole. A row is a document: rows that repeat
    a doc_id count as several, and all those with the largest doc_id keep the line; every row stays one row. A null
    doc_id counts as the smallest. Columns neither used nor kept are ignored, and an empty table gives no rows. Keys
    are compared by 96 bits of hash.

    The documents' line hashes are stored once, dealt by hash of the row into a first batch and one more for every
    doubling beyond batch_docs documents, so that levels grow with the input while no batch has to fit anywhere; each
    batch is joined with the runs and adds its own (see LineRuns). Whether a line goes depends on how many documents
    hold it and on the last of them, which only all batches together tell: when all have been added, the repeated
    lines are joined back, and what a document loses by them goes back to its text, by doc_id and a hash of the text.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    keep = [c for c in keep if c not in ("doc_id", "text", "n_lines", "n_dropped")]
    names = {"row_hash": "row_hash", "lost": "lost"}
    while set(names.values()) & set(keep):
        names = {k: f"_{v}" for k, v in names.items()}
    row_hash, lost_lines = names["row_hash"], names["lost"]
    rows = docs.withColumns({"doc_id": F.col("doc_id").cast("long"), "text": F.col("text").cast("binary")}).select("doc_id", "text", *keep)
    rows = rows.withColumn(row_hash, F.xxhash64("text"))

    def keys(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in parts:
            out = [(d, r, *k) for d, r, t in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True) for k in {*line_keys(t or b"", least)} - {None}]
            cols = [*zip(*out, strict=True)] or [()] * 4
            yield pa.record_batch([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.int64(), pa.int32()), strict=True)], names=["doc_id", "row_hash", "h1", "h2"])

    n = docs.count()
    batches = 1 + max(0, n // batch_docs).bit_length()
    path = scratch(spark, "lines")
    lines = rows.select("doc_id", row_hash, "text").mapInArrow(keys, f"doc_id long, row_hash long, {ANY}")
    lines.withColumn("batch", F.pmod(F.xxhash64("doc_id", "row_hash"), F.lit(batches)).cast("int")).write.partitionBy("batch").parquet(path)
    stored = spark.read.schema(f"doc_id long, row_hash long, {ANY}, batch int").parquet(path)
    runs, repeated = LineRuns(spark, fanout), scratch(spark, "repeated")
    try:
        for k in range(batches):
            runs.add(stored.filter(F.col("batch") == k).select("h1", "h2", "doc_id"))
        runs.repeated(min_docs).write.parquet(repeated)
    finally:  # a job that fails leaves no tables in the catalog
        runs.close()

    again = spark.read.schema(f"{ANY}, max_doc long").parquet(repeated).selectExpr("h1 r1", "h2 r2", "max_doc")
    null_least = lambda c: F.coalesce(c, F.lit(LEAST_ID))
    lost = stored.join(again, (F.col("h1") == F.col("r1")) & (F.col("h2") == F.col("r2")) & (null_least("doc_id") < null_least("max_doc")), "left_semi")
    lists = lost.groupBy(null_least("doc_id").alias("lost_id"), F.col("row_hash").alias("lost_row")).agg(F.collect_set(F.struct("h1", "h2")).alias(lost_lines))

    def rewrite(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in parts:
            out = []
            for t, gone in zip(b.column("text").to_pylist(), b.column(lost_lines).to_pylist(), strict=True):
                own = (t or b"").split(b"\n")
                drop = {(x["h1"], x["h2"]) for x in gone or ()}
                kept = own if not drop else [x for x, k in zip(own, line_keys(t, least), strict=True) if k not in drop]
                out.append((b"\n".join(kept), len(own), len(own) - len(kept)))
            cols = [*zip(*out, strict=True)] or [(), (), ()]
            text = pa.array(cols[0], pa.binary()).cast(pa.string())
            yield pa.record_batch([b.column("doc_id"), text, pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.int64()), *map(b.column, keep)], names=["doc_id", "text", "n_lines", "n_dropped", *keep])

    on = (null_least("doc_id") == F.col("lost_id")) & (F.col(row_hash) == F.col("lost_row"))
    joined = rows.join(lists, on, "left").select("doc_id", "text", lost_lines, *keep)
    out = T.StructType().add("doc_id", "long").add("text", "string").add("n_lines", "long").add("n_dropped", "long")
    return joined.mapInArrow(rewrite, T.StructType([*out.fields, *(rows.schema[c] for c in keep)]))
