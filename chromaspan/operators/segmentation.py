"""Circular binary segmentation of raw values: short chromosomes by one task each, long ones by many."""

from __future__ import annotations

import tempfile
import uuid
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import cbs, scan

SEGMENTS = "sample string, chrom int, seg_start long, seg_end long, n_markers long, state double"
KEY = ["sample", "chrom"]
PIECE = [*KEY, "a", "e"]
OPEN = "sample string, chrom int, a long, e long"
TESTED = OPEN + ", stat double, i long, j long, most int, cut int, hits array<int>, found boolean"
CHUNK = 1 << 16  # values in a row of the values' table


def seed_of(sample: str | None, chrom: int | None, seed: int) -> int:
    return zlib.crc32(f"{sample}/{chrom}/{seed}".encode())


def _stored(df: DataFrame, base: str, name: str) -> DataFrame:
    path = f"{base}/{name}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _same(a: DataFrame, b: DataFrame) -> DataFrame:
    """b's key columns renamed, and joined to a by them, nulls included."""
    return a.join(b.withColumnsRenamed({k: f"_{k}" for k in KEY}), F.col("sample").eqNullSafe(F.col("_sample")) & F.col("chrom").eqNullSafe(F.col("_chrom"))).drop("_sample", "_chrom")


def _chunks(smoothed: DataFrame) -> DataFrame:
    """(sample, chrom, at, xs): the values of a chromosome in order, CHUNK to a row, the first of which is its `at`th."""
    d = scan.prefix(smoothed, KEY, ["pos", "value"], count="_i").withColumn("at", F.expr(f"(_i - 1) div {CHUNK} * {CHUNK}"))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        return pdf.iloc[:1][[*KEY, "at"]].assign(xs=pdf.sort_values("_i")["value"].to_numpy(float).tobytes())

    return d.groupBy(*KEY, "at").applyInPandas(run, "sample string, chrom int, at long, xs binary")


def _dealt(values: DataFrame, jobs: DataFrame, f: Callable[[np.ndarray, pd.Series], Iterator[dict]], schema: str) -> DataFrame:
    """What f(values of the piece less their mean, job) yields for each job (PIECE, part and others); a job gets its piece's values only."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        job = pdf.iloc[0]
        pdf = pdf.sort_values("at")
        first = int(pdf["at"].iloc[0])
        x = np.concatenate([np.frombuffer(b) for b in pdf["xs"]])[int(job["a"]) - first : int(job["e"]) - first]
        rows = [dict(job[PIECE]) | r for r in f(x - x.mean(), job)]
        return pd.DataFrame(rows, columns=names)

    names = [c.split()[0] for c in schema.split(", ")]
    given = _same(jobs, values).filter(f"at < e and at + {CHUNK} > a")
    return given.groupBy(*PIECE, "part").applyInPandas(run, schema)


def _rounds(values: DataFrame, pieces: DataFrame, given: cbs.Settings, seed: int, tasks: int, base: str) -> DataFrame:
    """The final pieces. In each round all open pieces are searched and tested side by side, each by `tasks` tasks."""
    spark = values.sparkSession
    waves = [k for k in (0, 16, 64) if k < given.nperm] + [given.nperm]
    done = []
    for number in range(10_000):
        pieces = _stored(pieces, base, f"pieces-{number}")
        if pieces.isEmpty():
            break
        parts = F.explode(F.sequence(F.lit(0), F.lit(tasks - 1))).alias("part")

        def arcs(x: np.ndarray, job: pd.Series) -> Iterator[dict]:
            if cbs.varies(x, given.min_width):
                s, m, t = cbs._sums(x, None)
                best, i, j = cbs._best_arc(s, m, given.min_width, None, share=(int(job["part"]), tasks))
                yield {"best": best, "i": i, "j": j, "tss": t}

        found = _dealt(values, pieces.select(*PIECE, parts), arcs, f"{OPEN}, best double, i long, j long, tss double")
        best = found.groupBy(*PIECE).agg(F.max_by(F.struct("best", "i", "j", "tss"), F.struct("best", F.col("i") - F.col("j"), -F.col("i"))).alias("_b")).select(*PIECE, "_b.*")

        def asked(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for b in batches:
                rows = []
                for r in b.to_dict("records"):
                    n = r["e"] - r["a"]
                    stat = cbs._statistic(r["best"], r["tss"], n)
                    t = cbs.trial(stat, r["i"], r["j"], n, given)
                    most, cut = t if isinstance(t, tuple) else (None, None)
                    rows.append({k: r[k] for k in (*PIECE, "i", "j")} | {"stat": stat, "most": most, "cut": cut, "hits": [], "found": t if isinstance(t, bool) else None})
                yield pd.DataFrame(rows, columns=[c.split()[0] for c in TESTED.split(", ")]).astype({"most": "Int32", "cut": "Int32", "found": "boolean"})

        tested = _stored(best.mapInPandas(asked, TESTED), base, f"arcs-{number}")
        for first, end in zip(waves, waves[1:], strict=False):
            undecided = tested.filter("found is null")

            def permuted(x: np.ndarray, job: pd.Series, first=first, end=end) -> Iterator[dict]:
                draw = cbs.draws(seed_of(job["sample"], None if pd.isna(job["chrom"]) else int(job["chrom"]), seed), int(job["a"]), int(job["e"]))
                cut = None if pd.isna(job["cut"]) else int(job["cut"])
                for k in range(first + int(job["part"]), end, tasks):
                    if cbs.hit(x, draw(k), float(job["stat"]), cut, given.min_width):
                        yield {"k": k}

            hits = _dealt(values, undecided.select(*PIECE, "stat", "cut", parts), permuted, f"{OPEN}, k int").groupBy(*PIECE).agg(F.collect_list("k").alias("_new"))
            joined = _pieces(undecided, hits)

            def decided(batches: Iterator[pd.DataFrame], end=end) -> Iterator[pd.DataFrame]:
                for b in batches:
                    new = [sorted([*h, *([] if n is None else n)]) for h, n in zip(b["hits"], b["_new"], strict=True)]
                    ok = [cbs.confirmed(((k, k in h) for k in range(end)), int(m), given) for h, m in zip(map(set, new), b["most"], strict=True)]
                    yield b.drop(columns="_new").assign(hits=new, found=pd.array([v if v is not None or end < given.nperm else True for v in ok], "boolean")).astype({"most": "Int32", "cut": "Int32"})

            tested = _stored(tested.filter("found is not null").unionByName(joined.mapInPandas(decided, TESTED)), base, f"wave-{number}-{end}")

        def cuts(x: np.ndarray, job: pd.Series) -> Iterator[dict]:
            draw = cbs.draws(seed_of(job["sample"], None if pd.isna(job["chrom"]) else int(job["chrom"]), seed), int(job["a"]), int(job["e"]))
            at = [0, *cbs.edges(x, int(job["i"]), int(job["j"]), given, draw), len(x)]
            if len(at) > 2:
                for u, v in zip(at, at[1:], strict=False):
                    yield {"u": int(job["a"]) + u, "v": int(job["a"]) + v}

        new = _stored(_dealt(values, tested.filter("found").select(*PIECE, "i", "j", F.lit(0).alias("part")), cuts, f"{OPEN}, u long, v long"), base, f"cuts-{number}")
        done.append(_pieces(pieces, new.groupBy(*PIECE).agg(F.count("*").alias("_cut"))).filter("_cut is null").drop("_cut"))
        pieces = new.select(*KEY, F.col("u").alias("a"), F.col("v").alias("e"))
    out = spark.createDataFrame([], OPEN)
    for d in done:
        out = out.unionByName(d)
    return out


def _pieces(a: DataFrame, b: DataFrame) -> DataFrame:
    """a with b's columns for the same piece, or nulls."""
    on = [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in PIECE]
    return a.join(b.withColumnsRenamed({c: f"_{c}" for c in PIECE}), on, "left").drop(*(f"_{c}" for c in PIECE))


def segment_raw(raw: DataFrame, seed: int = 1, long: int = 500_000, tasks: int = 8, undo_prune: bool = False, **options) -> DataFrame:
    """Segments of raw values (sample, chrom, pos, value), smoothed first; options: see Settings.

    A chromosome of at most `long` values is smoothed and cut in one task. A longer one is smoothed in bins and cut in
    rounds: all its open pieces are searched side by side, `tasks` tasks to a piece, which divide the pairs of blocks that may
    hold the best arc, and then the permutations, among them. The random numbers depend on the seed, sample,
    chromosome, piece and permutation alone, so both ways give the same segments, however rows are partitioned. A task
    holds the values of one chromosome or piece. Null values take no part.
    """
    given = cbs.Settings(**options)
    rows = raw.select("sample", "chrom", "pos", "value").filter("value is not null and not isnan(value)")
    sizes = rows.groupBy(*KEY).agg(F.count("*").alias("_n"))
    large = sizes.filter(F.col("_n") > long)
    if large.isEmpty():
        return _short(rows, given, seed, undo_prune)
    base = f"{raw.sparkSession.conf.get('spark.checkpoint.dir', None) or tempfile.mkdtemp(prefix='chromaspan-')}/segments-{uuid.uuid4().hex}"
    large = _stored(large, base, "large")
    of_large = _same(rows, large).drop("_n").withColumn("marker", F.lit(""))
    smoothed = _stored(cbs.smooth_raw(of_large, "chromosome", ties="value").select("sample", "chrom", "pos", "value"), base, "smoothed")
    # Smoothing changes the order of values that share a place; from here on they are in that of their smoothed values.
    values = _stored(_chunks(smoothed), base, "values")
    pieces = _rounds(values, large.select(*KEY, F.lit(0).cast("long").alias("a"), F.col("_n").alias("e")), given, seed, tasks, base)
    if undo_prune:
        pieces = _pruned(values, pieces)
    place = scan.prefix(smoothed, KEY, ["pos", "value"], count="_i").withColumn("_i", F.col("_i") - 1)
    ends = _stored(pieces, base, "ends")
    starts = ends.select(*KEY, F.col("a").alias("_i"), F.lit(1).alias("_begins")).withColumnsRenamed({c: f"_{c}" for c in KEY}).withColumnRenamed("_i", "_at")
    on = F.col("sample").eqNullSafe(F.col("_sample")) & F.col("chrom").eqNullSafe(F.col("_chrom")) & (F.col("_i") == F.col("_at"))
    numbered = place.join(starts, on, "left").select("sample", "chrom", "pos", "value", F.coalesce("_begins", F.lit(0)).alias("_new"))
    numbered = scan.prefix(numbered, KEY, ["pos", "value"], {"_seg": F.col("_new")})
    whole = numbered.groupBy(*KEY, "_seg").agg(F.min("pos").alias("seg_start"), F.max("pos").alias("seg_end"), F.count("*").alias("n_markers"), F.avg("value").alias("state")).drop("_seg")
    rest = rows.join(large.select(*(F.col(k).alias(f"_{k}") for k in KEY)), F.col("sample").eqNullSafe(F.col("_sample")) & F.col("chrom").eqNullSafe(F.col("_chrom")), "left_anti")
    return whole.unionByName(_short(rest, given, seed, undo_prune))


def _pruned(values: DataFrame, pieces: DataFrame) -> DataFrame:
    ends = pieces.groupBy(*KEY).agg(F.min("a").alias("a"), F.max("e").alias("e"), F.array_sort(F.collect_list("e")).alias("ends")).withColumn("part", F.lit(0))

    def run(x: np.ndarray, job: pd.Series) -> Iterator[dict]:
        kept = [int(e) for e in job["ends"]]
        kept = cbs.prune(x, kept) if len(kept) > 2 else kept
        for u, v in zip([0, *kept], kept, strict=False):
            yield {"u": u, "v": v}

    return _dealt(values, ends, run, f"{OPEN}, u long, v long").select(*KEY, F.col("u").alias("a"), F.col("v").alias("e"))


def _short(rows: DataFrame, given: cbs.Settings, seed: int, undo_prune: bool) -> DataFrame:
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["pos", "value"])
        sample, chrom = pdf["sample"].iloc[0], pdf["chrom"].iloc[0]
        pos, n = pdf["pos"].to_numpy(), None if pd.isna(chrom) else int(chrom)
        x = cbs.smooth(pdf["value"].to_numpy())
        x = x[np.lexsort((x, pos))]
        lengths, means = cbs.segment(x, given.alpha, given.nperm, given.min_width, given.hybrid, given.kmax, given.nmin, undo_prune, seed_of(sample, n, seed), eta=given.eta)
        end = np.cumsum(lengths)
        return pd.DataFrame({"sample": sample, "chrom": chrom, "seg_start": pos[end - lengths], "seg_end": pos[end - 1], "n_markers": lengths, "state": means})

    return rows.groupBy(*KEY).applyInPandas(run, SEGMENTS)
