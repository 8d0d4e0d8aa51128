"""Scans with carries, halo bins and island-wise merging against plain models, at every kind of bin edge."""

import math
import random
import statistics

import numpy as np
import pytest
from pyspark.sql import functions as F

from chromaspan import commands
from chromaspan.operators import cbs, merge, scan, stats
from chromaspan.sources import files

RAW = "sample string, chrom int, pos long, marker string, value double"
SEG = "sample string, chrom int, seg_start long, seg_end long, n_markers long, state double"
KEYS, ORDER = ["sample", "chrom"], ["pos", "marker"]


@pytest.fixture(scope="module")
def values():
    """Rows of several keys: nulls in keys, values and places, equal places, gaps of many bins, negative places, runs across bins."""
    r = random.Random(7)
    out = []
    for sample, chrom in (("A", 1), ("A", 2), (None, 1), ("B", None), ("C", 3)):
        pos, value = -35, 0.5
        for k in range(90 if sample != "C" else 1):
            pos += r.choice([0, 1, 2, 3, 9, 60]) if k else 0
            value = value if r.random() < 0.6 else round(r.uniform(-1, 1), 3)
            out.append((sample, chrom, pos, f"m{k:03d}", None if r.random() < 0.1 else value))
    out.append(("D", 1, None, "m", 1.25))
    return out


@pytest.fixture(scope="module")
def raw(spark, values):
    return spark.createDataFrame(values, RAW).withColumns({"_bin_": F.lit(1), "n": F.lit(2)}).repartition(5)


def by_key(values):
    out = {}
    for row in sorted(values, key=lambda v: (str(v[:2]), v[2] if v[2] is not None else -math.inf, v[3])):
        out.setdefault(row[:2], []).append(row)
    return out


def collected(df, *cols):
    return {(r.sample, r.chrom, r.marker): tuple(r[c] for c in cols) for r in df.collect()}


@pytest.mark.parametrize("width", [1, 7, 20_000])
def test_lag_prefix_moments_and_runs(raw, values, width):
    lag, sums = collected(scan.lagged(raw, KEYS, ORDER, {"value": "before"}, "there", width), "before", "there"), collected(scan.prefix(raw, KEYS, ORDER, {"s": F.col("value")}, "i", {"t": F.col("value")}, width), "s", "i", "t")
    run, ids = collected(stats.running(raw, KEYS, ORDER, "value", width), "run_mean", "run_sd", "run_psd", "run_var"), collected(stats.run_ids(raw, KEYS, ORDER, "value", width), "run_id", "run_length")
    kept = collected(stats.every_nth(raw, KEYS, ORDER, 4, width), "pos")
    for (sample, chrom), rows in by_key(values).items():
        v = [x[4] for x in rows]
        starts = [k for k in range(len(v)) if not k or v[k] != v[k - 1]]
        for k, x in enumerate(rows):
            at = (sample, chrom, x[3])
            assert lag[at] == ((v[k - 1], True) if k else (None, False))
            some, all_ = [y for y in v[: k + 1] if y is not None], [y for y in v if y is not None]
            assert sums[at] == (pytest.approx(sum(some)) if some else None, k + 1, pytest.approx(sum(all_)))
            begin = max(s for s in starts if s <= k)
            assert ids[at] == (starts.index(begin) + 1, next((s for s in starts if s > k), len(v)) - begin)
            var = statistics.variance(some) if len(some) > 1 else 0.0
            if some:
                assert run[at] == pytest.approx((statistics.mean(some), math.sqrt(var), statistics.pstdev(some), var), abs=1e-12)
            else:
                assert run[at][0] is None
            assert (at in kept) == (k % 4 == 0)


def test_moments_of_far_values(spark):
    """The variance of values that differ little and lie far from zero, over many bins."""
    rows = [("A", 1, k, f"{k:05d}", 1e8 + (k % 7) * 1e-3) for k in range(400)]
    got = stats.running(spark.createDataFrame(rows, RAW), KEYS, ORDER, "value", 10).orderBy("pos").collect()
    for k in (5, 57, 399):
        assert got[k].run_var == pytest.approx(statistics.variance([x[4] - 1e8 for x in rows[: k + 1]]), rel=1e-4)


@pytest.mark.parametrize("width", [3, 20_000])
def test_peaks_split_and_trimmed_variance(raw, values, width):
    peaks, split, trimmed = {}, {}, {}
    for r in stats.peaks(raw, KEYS, ORDER, "value", width=width).collect():
        peaks.setdefault((r.sample, r.chrom), set()).add((r.peak_start, r.peak_end))
    for r in stats.best_split(raw, KEYS, ORDER, "value", width).collect():
        split[r.sample, r.chrom] = r.split_stat
    for r in stats.trimmed_variance(raw, KEYS, ORDER, "value", 0.1, width).collect():
        trimmed[r.sample, r.chrom] = r.trimmed_var
    for key, rows in by_key(values).items():
        v = [x[4] for x in rows]
        have = [x for x in v if x is not None]
        limit = statistics.mean(have) + statistics.NormalDist().inv_cdf(0.95) * math.sqrt((statistics.variance(have) if len(have) > 1 else 0) / len(have))
        high = [x is not None and x > limit for x in v]
        want = {(a, next((k for k in range(a, len(v)) if not high[k]), len(v)) - 1) for a in range(len(v)) if high[a] and not (a and high[a - 1])}
        assert peaks.get(key, set()) == want
        n, x = len(have), np.array(have) - np.mean(have)
        best = max((n * x[:i].sum() ** 2 / (i * (n - i)) for i in range(2, n - 1)), default=0)
        assert split[key] == pytest.approx(math.sqrt(best), abs=1e-9)
        d = sorted(abs(b - a) for a, b in zip(v, v[1:], strict=False) if a is not None and b is not None)
        keep = math.floor(0.8 * len(d) + 0.5)
        if keep:
            assert trimmed[key] == pytest.approx(stats.inflation(0.1) * sum(x * x for x in d[:keep]) / (2 * keep))


@pytest.mark.parametrize("rows", [5, 6, 31, 1000])
def test_halo_bins_equal_the_whole(raw, values, rows):
    """Medians and smoothing in small bins: every place is at some distance from a bin's edge."""
    med = collected(stats.neighbour_median(raw, KEYS, ORDER, "value", 5, rows, 7), "med")
    for (sample, chrom), own in by_key(values).items():
        v = [x[4] for x in own]
        for k, x in enumerate(own):
            near = [y for y in v[max(0, k - 5) : k + 6] if y is not None]
            assert med[sample, chrom, x[3]] == (pytest.approx(statistics.median(near)) if near else None,)
    for scope in ("sample", "chromosome"):
        got = collected(cbs.smooth_raw(raw, scope, region=4, outlier_sd=0.5, rows=rows, width=7), "value")
        for key, own in by_key(values).items():
            v = np.array([np.nan if x[4] is None else x[4] for x in own])
            if scope == "sample":
                whole = [x[4] for k, r in sorted(by_key(values).items(), key=lambda t: (t[0][1] is not None, t[0][1] or 0)) for x in r if k[0] == key[0] and x[4] is not None]
                sd = math.sqrt(cbs.trimmed_variance(np.array(whole)))
            else:
                sd = None
            want = cbs.smooth(v, region=4, outlier_sd=0.5, sd=sd)
            if scope == "chromosome":  # differences stand between values that are adjacent and finite
                want = cbs.smooth(v[np.isfinite(v)], region=4, outlier_sd=0.5)
                want = [next(it) if np.isfinite(x) else np.nan for it in [iter(want)] for x in v]
            for x, y in zip(own, want, strict=True):
                (z,) = got[(*key, x[3])]
                assert z == pytest.approx(y, abs=1e-9) if z is not None and not math.isnan(z) else not np.isfinite(y), (key, x)
    with pytest.raises(ValueError, match="beyond"):
        scan.halo(raw, KEYS, ORDER, 5, 4)


def plain_merge(rows, deviation):
    """The definition, over a list of [start, end, count, state, flag]."""
    rows = [list(r) for r in rows]
    out, gone = [], [False] * len(rows)

    def join(a, b):
        a[1] = b[1]
        a[2] += b[2]
        if a[3] != b[3]:
            a[3] = (a[3] * a[2] + b[3] * b[2]) / (a[2] + b[2])

    for i, this in enumerate(rows):
        after = i + 1
        if gone[i]:
            continue
        if not this[4]:
            out.append(this)
            if after < len(rows) and not rows[after][4] and abs(this[3] - rows[after][3]) <= deviation:
                join(this, rows[after])
                gone[after] = True
            continue
        while after < len(rows) and rows[after][4]:
            gone[after] = True
            after += 1
        a, b = out[-1] if out else None, rows[after] if after < len(rows) else None
        if a and b and abs(a[3] - b[3]) <= deviation:
            join(a, b)
            gone[after] = True
        elif a and (not b or a[1] - a[0] >= b[1] - b[0]):
            a[1] = this[1]
        elif b and b[0] > this[0]:
            b[0] = this[0]
    return [tuple(r[:4]) for r in out]


def random_chromosome(r, n):
    out, at = [], 1
    for _ in range(n):
        size = r.choice([5, 10, 40])
        out.append([at, at + size, r.randrange(1, 9), float(r.choice([0, 0.25, 0.5, 2])), r.random() < 0.3])
        at += size + r.choice([1, 1, 50])
    return out


def test_islands_equal_the_definition(spark):
    r = random.Random(4)
    given = {(s, c): random_chromosome(r, r.choice([0, 1, 2, 3, 5, 30, 60])) for s in "ABCDEF" for c in range(1, 12)}
    rows = [(s, c, *x) for (s, c), own in given.items() for x in own]
    df = spark.createDataFrame(rows, SEG + ", flag boolean").repartition(7)
    for width in (20, 20_000):
        got = {}
        for x in merge.remove_flagged(df, F.col("flag"), 0.3, merge=True, width=width).collect():
            got.setdefault((x.sample, x.chrom), []).append(tuple(x)[2:])
        for key, own in given.items():
            assert sorted(got.get(key, [])) == [(a, b, n, pytest.approx(v)) for a, b, n, v in plain_merge(own, 0.3)], key


def test_merging_of_nulls():
    fold = merge.Merging(0.5)
    rows = [((1, 5, None, 1.0), False), ((6, 9, 3, 1.0), False), ((10, 12, 2, None), False), ((13, 14, 2, 1.0), True), ((15, 30, 2, 1.0), False)]
    got = [x for row, flag in rows if (x := fold.add(row, flag))] + [fold.end()]
    assert got == [(1, 9, None, 1.0), (10, 12, 2, None), (13, 30, 2, 1.0)] and fold.end() is None


def test_filter_merge_keeps_rows_with_missing_numbers(spark, tmp_path):
    """Rows without a count or a state stay, each as it is, whether rows are merged or not."""
    rows = [("A", 1, 1, 10, None, 0.5), ("A", 1, 20, 30, 4, None), ("A", 1, 31, 40, 5, 3.0), ("A", 1, 100, 200, 5, 1.0)]
    names = [str(tmp_path / n) for n in ("q.seg", "r.segref", "a.seg", "b.seg", "c.seg")]
    files.write_segments(spark.createDataFrame(rows, SEG), names[0])
    files.write_segments(spark.createDataFrame([("R", 1, 100, 200, 1, 0.0)], SEG), names[1])
    commands.run(spark, ["filter", names[0], names[2], "--reference", names[1]])
    commands.run(spark, ["filter", names[0], names[3], "--reference", names[1], "--merge"])
    plain, merged = (sorted(files.read_segments(spark, n).collect(), key=lambda x: x.seg_start) for n in names[2:4])
    assert [tuple(x) for x in plain] == rows[:3] and [tuple(x)[:3] + tuple(x)[4:] for x in merged] == [x[:3] + x[4:] for x in rows[:3]]
    assert [x.seg_end for x in merged] == [10, 30, 200]  # what went extends the one before it
    commands.run(spark, ["filter", names[0], names[4], "--reference", names[1], "--inverse", "--merge"])
    assert [(x.seg_start, x.seg_end) for x in files.read_segments(spark, names[4]).collect()] == [(1, 200)]
    with pytest.raises(ValueError, match="unknown extension"):
        commands.run(spark, ["convert", names[0], str(tmp_path / "x.odd")])


def test_small_numbers_have_no_zeros_at_the_end(spark):
    df = spark.createDataFrame([(1e-5,), (1.25e-7,), (12.5,), (100.0,), (1e10,), (0.0,)], "x double")
    assert [r[0] for r in df.select(files.plain_number("x")).collect()] == ["1e-05", "1.25e-07", "12.5", "100", "1e+10", "0"]
