"""Kernels and operators against worked examples and plain models."""

import math
import random
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

from chromaspan import commands
from chromaspan.functions import alleles, coords, predicates
from chromaspan.operators import cbs, genes, intervals, merge, stats
from chromaspan.sources import files

SEG = "sample string, chrom int, seg_start long, seg_end long, n_markers long, state double"
A = [(1, 1000, 9000), (1, 9500, 12_000), (1, 20_000, 30_000), (1, 30_500, 60_000), (1, 70_000, 80_000), (2, 100, 900), (2, 1000, 3000), (2, 4000, 7000), (2, 8000, 20_000)]
B = [(1, 1010, 8990), (1, 20_000, 30_000), (1, 90_000, 99_000), (2, 100, 900), (2, 4100, 7050)]


def segs(spark, rows):
    return spark.createDataFrame([("S", c, s, e, n, float(v)) for c, s, e, n, v in rows], SEG)


def test_interval_filter(spark):
    q, r = segs(spark, [(*x, 9, 0) for x in A]), segs(spark, [(*x, 9, 0) for x in B])
    hit = [A[0], A[2], A[5], A[7]]
    for optimize in (True, False):
        got = {(x.chrom, x.seg_start, x.seg_end) for x in intervals.exists_filter(q, r, "dice", 0.8, optimize=optimize).collect()}
        assert got == set(A) - set(hit)
        got = {(x.chrom, x.seg_start, x.seg_end) for x in intervals.exists_filter(q, r, "dice", 0.8, inverse=True, optimize=optimize).collect()}
        assert got == set(hit)


def brute(kind, q, r):
    i = max(0, min(q[1], r[1]) - max(q[0], r[0]) + 1)
    a, b = q[1] - q[0] + 1, r[1] - r[0] + 1
    return {"dice": 2 * i / (a + b), "reference": i / b, "query": i / a, "union": i / (a + b - i), "min": i / max(a, b), "max": i / min(a, b)}[kind] if i else -1


@pytest.mark.parametrize("kind,t", [("dice", 0.2), ("reference", 0.5), ("query", 0.5), ("min", 0.5), ("max", 0.5), ("union", 0.34)])
def test_scores_at_edges(spark, kind, t):
    refs = [(10, 20), (25, 40), (50, 80), (55, 60), (120, 120), (5, 8), (90, 100), (130, 150), (200, 900_000)]
    queries = [(1, 5), (15, 18), (20, 25), (30, 35), (58, 58), (81, 90), (95, 95), (120, 120), (140, 145), (151, 155), (300, 870_000), (899_999, 900_100)]
    q, r = segs(spark, [(1, *x, 1, 0) for x in queries]), segs(spark, [(1, *x, 1, 0) for x in refs])
    want = {x for x in queries if any(brute(kind, x, y) >= t for y in refs)}
    for optimize in (True, False):
        for width in (7, 20_000):
            got = intervals.exists_filter(q, r, kind, t, inverse=True, optimize=optimize, bin_width=width)
            assert {(x.seg_start, x.seg_end) for x in got.collect()} == want


def test_overlap_join_lists_each_pair_once(spark):
    r = random.Random(2)
    make = lambda n: [(r.randrange(1, 3), s := r.randrange(1, 5000), s + int(10 ** (r.random() * 4))) for _ in range(n)]
    a, b = sorted(set(make(120))), sorted(set(make(120)))
    qa = spark.createDataFrame(a, "chrom int, s long, e long")
    rb = spark.createDataFrame(b, "c2 int, s2 long, e2 long")
    got = intervals.overlap_join(qa, rb, ("chrom", "s", "e"), ("c2", "s2", "e2"), bin_width=50).collect()
    assert sorted(map(tuple, got)) == sorted((*x, *y) for x in a for y in b if x[0] == y[0] and x[1] <= y[2] and y[1] <= x[2])


def test_predecessor(spark):
    starts = spark.createDataFrame([(1, 10), (1, 20), (1, 40)], "chrom int, start long")
    asked = {10: 0, 20: 1, 40: 2, 25: 1, 39: 1, 5: 0, 100: 2}
    points = spark.createDataFrame([(1, p) for p in asked], "chrom int, pos long")
    assert {r.pos: r.ordinal for r in intervals.predecessor(points, starts, ["chrom"]).collect()} == asked
    assert {r.pos: r.ordinal for r in intervals.predecessor(points, starts, ["chrom"], bin_width=7).collect()} == asked
    assert {r.ordinal for r in intervals.predecessor(points, starts.limit(0), ["chrom"]).collect()} == {0}


def test_running_count_in_bins(spark):
    r = random.Random(3)
    given = [(k, r.choice([1, 2, None]), r.randrange(300)) for k in range(200)]
    df = spark.createDataFrame(given, "id int, chrom int, pos long")
    want = {k: sum(1 for j, d, q in given if d == c and (q, j) <= (p, k)) for k, c, p in given}
    for width in (1, 13, 1000):
        assert {x.id: x._n for x in intervals.running_count(df, ["chrom"], "pos", ["id"], F.lit(1), width).collect()} == want


def test_resampled(spark):
    df = spark.createDataFrame([(f"G{k}",) for k in range(300)], "gene string")
    got = genes.resampled(df, 40).collect()
    assert sorted(got) == sorted(genes.resampled(df.repartition(7), 40).collect())  # whatever the partitions
    drawn = [sum(r.replicate == k for r in got) for k in range(40)]
    assert len({(r.replicate, r.gene) for r in got}) == len(got) and abs(sum(drawn) / 40 - 300 * (1 - math.exp(-1))) < 6
    assert genes.resampled(df.limit(0), 3).collect() == []


def test_allele_pairs(spark):
    x, y = alleles.pair(F.lit(2.0), F.lit(0.5)), alleles.pair(F.lit(1.0), F.lit(0.5))
    got = spark.range(1).select(alleles.added(x, y).alias("s"), alleles.scaled(x, 2).alias("t"), alleles.difference(y, x).alias("d"), alleles.near(x, y, 1.0).alias("n"), alleles.apart(x, y).alias("o"), alleles.at_most(x, 2.5).alias("l"), alleles.at_least(x, 2.6).alias("h")).first()
    assert (tuple(got.s), tuple(got.t), tuple(got.d), got.n, got.o, got.l, got.h) == ((3.0, 1.0), (4.0, 1.0), (1.0, 0.0), True, True, True, False)


def test_region_files(spark, tmp_path):
    (tmp_path / "r.txt").write_text("coord\tname\nchr3:5-9|G\tone\ttwo\nnonsense\tx\nchrX:1-2\n")
    got = files.read_regions(spark, str(tmp_path / "r.txt"), header=True).collect()
    assert [(r.chrom, r.region_start, r.region_end, r.state, r.rest) for r in got] == [("3", 5, 9, 1, "one\ttwo"), ("X", 1, 2, 0, None)]
    (tmp_path / "t.txt").write_text("chr3\t5\t9\nchr3\t5\t9\nchrX\t1\t2\n")
    assert [tuple(r) for r in files.read_region_table(spark, str(tmp_path / "t.txt")).collect()] == [(3, 5, 9)]


CASES = [
    ([(1, 100, 10, 0), (101, 110, 1, 2, 1), (111, 200, 10, 0.1)], [(1, 200, 20, 1 / 30)]),
    ([(1, 100, 10, 0), (101, 110, 1, 9, 1), (111, 120, 1, 9, 1), (121, 130, 3, 5)], [(1, 110, 10, 0), (121, 130, 3, 5)]),
    ([(1, 10, 10, 0), (11, 20, 1, 9, 1), (21, 30, 1, 9, 1), (31, 200, 3, 5)], [(1, 10, 10, 0), (11, 200, 3, 5)]),
    ([(1, 10, 1, 1), (11, 20, 1, 1), (21, 30, 1, 1), (31, 40, 1, 1)], [(1, 20, 2, 1), (21, 40, 2, 1)]),
    ([(1, 10, 1, 1), (11, 20, 1, 9, 1)], [(1, 20, 1, 1)]),
    ([(1, 10, 2, 9, 1)], []),
    ([(1, 10, 2, 9, 1), (11, 40, 3, 1)], [(1, 40, 3, 1)]),
]


@pytest.mark.parametrize("given,want", CASES)
def test_merge(spark, given, want):
    df = spark.createDataFrame([("S", 1, s, e, n, float(v), bool(f)) for s, e, n, v, f in ((*x, 0)[:5] for x in given)], SEG + ", flag boolean")
    got = sorted((r.seg_start, r.seg_end, r.n_markers, r.state) for r in merge.remove_flagged(df, F.col("flag"), 0.2, merge=True).collect())
    assert [g[:3] for g in got] == [w[:3] for w in want] and all(math.isclose(g[3], w[3], abs_tol=1e-9) for g, w in zip(got, want, strict=True))


def test_summary(spark):
    def run(rows, d, positions=None):
        df = segs(spark, [(1, s, e, 1, v) for s, e, v in rows])
        pos = None if positions is None else spark.createDataFrame([(1, p) for p in positions], "chrom int, pos long")
        return {r.pos: round(r.value, 9) for r in stats.summarize(df, d, 0.5, pos).collect()}

    one = [(10, 25, 0.2), (20, 35, 0.8), (30, 40, 0.1)]
    assert run(one, 1) == {10: 0, 20: 1.112770464, 25: 1.112770464, 30: 1.112770464, 35: 1.112770464, 40: 0}
    assert set(run(one, -1).values()) == {0}
    assert run([(10, 25, -0.2), (20, 35, -0.9), (30, 40, -0.1)], -1)[30] == 1.229801556
    assert run([(10, 20, 0.7), (10, 20, 0.2), (10, 20, 0.1)], 1) == {10: 0.671250902, 20: 0.671250902}
    got = run([(100, 120, 1.0), (200, 220, -1.0)], 1, [50, 100, 120, 150, 200, 220, 250])
    assert got == {50: 0, 100: 2.718281828, 120: 2.718281828, 150: 0, 200: 0, 220: 0, 250: 0}


def test_segmentation_of_steps():
    x1 = np.repeat([0, 1.5, 0], 20)
    assert cbs.segment(x1) == ([20, 20, 20], [0.0, 1.5, 0.0])
    x2 = np.repeat([0, 2, -1.5, 0], 15)
    assert cbs.segment(x2, w=np.repeat([1, 0.5, 2, 1], 15)) == ([15] * 4, [0.0, 2.0, -1.5, 0.0])
    assert cbs.segment(np.zeros(30)) == ([30], [0.0])
    rng = np.random.default_rng(3)
    noisy = np.concatenate([rng.normal(0, 0.2, 300), rng.normal(1, 0.2, 80), rng.normal(0, 0.2, 200)])
    for hybrid in (False, True):
        lengths, _ = cbs.segment(noisy, hybrid=hybrid, nperm=40)
        assert len(lengths) == 3 and abs(lengths[0] - 300) < 4 and abs(lengths[1] - 80) < 6
    assert len(cbs.segment(rng.normal(0, 1, 150), alpha=0.001, nperm=1000)[0]) == 1


def test_largest_arc_by_brute_force():
    rng = np.random.default_rng(1)
    for w in (None, rng.uniform(0.5, 2, 40)):
        x = rng.normal(size=40)
        x -= np.average(x, weights=w)
        v = np.ones(40) if w is None else w
        best = max((v.sum() * ((v * x)[i:j].sum()) ** 2 / (v[i:j].sum() * (v.sum() - v[i:j].sum())), i, j) for i in range(41) for j in range(i + 3, 41) if j - i <= 37)
        stat, i, j = cbs.largest_arc(x, 3, w)
        assert (i, j) == best[1:]
        tss = (v * x * x).sum()
        assert math.isclose(stat, best[0] / ((tss - best[0]) / 38))


def test_prune():
    rng = np.random.default_rng(5)
    x = np.concatenate([rng.normal(0, 0.1, 40), rng.normal(3, 0.1, 40)])
    assert cbs.prune(x, [20, 40, 55, 80], 0.1) == [40, 80]


def model_smooth(x, chrom, region, o, s, trim):
    ok = [k for k, v in enumerate(x) if math.isfinite(v)]
    y = [x[k] for k in ok]
    d = sorted(abs(b - a) for a, b in zip(y, y[1:], strict=False))
    keep = math.floor((1 - 2 * trim) * len(d) + 0.5)
    sd = math.sqrt(stats.inflation(trim) * sum(v * v for v in d[:keep]) / (2 * keep))
    out = list(x)
    for k, i in enumerate(ok):
        near = [j for j in range(k - region, k + region + 1) if 0 <= j < len(ok) and chrom[ok[j]] == chrom[i]]
        others = [y[j] for j in near if j != k]
        if others and min(abs(y[k] - v) for v in others) <= o * sd:
            continue
        med = float(np.median([y[j] for j in near]))
        if not others:
            out[i] = y[k] - s * sd
        elif y[k] > max(others):
            out[i] = med + s * sd
        elif y[k] < min(others):
            out[i] = med - s * sd
    return out


@pytest.mark.parametrize("x,chrom,region", [
    ([0, 0.05, -0.04, 5, 0.02, -0.03, 0.01, 0, 0, 0.02, 0.01, -4.5, -0.02, 0], [1] * 8 + [2] * 6, 10),
    ([0, math.nan, 0.1, 6, 0, 0.2, math.inf, 0.1, -5, 0], [1] * 5 + [2] * 5, 2),
])
def test_smoothing(x, chrom, region):
    got = cbs.smooth(np.array(x), np.array(chrom), region)
    assert np.allclose(got, model_smooth(x, chrom, region, 4.0, 2.0, 0.025), equal_nan=True)


def test_segment_command(spark, tmp_path):
    # Inputs and the segments that have to come of them.
    s1 = "-.2 -.1 0 1.1 1.2 1.0 .1 -.1 -.3 -.2 0 .9 1.0 1.1 .2 -.2".split()
    s2 = "-.4 -.3 -.2 0 .1 .2 1.4 1.5 -.5 -.4 -.2 0 .2 .1 1.3 1.4".split()
    lines = ["marker\tchromosome\tposition\tsample1\tsample2"] + [f"m{k}\t{1 + k // 8}\t{10 * (k % 8 + 1)}\t{a}\t{b}" for k, (a, b) in enumerate(zip(s1, s2, strict=True))]
    (tmp_path / "in.cn").write_text("\n".join(lines) + "\n")
    commands.run(spark, ["segment", str(tmp_path / "in.cn"), str(tmp_path / "out.seg")])
    got = sorted(map(tuple, files.read_segments(spark, str(tmp_path / "out.seg")).collect()))
    assert got == [("sample1", 1, 10, 80, 8, 0.375), ("sample1", 2, 10, 80, 8, 0.3125), ("sample2", 1, 10, 80, 8, 0.2875), ("sample2", 2, 10, 80, 8, 0.2375)]
    (tmp_path / "up.cn").write_text("\n".join(line.replace("-", "") for line in lines) + "\n")
    with pytest.raises(ValueError):
        commands.run(spark, ["segment", str(tmp_path / "up.cn"), str(tmp_path / "no.seg")])
    for command in (["convert", "in.cn", "c.seg"], ["filter", "out.seg", "f.seg", "--reference", str(tmp_path / "out.seg"), "--inverse", "--merge"], ["clean", "out.seg", "cl.seg", "--count", "3"]):
        commands.run(spark, [command[0], str(tmp_path / command[1]), str(tmp_path / command[2]), *command[3:]])
    assert len(files.read_segments(spark, str(tmp_path / "f.seg")).collect()) == 4


def test_coordinates(spark):
    df = spark.createDataFrame([("chr3:100-200|G",), ("chrX",), ("chr1:5-9(probes 12:45)|L tail",), ("chr1:5-9(probes 12-45)|G",), ("nowhere",)], "t string")
    got = [r.p and tuple(r.p) for r in df.select(coords.parse_region(F.col("t")).alias("p")).collect()]
    assert got == [("3", 100, 200, 0, 1), ("X", None, None, 0, 0), ("1", 5, 9, -32, -1), ("1", 5, 9, 0, 0), None]
    names = spark.createDataFrame([("chr1", 1), ("X", 23), ("chrY", 24), ("24", 24), ("chr23", 23), ("chrM", None), ("x", None), ("0", None)], "t string, want int")
    assert all(r.got == r.want for r in names.select("want", coords.chrom_id(F.col("t")).alias("got")).collect())
    pre = spark.createDataFrame([("s1.A", "s1.B", "s1"), ("abc", "abd", "ab"), (".x", ".y", "."), ("a", "b", "")], "a string, b string, want string")
    assert all(r.got == r.want for r in pre.select("want", coords.common_prefix(F.col("a"), F.col("b")).alias("got")).collect())


def test_state_scores(spark):
    t = predicates.StateThresholds(0.1, -0.1, math.log2(5 / 2), math.log2(0.7 / 2), 10_000_000, 12_000_000)
    df = spark.createDataFrame([(0.5, 1, 50_000_000, 1), (0.5, 1, 5_000_000, 2), (2.0, 1, 5_000_000, 3), (0.05, 1, 9, 0), (-0.5, 1, 50_000_000, -1), (-0.5, 1, 9, -2), (-2.0, 1, 9, -3), (0.0, 1, 9, 0)], "state double, s long, e long, want int")
    assert all(r.got == r.want for r in df.select("want", predicates.state_score(F.col("state"), F.col("s"), F.col("e"), t).alias("got")).collect())


def test_region_scores(spark):
    scored = segs(spark, [(1, 100, 109, 1, 0), (1, 200, 300, 1, 0)]).withColumn("score", F.when(F.col("seg_start") == 100, 3).otherwise(1))
    region = spark.createDataFrame([(1, 1, 100, 299)], "region_id long, r_chrom int, region_start long, region_end long")
    for least, want in ((0.0, 3), (0.1, 1), (0.6, 0)):
        assert [r.score for r in genes.region_scores(region, scored, ["region_id"], least=least).collect()] == [want]
    tie = scored.withColumn("score", F.when(F.col("seg_start") == 100, 2).otherwise(-2))
    assert [r.score for r in genes.region_scores(region, tie, ["region_id"]).collect()] == [-2]


def test_run_lengths(spark):
    raw = spark.createDataFrame([("S", f"m{k}", 1, 10 * k, float(v)) for k, v in enumerate([2, 2, 3, 2, 3, 3])], "sample string, marker string, chrom int, pos long, value double")
    got = sorted((r.seg_start, r.seg_end, r.n_markers, r.state) for r in merge.runs(raw).collect())
    assert got == [(0, 10, 2, 2.0), (20, 20, 1, 3.0), (30, 30, 1, 2.0), (40, 50, 2, 3.0)]


def test_split_raw_and_bands(spark, tmp_path):
    for s in ("a", "b"):
        (tmp_path / f"{s}.txt").write_text("v\n" + "".join(f"{k}.5\n" for k in range(3)))
    markers = spark.createDataFrame([(k, f"m{k}", 1, 10 * k) for k in range(4)], "ordinal long, marker string, chrom int, pos long")
    got = files.read_split_raw(spark, [str(tmp_path / "a.txt"), str(tmp_path / "b.txt")], markers, 0).collect()
    assert sorted((r.sample, r.pos, r.value) for r in got) == [(s, 10 * k, k + 0.5) for s in "ab" for k in range(3)]
    with pytest.raises(ValueError):
        files.read_split_raw(spark, str(tmp_path / "a.txt"), markers.limit(2), 0)
    (tmp_path / "bands").write_text("chr1\t0\t100\tp36.1\tgneg\nchr1\t100\t200\tq1\tgpos\n")
    assert [tuple(r) for r in files.read_cytobands(spark, str(tmp_path / "bands")).orderBy("band_start").collect()] == [("1", 0, 100, "p36.1", "gneg"), ("1", 100, 200, "q1", "gpos")]


def test_file_numbers(spark, tmp_path):
    (tmp_path / "x.seg").write_text("sample\tchrom\tstart\tend\tcount\tstate\nA\tchrX\t1\t9\t3\t0.25\nA\tchrM\t1\t9\t3\t1\nB\t2\t+5\t 7\t2.0\tNA\nC\t3\t1\t2\t1\tnan")
    got = [tuple(r) for r in files.read_segments(spark, str(tmp_path / "x.seg")).orderBy("sample").collect()]
    assert got[:2] == [("A", 23, 1, 9, 3, 0.25), ("B", 2, None, None, None, None)] and math.isnan(got[2][5])


def test_runs_within_epsilon(spark):
    rows = [("S", f"m{k}", 1, k, x) for k, x in enumerate([0.1 + 0.2, 0.3, 0.3 + 1e-5, None, None, 0.3])]
    raw = spark.createDataFrame(rows, "sample string, marker string, chrom int, pos long, value double")
    got = [(r.seg_start, r.n_markers, r.state) for r in merge.runs(raw).orderBy("seg_start").collect()]
    assert got == [(0, 2, 0.1 + 0.2), (2, 1, 0.3 + 1e-5), (3, 2, None), (5, 1, 0.3)]
    pairs = raw.withColumn("value", F.struct(F.col("value").alias("a"), F.lit(1.0).alias("b")))
    assert [r.n_markers for r in merge.runs(pairs).orderBy("seg_start").collect()] == [2, 1, 2, 1]
    assert [r.n_markers for r in merge.runs(raw, epsilon=1e-4).orderBy("seg_start").collect()] == [3, 2, 1]


def test_runs_across_bins_read_their_rows_twice_at_most(spark):
    rng = np.random.default_rng(4)
    rows, want = [], []
    for sample, chrom in (("A", 1), ("A", None), (None, 2), ("B", 1)):
        pos, value = np.cumsum(rng.choice([1, 2, 9, 60], 150)).tolist(), rng.choice([0.0, 1.0, np.nan], 150, p=[0.45, 0.45, 0.1])
        values = [None if math.isnan(v) else float(v) for v in np.repeat(value, rng.integers(1, 12, 150))[:150]]
        rows += [(sample, f"m{k:03d}", chrom, p, v) for k, (p, v) in enumerate(zip(pos, values, strict=True))]
        for p, v in zip(pos, values, strict=True):
            if want and want[-1][:2] == (sample, chrom) and want[-1][5] == v:
                want[-1] = (*want[-1][:3], p, want[-1][4] + 1, v)
            else:
                want.append((sample, chrom, p, p, 1, v))
    raw = spark.createDataFrame(rows, "sample string, marker string, chrom int, pos long, value double")
    for width in (7, 50, 100_000):
        assert sorted(map(tuple, merge.runs(raw, width=width).collect()), key=str) == sorted(want, key=str)
    assert merge.runs(raw)._jdf.queryExecution().optimizedPlan().toString().count("LogicalRDD") <= 2


def test_invalid_conversions_raise(spark):
    raw = spark.createDataFrame([("S", "m", 1, 1, 0.5)], "sample string, marker string, chrom int, pos long, value double")
    for kind, to in (("raw", "segmented_ascn"), ("raw", "raw_ascn"), ("segmented", "segmented_ascn")):
        with pytest.raises(ValueError, match="can't become"):
            files.convert(kind, raw, to)
    for path in ("x.lrrbaf", "x.txt", "x"):
        with pytest.raises(ValueError, match="unknown extension"):
            files.read_any(spark, path)


def test_an_interval_that_ends_before_it_starts_raises(spark):
    df = spark.createDataFrame([(1, 5), (7, 6)], "seg_start long, seg_end long")
    assert intervals.validated(df.limit(1)).count() == 1
    with pytest.raises(Exception, match="ends before it starts"):
        intervals.validated(df).collect()


def every_arc(x, al0, w, longest=None):
    """(sum of squares, length, start) of the best arc, the first of the shortest, by looking at all."""
    w, n = np.ones(len(x)) if w is None else w, len(x)
    found = []
    for k in range(al0, min(n - al0, longest or n) + 1):
        for i in range(n - k + 1):
            size, total = w[i : i + k].sum(), w.sum()
            found.append((total * (w[i : i + k] * x[i : i + k]).sum() ** 2 / (size * (total - size)) if size < total else 0, -k, -i))
    b, k, i = max(found)
    t = (w * x * x).sum()
    t = b + 1 if t <= b + 1e-4 else t
    return b / ((t - b) / (n - 2)), -i, -i - k


@pytest.mark.parametrize("seed", range(24))
def test_arcs_by_bounds_are_those_of_a_full_search(seed):
    r = np.random.default_rng(seed)
    x, al0, longest = r.normal(size=int(r.integers(20, 90))), int(r.integers(1, 5)), (None, 25)[seed % 2]
    x[5:9] += seed % 5
    w = r.random(len(x)) + 0.05 if seed % 3 else None
    x -= x.mean() if w is None else (w * x).sum() / w.sum()
    want = every_arc(x, al0, w, longest)
    got = cbs.largest_arc(x, al0, w, longest)
    assert math.isclose(got[0], want[0], rel_tol=1e-9) and got[1:] == want[1:]
    assert cbs.reaches(x, al0, got[0] * 0.999, w, longest) and not cbs.reaches(x, al0, got[0] * 1.001, w, longest)


def test_long_segments():
    x = np.random.default_rng(1).normal(size=80_000)
    x[30_000:31_000] += 0.8
    lengths, means = cbs.segment(x, seed=1)
    ends = np.cumsum(lengths)
    assert abs(ends[0] - 30_000) < 30 and abs(ends[1] - 31_000) < 30 and means[1] > 0.7


def test_least_weights():
    w = np.random.default_rng(2).random(12)
    m = np.concatenate([[0.0], np.cumsum(w)])
    circle = np.concatenate([w, w])
    assert np.allclose(cbs.least_weights(m, range(1, 12)), [min(circle[i : i + k].sum() for i in range(12)) for k in range(1, 12)])


def test_tails():
    assert math.isclose(cbs.nu(0.001), math.exp(-0.000583))
    for z in (0.5, 1.0, 2.0):  # the definition, summed far
        assert math.isclose(cbs.nu(z), 2 / z**2 * math.exp(-sum(math.erfc(z * math.sqrt(k / 8)) / k for k in range(1, 3000))), rel_tol=1e-4)
    got = [cbs.boundary_tail(b, 200) for b in (2.5, 3.0, 3.5, 4.0)]
    assert got == sorted(got, reverse=True)
    r = np.random.default_rng(3)
    i = np.arange(2, 199)
    s = np.cumsum(r.normal(size=(20_000, 200)), axis=1)
    z = np.abs(s[:, i - 1] - s[:, -1:] * i / 200) / np.sqrt(i * (200 - i) / 200)
    assert abs((z.max(1) >= 3.5).mean() - got[2]) < 0.003


def test_weighted_permutations():
    r = np.random.default_rng(4)
    one = lambda n: (r.normal(size=n), r.random(n) + 0.5)
    (a, wa), (b, wb) = one(30), one(50)
    assert cbs.weighted_permutation_p(a, b + 9, wa, wb, 50, r) == 0 and cbs.weighted_permutation_p(a[:1], b, wa[:1], wb, 50, r) == 1
    level = lambda f: np.mean([f() <= 0.2 for _ in range(200)])
    assert 0.1 < level(lambda: cbs.weighted_permutation_p(r.normal(size=20), r.normal(size=25), np.ones(20), np.ones(25), 100, r)) < 0.32
    assert 0.1 < level(lambda: cbs.permutation_p(r.normal(size=20), r.normal(size=25), 100, r)) < 0.32


def test_prune_is_the_best_of_all_subsets():
    r = np.random.default_rng(5)
    for _ in range(30):
        x = r.normal(size=40) + np.repeat(r.normal(size=4), 10) * 2
        ends = sorted({*(int(v) for v in r.integers(2, 39, 6)), 40})
        rest = lambda e: sum(((x[a:b] - x[a:b].mean()) ** 2).sum() for a, b in zip([0, *e], e))  # noqa: B023, B905, E731
        subsets = [[*s, 40] for k in range(len(ends)) for s in combinations(ends[:-1], k)]
        fewest = min(len(s) for s in subsets if rest(s) <= 1.05 * rest(ends) + 1e-12)
        got = cbs.prune(x, ends)
        assert len(got) == fewest and math.isclose(rest(got), min(rest(s) for s in subsets if len(s) == fewest), rel_tol=1e-9)


def test_smooth_samples_by_chromosome(spark):
    r = np.random.default_rng(6)
    rows = [("A", f"m{k}", 1 + k // 40, k, float(r.normal() + (9 if k % 17 == 0 else 0))) for k in range(100)]
    rows += [("A", "n", 1, 12, None), ("A", "x", 1, 13, float("nan")), ("A", "y", 3, 500, float("inf")), ("A", "z", 4, 1, 2.0), ("B", "m0", 1, 0, 3.0), (None, "m0", 1, 0, 1.0), (None, "m1", 1, 1, 4.0), ("C", "m0", 1, 0, None)]
    got = {(x["sample"], x.marker): x.value for x in cbs.smooth_raw(spark.createDataFrame(rows, "sample string, marker string, chrom int, pos long, value double")).collect()}
    for sample in ("A", "B", "C", None):
        own = sorted((x for x in rows if x[0] == sample), key=lambda x: (x[2], x[3], x[1]))
        want = cbs.smooth(np.array([x[4] for x in own], float), np.array([x[2] for x in own]))
        assert np.allclose(np.array([got[x[0], x[1]] for x in own], float), want, equal_nan=True)
    assert len(got) == len(rows)


def test_gene_tables(spark, tmp_path):
    (tmp_path / "r.txt").write_text("1\tT1\tchr3\t+\t10\t90\t20\t80\t2\t10,50,\t30,90,\t0\tG1\tcmpl\tcmpl\t0,0,\n1\tT2\tchrUn_x\t+\t1\t9\t2\t8\t1\t1,\t9,\t0\tG2\tcmpl\tcmpl\t0,\n")
    g = files.read_genes(spark, str(tmp_path / "r.txt")).collect()
    assert [(x.gene, x.transcript, x.g_chrom, x.strand, x.tx_start, x.tx_end, x.cds_start, x.cds_end, [tuple(e) for e in x.exons]) for x in g] == [("G1", "T1", 3, "+", 10, 90, 20, 80, [(10, 30), (50, 90)])]
    (tmp_path / "k.txt").write_text("T1\tchrX\t-\t10\t90\t20\t80\t1\t10,\t90,\tP\tA\nT9\tchr1\t-\t1\t2\t1\t2\t1\t1,\t2,\tP\tA\n")
    (tmp_path / "x.txt").write_text("T1\tm\ts\td\tSYM\tr\tp\ttext\n")
    assert [(x.gene, x.g_chrom) for x in files.read_genes(spark, str(tmp_path / "k.txt"), str(tmp_path / "x.txt")).collect()] == [("SYM", 23)]


def test_states_in_full_and_peaks(spark, tmp_path):
    files.write_segments(segs(spark, [(1, 1, 9, 3, 1 / 3)]), str(tmp_path / "f.seg"), full=True)
    assert files.read_segments(spark, str(tmp_path / "f.seg")).first().state == 1 / 3
    files.write_segments(segs(spark, [(1, 1, 9, 3, 1 / 3)]), str(tmp_path / "s.seg"))
    assert files.read_segments(spark, str(tmp_path / "s.seg")).first().state == 0.333333
    peaks = [("2", 5, 90, 10, 20, 8, 30, ["A", "B"], ["A"]), ("1", 1, 9, 2, 3, 2, 4, [], [])]
    df = spark.createDataFrame(peaks, "chrom string, region_start long, region_end long, peak_start long, peak_end long, wide_start long, wide_end long, region_genes array<string>, wide_genes array<string>")
    files.write_peaks(df, str(tmp_path / "p"))
    head, *lines = "".join(p.read_text() for p in sorted((tmp_path / "p").glob("part*"))).splitlines()
    assert len(head.split("\t")) == 15 and lines == ["1\t1\t1\t9\t2\t3\t2\t4\t0\t\t0\t", "2\t2\t5\t90\t10\t20\t8\t30\t2\tA,B\t1\tA"]
