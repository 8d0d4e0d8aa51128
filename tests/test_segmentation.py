"""Segmentation by many tasks, its stopping rule, sums at places and containment, against plain models."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from chromaspan.operators import cbs, genes, intervals, segmentation, stats

RAW = "sample string, chrom int, pos long, value double"
SEG = "sample string, chrom int, seg_start long, seg_end long, n_markers long, state double"


def steps(r, n, ends, means, noise=0.3):
    x = r.normal(0, noise, n)
    for a, b, m in zip([0, *ends], [*ends, n], means, strict=True):
        x[a:b] += m
    return x


def rounded(rows):
    return sorted(((x.sample, x.chrom, x.seg_start, x.seg_end, x.n_markers, round(x.state, 9)) for x in rows), key=str)


@pytest.mark.parametrize("options", [{}, {"hybrid": True, "undo_prune": True}, {"eta": 0.05, "nperm": 60, "alpha": 0.05}])
def test_long_chromosomes_are_cut_as_short_ones(spark, options):
    """The same segments whether one task cuts a chromosome or many do, at any number of tasks."""
    r = np.random.default_rng(8)
    rows = []
    for sample, chrom, x in (("A", 1, steps(r, 900, [300, 340], [0, 2, 0])), ("A", 2, r.normal(size=400)), (None, 3, steps(r, 500, [100], [0, 0.5])), ("B", None, np.zeros(80))):
        rows += [(sample, chrom, int(p), float(v)) for p, v in zip(np.sort(r.integers(0, 60_000, len(x))), x, strict=True)]
    rows += [("C", 1, 5, None), ("C", 2, 7, 1.0)]
    raw = spark.createDataFrame(rows, RAW).repartition(5)
    whole = rounded(segmentation.segment_raw(raw, **options).collect())
    assert len(whole) >= 7
    for long, tasks in ((300, 3), (0, 1)):
        assert rounded(segmentation.segment_raw(raw, long=long, tasks=tasks, **options).collect()) == whole


def test_shares_of_the_arc_search_find_the_best_arc():
    for seed in range(12):
        r = np.random.default_rng(seed)
        x = r.integers(-2, 3, 400).astype(float) if seed % 2 else r.normal(size=400)
        x -= x.mean()
        s, m, _ = cbs._sums(x, None)
        want = cbs._best_arc(s, m, 3, None)
        for n in (2, 5):
            found = [cbs._best_arc(s, m, 3, None, share=(k, n)) for k in range(n)]
            assert min(found, key=lambda f: (-f[0], f[2] - f[1], f[1])) == want


def test_draws_depend_on_nothing_else():
    x = np.arange(50.0)
    a, b = cbs.draws(7, 3, 53), cbs.draws(7, 3, 53)
    assert [a(k).permutation(x).tolist() for k in (0, 5)] == [b(k).permutation(x).tolist() for k in (5, 0)][::-1]
    assert a(1).permutation(x).tolist() != a(2).permutation(x).tolist() != cbs.draws(8, 3, 53)(2).permutation(x).tolist()


@pytest.mark.parametrize(("nperm", "limit", "eta"), [(60, 2, 0.05), (200, 2, 0.05), (100, 9, 0.2)])
def test_stopping_errs_as_rarely_as_stated(nperm, limit, eta):
    """Permutations with one hit too many end with success in a share eta at most; with few hits far fewer are made."""
    ends = cbs.stopping(nperm, limit, eta)
    assert len(ends) == limit + 1 and list(ends) == sorted(ends) and ends[0] < nperm
    r, given = np.random.default_rng(1), cbs.Settings(nperm=nperm, eta=eta)
    wrong = 0
    for _ in range(4000):
        hits = np.zeros(nperm, bool)
        hits[r.choice(nperm, limit + 1, replace=False)] = True
        wrong += bool(cbs.confirmed(enumerate(hits.tolist()), limit, given))
    assert wrong / 4000 < eta + 3 * math.sqrt(eta / 4000)
    seen = []
    assert cbs.confirmed(((seen.append(k) or k, False) for k in range(nperm)), limit, given) and len(seen) == ends[0]
    assert cbs.stopping(nperm, limit, 0.0) == tuple([nperm] * (limit + 1))


def test_boundary_tail_is_that_of_changes_in_either_direction():
    """Against the share of simulated values whose best single change, up or down, reaches b."""
    r, m = np.random.default_rng(9), 200
    x = r.normal(size=(20_000, m))
    s = np.cumsum(x - x.mean(axis=1, keepdims=True), axis=1)[:, 1 : m - 2]
    i = np.arange(2, m - 1)
    best = np.abs(s / np.sqrt(i * (m - i) / m)).max(axis=1)
    for b in (3.0, 3.5):
        share = float((best >= b).mean())
        assert 0.75 * share < cbs.boundary_tail(b, m) < 1.35 * share
    assert [round(cbs.boundary_tail(b, 200), 4) for b in (3.0, 3.5, 4.0)] == [0.0775, 0.0164, 0.0027]


@pytest.mark.parametrize("width", [3, 50, 20_000])
def test_sums_at_places(spark, width):
    r = random.Random(5)
    segments = [(r.choice(["A", "B"]), r.choice([1, 2, None]), a := r.randrange(0, 900), a + r.choice([-1, 0, 3, 60, 700, 40_000]), 1, r.choice([None, float("nan"), 0.2, 1.0, -2.0, 30.0, 60.0])) for _ in range(250)]
    points = [(c, p) for c in (1, 2, 3, None) for p in (*range(0, 1700, 7), 39_999, 41_000)]
    df, at = spark.createDataFrame(segments, SEG), spark.createDataFrame([*points, *points[:9]], "chrom int, pos long")
    for direction in (1, -1):
        got = {(x.chrom, x.pos): x.value for x in stats.summarize(df, direction, 0.1, at, width).collect()}
        assert len(got) == len(points)
        for c, p in points:
            own = [x[5] for x in segments if x[1] == c and c is not None and x[2] <= p <= x[3]]
            up = [math.exp(direction * v) for v in own if v is not None and direction * v > 0.1]
            assert got[c, p] == pytest.approx(sum(up) / len(own) if up else 0.0, rel=1e-9)


def test_nodes_cover_each_bin_once(spark):
    spans = [(a, b) for a in (0, 1, 5, 15, 16, 17) for b in range(a, 300, 13)]
    df = spark.createDataFrame(spans, "a long, b long").withColumn("n", stats._covering_nodes("a", "b", 4, 3))
    for x in df.collect():
        bins = sorted(k for level, node in x.n for k in range(node * 4**level, (node + 1) * 4**level))
        assert bins == list(range(x.a, x.b + 1)) and len(x.n) <= 2 * 4 * 2 + max(0, (x.b - x.a) // 16 + 2)


@pytest.mark.parametrize("width", [4, 30, 20_000])
def test_containment_equals_the_definition(spark, width):
    r = random.Random(3)
    rows = [(f"g{k:03d}", r.choice([1, 1, 2, None]), a := r.randrange(0, 200), a + r.choice([0, 1, 5, 20, 150])) for k in range(220)]
    rows += [(f"h{k}", 2, 5, 9) for k in range(4)]
    got = {x.child: x.parent for x in intervals.self_containment(spark.createDataFrame(rows, "gene string, chrom int, seg_start long, seg_end long"), "gene", bin_width=width).collect()}
    want = {}
    for i, c, a, b in rows:
        around = [(e - s, j) for j, d, s, e in rows if c is not None and d == c and s <= a and b <= e and (s < a or b < e or j < i)]
        if around:
            want[i] = min(around)[1]
    assert got == want


def test_a_chain_of_nested_intervals(spark):
    n = 100_000
    df = spark.range(n).select(F.col("id").alias("gene"), F.lit(1).alias("chrom"), F.col("id").alias("seg_start"), (F.lit(3 * n) - F.col("id")).alias("seg_end"))
    got = intervals.self_containment(df, "gene")
    assert got.filter("parent = child - 1").count() == n - 1 == got.count()


def test_significance_of_overlaps(spark):
    """A set that the hits are made of is rare among draws, one of other genes isn't."""
    all_ = spark.range(400).select(F.format_string("G%d", "id").alias("gene"), (F.col("id") % 20).alias("k"))
    sets = all_.filter("k < 3").select(F.concat(F.lit("set"), "k").alias("set_name"), "gene")
    got = {x.set_name: x for x in genes.overlap_significance(sets, all_, all_.filter("k = 0"), 200).collect()}
    assert (got["set0"].n, got["set1"].n) == (20, 0) and got["set0"].p_value == pytest.approx(1 / 201) and got["set1"].p_value == 1
    assert 0.7 < got["set0"].mean_n < 1.3


def test_arc_search_grows_with_the_values(monkeypatch):
    """Noise of six times the values costs about six times the pairs of places that are looked at, and finds the plain search's arc."""
    looked = []
    divide = np.divide
    monkeypatch.setattr(np, "divide", lambda a, b, **k: (looked.append(np.size(a)), divide(a, b, **k))[1])
    counts = []
    for n in (6_000, 36_000):
        x = np.random.default_rng(3).normal(0, 1, n)
        looked.clear()
        cbs.largest_arc(x - x.mean(), 2)
        counts.append(sum(looked))
    assert counts[1] < 9 * counts[0]
    assert counts[1] < 150 * 36_000
    for n in (4, 5, 17, 33, 300):
        x = np.random.default_rng(n).integers(0, 3, n).astype(float)
        x -= x.mean()
        s = np.append(0.0, np.cumsum(x))
        arcs = [(float(n * (s[j] - s[i]) * (s[j] - s[i]) / ((j - i) * (n - j + i))), i - j, -i) for i in range(n + 1) for j in range(i + 2, n + 1) if j - i <= n - 2]
        most, length, i = max(arcs)
        assert cbs._best_arc(s, np.arange(n + 1.0), 2, None) == (most, -i, -i - length)


def test_smoothing_looks_around_few_values(monkeypatch):
    """Of values near their neighbours no windows are laid out; those far from both are judged by all of them."""
    looked = []
    nanmin = np.nanmin
    monkeypatch.setattr(np, "nanmin", lambda a, *rest: (looked.append(np.size(a)), nanmin(a, *rest))[1])
    x = np.random.default_rng(1).integers(0, 11, 5_000) / 100.0
    x[[0, 700, 4_999]] = 3.0, -3.0, 3.0
    x[[1_000, 1_005]] = 3.0  # another one as high is near by: both stay
    got = cbs.smooth(x, sd=0.03)
    assert sum(looked) < 5_000
    assert np.flatnonzero(got != x).tolist() == [0, 700, 4_999]
    assert got[700] == np.median(x[690:711]) - 0.06
