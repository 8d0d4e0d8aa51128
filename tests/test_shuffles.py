"""How many rows the scans' plans send through shuffles, and results on odd rows."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from chromaspan.operators import cbs, stats

RAW = "sample string, chrom int, pos long, marker string, value double"
KEYS, ORDER = ["sample", "chrom"], ["pos", "marker"]


def metrics(df, kind, name):
    """The result, and what each node of such a kind counted in the plan that ran, largest first; reused ones once."""
    got, out, todo, seen = df.collect(), [], [df._jdf.queryExecution().executedPlan()], set()
    while todo:
        p = todo.pop()
        node = p.getClass().getSimpleName()
        if node == "AdaptiveSparkPlanExec":
            todo.append(p.executedPlan())
        elif node.endswith("QueryStageExec"):
            todo.append(p.plan())
        elif node != "ReusedExchangeExec" and p.id() not in seen:
            seen.add(p.id())
            if node.endswith(kind):
                out.append(p.metrics().apply(name).value())
            todo += [p.children().apply(i) for i in range(p.children().size())]
    return got, sorted(out, reverse=True)


def shuffled(df):
    return metrics(df, "ShuffleExchangeExec", "shuffleRecordsWritten")


def plain_runs(rows):
    """{marker: (number, length)} of one key's rows in order."""
    starts = [k for k in range(len(rows)) if not k or rows[k][4] != rows[k - 1][4]]
    return {r[3]: (sum(s <= k for s in starts), next((s for s in starts if s > k), len(rows)) - max(s for s in starts if s <= k)) for k, r in enumerate(rows)}


@pytest.fixture(scope="module")
def many(spark):
    """4000 rows a key in 40 bins of 1000 places, dealt anyhow."""
    r = random.Random(3)
    rows = [(s, c, 10 * k, f"m{k:05d}", float(r.randrange(3))) for s in ("A", None) for c in (1, 2) for k in range(4000)]
    df = spark.createDataFrame(rows, RAW).repartition(6).localCheckpoint()
    return df, rows


def test_run_ids_shuffle_rows_once(many):
    df, rows = many
    got, wrote = shuffled(stats.run_ids(df, KEYS, ORDER, "value", 1000))
    assert len(got) == len(rows) and wrote[0] == len(rows)
    assert sum(wrote[1:]) < 0.2 * len(rows)  # a bin has two pieces of runs at most


@pytest.mark.parametrize("width", [1, 10, 1000])
def test_run_ids_of_odd_rows(spark, width):
    """Runs over many bins, bins of one run, a bin's ends alike but not one run, nulls as values and keys, no place, rows twice."""
    patterns = {("A", 1): "a" * 25, ("A", 2): "aba" * 8, ("B", 1): "aaabbbbbbbbbbbbbbbbbbba", (None, 1): "abcabc--aa--", ("C", None): "-", ("D", 4): "-" * 12}
    given = {key: [(*key, 3 * k - 9, f"m{k:03d}", None if x == "-" else float(ord(x))) for k, x in enumerate(p)] for key, p in patterns.items()}
    given["E", 1] = [("E", 1, None, "m0", 1.0), ("E", 1, 5, "m1", 1.0), ("E", 1, 5, "m2", 2.0), ("E", 1, 500, "m3", 2.0)]
    rows = [x for own in given.values() for x in own]
    got = {(r.sample, r.chrom, r.marker): (r.run_id, r.run_length) for r in stats.run_ids(spark.createDataFrame(rows, RAW).repartition(3), KEYS, ORDER, "value", width).collect()}
    assert got == {(*key, m): x for key, own in given.items() for m, x in plain_runs(own).items()}
    twice = stats.run_ids(spark.createDataFrame([x for x in given["B", 1] for _ in range(2)], RAW), KEYS, ORDER, "value", width)
    assert sorted((r.marker, r.run_id, r.run_length) for r in twice.collect()) == sorted((m, n, 2 * k) for m, (n, k) in plain_runs(given["B", 1]).items() for _ in range(2))
    none = stats.run_ids(spark.createDataFrame([], RAW), KEYS, ORDER, "value", width)
    assert none.collect() == [] and [f.simpleString() for f in none.schema][-2:] == ["run_id:bigint", "run_length:bigint"]
    nan = stats.run_ids(spark.createDataFrame([("A", 1, k, f"m{k}", v) for k, v in enumerate((math.nan, math.nan, 0.0, -0.0))], RAW), KEYS, ORDER, "value", width)
    assert sorted((r.marker, r.run_id, r.run_length) for r in nan.collect()) == [("m0", 1, 2), ("m1", 1, 2), ("m2", 2, 2), ("m3", 2, 2)]


@pytest.mark.parametrize("scope", ["sample", "chromosome"])
def test_smoothing_joins_no_rows(many, scope):
    """Deviations are joined with the bins' summaries, which hand them on."""
    df, rows = many
    got, joined = metrics(cbs.smooth_raw(df, scope, region=3, outlier_sd=0.5, rows=1000, width=1000), "JoinExec", "numOutputRows")
    assert len(got) == len(rows) and joined and joined[0] < 0.1 * len(rows)


@pytest.mark.parametrize("scope", ["sample", "chromosome"])
def test_smoothing_deals_rows_once_for_all_scans(many, scope):
    """The rows are shuffled for the scans, their keys alone to count them, and once more into bins of rows; no join shuffles them."""
    df, rows = many
    got, wrote = shuffled(cbs.smooth_raw(df, scope, region=3, outlier_sd=0.5, rows=1000, width=1000))
    assert len(got) == len(rows) and sum(wrote) < 3.5 * len(rows)


@pytest.mark.parametrize("scope", ["sample", "chromosome"])
@pytest.mark.parametrize("kind", ["double", "float"])
def test_smoothing_of_odd_rows(spark, scope, kind):
    """Nulls as keys, values and places, values that aren't finite, rows twice, one value, no rows; values that are cast."""
    r = random.Random(11)
    odd = [None, math.nan, math.inf, -math.inf]
    rows = [(s, c, r.choice([k, k, None if k < 2 else k]), f"m{k:03d}", r.choice(odd) if r.random() < 0.2 else r.choice([0.0, 0.25, 0.5, 8.0])) for s, c in (("A", 1), ("A", 2), ("A", None), (None, 1), (None, None)) for k in range(60)]
    rows += [("D", 1, 5, "m", 2.0), ("E", 1, 5, "m", None)]
    rows += [x for x in rows if x[0] == "A" and x[1] == 2]
    df = spark.createDataFrame(rows, RAW).withColumn("n", F.lit(1)).withColumn("value", F.col("value").cast(kind)).repartition(3)
    by_key = {}
    for x in sorted(rows, key=lambda x: (x[2] is not None, x[2] or 0, x[3])):
        by_key.setdefault(x[:2], []).append(x)
    finite = {k: np.array([x[4] for x in own if x[4] is not None and math.isfinite(x[4])]) for k, own in by_key.items()}
    want = []
    for key, own in by_key.items():
        of = [v for k, v in sorted(finite.items(), key=lambda t: (t[0][1] is not None, t[0][1] or 0)) if k[0] == key[0]] if scope == "sample" else [finite[key]]
        smoothed = iter(cbs.smooth(finite[key], region=4, outlier_sd=0.5, sd=math.sqrt(cbs.trimmed_variance(np.concatenate(of)))))
        want += [(*x[:4], round(float(next(smoothed)), 9) if x[4] is not None and math.isfinite(x[4]) else x[4]) for x in own]
    got = [(x["sample"], x.chrom, x.pos, x.marker, x.value if x.value is None or not math.isfinite(x.value) else round(x.value, 9)) for x in cbs.smooth_raw(df, scope, region=4, outlier_sd=0.5, rows=7, width=9).select("sample", "chrom", "pos", "marker", "value").collect()]
    assert sorted(map(repr, got)) == sorted(map(repr, want))
    assert cbs.smooth_raw(df.filter("false"), scope).collect() == []
