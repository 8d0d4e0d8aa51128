"""Best segments, annotation and coverage without pairs, against plain models."""

import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from chromaspan.operators import genes, intervals, merge
from chromaspan.operators.best import Rule, best_scores

RULES = [Rule(relaxed=True), Rule(gain=0.3, loss=0.2), Rule(greatest=True), Rule(gain=0.8, loss=0.9)]


def share(s, e, exons):
    total = sum(b - a + 1 for a, b in exons)
    return sum(max(0, min(e, b) - max(s, a) + 1) for a, b in exons) / total if total else -1


@pytest.mark.parametrize("rule", RULES)
@pytest.mark.parametrize(("segments", "longest"), [(5, 300), (300, 30), (300, 300), (3000, 90)])
def test_best_scores_are_those_of_all_pairs(rule, segments, longest):
    r = random.Random(segments + longest)
    segs = [(r.choice("ABC"), r.choice([-3, -2, -1, 1, 2, 3]), s := r.randrange(-50, 1000), s + r.randrange(longest)) for _ in range(segments)]
    targets = []
    for g in range(30):
        at, exons = r.randrange(1000), []
        for _ in range(r.choice([0, 1, 2, 3, 6])):
            a = at + r.randrange(r.random() > 0.1, 20)
            exons.append((a, a + r.randrange(20)))
            at = a if r.random() < 0.1 else exons[-1][1] + 1
        targets.append((f"g{g}", min([at, *(a for a, _ in exons)]), max([at, *(b for _, b in exons)]), [a for a, _ in exons], [b for _, b in exons]))
    got = best_scores(["gene"], rule)(pd.DataFrame(targets, columns=["gene", "_s", "_e", "_xs", "_xe"]), pd.DataFrame(segs, columns=["sample", "score", "_s", "_e"]))
    want = {}
    for gene, s, e, xs, xe in targets:
        for sample in "ABC":
            met = [(share(a, b, list(zip(xs, xe, strict=True))), v) for q, v, a, b in segs if q == sample and a <= e and s <= b]
            if rule.greatest:
                met = [(x, -v) for x, v in met]
            elif rule.relaxed:
                met = [(abs(v), -v) for _, v in met]
            else:
                met = [(abs(v), -v) for x, v in met if x > (rule.gain if v > 0 else rule.loss)]
            if met:
                want[gene, sample] = -max(met)[1]
    assert {(x.gene, x.sample): x.score for x in got.itertuples()} == want


def dense(spark, n=60_000):
    """Segments and genes that lie a thousand deep, so that pairs are many times the rows."""
    segs = spark.range(n).selectExpr("concat('S', id % 2) sample", "1 chrom", "id * 7919 % 30000 + 1 seg_start", "id * 7919 % 30000 + 1 + id % 997 seg_end", "cast(id % 7 - 3 as int) score")
    g = spark.range(400).selectExpr("concat('G', id) gene", "1 g_chrom", "id * 61 % 30000 + 1 tx_start", "id * 61 % 30000 + 901 tx_end")
    return segs, g.withColumn("exons", F.expr("array(struct(tx_start as start, tx_start + 300 as end), struct(tx_end - 300 as start, tx_end as end))"))


def shuffled_rows(df):
    """The most rows that one shuffle of df's plan writes."""
    df.collect()
    plan, out = df._jdf.queryExecution().executedPlan().finalPhysicalPlan(), []

    def walk(p):
        if "shuffleRecordsWritten" in str(p.metrics().keys()):
            out.append(p.metrics().apply("shuffleRecordsWritten").value())
        name = p.nodeName()
        for inner in [p.plan()] if name == "ShuffleQueryStage" else []:
            walk(inner)
        children = p.children()
        for k in range(children.length()):
            walk(children.apply(k))

    walk(plan)
    return max(out)


@pytest.mark.parametrize("options", [{"gain": 0.3, "loss": 0.2}, {"relaxed": True}, {"relaxed": True, "greatest": True}])
def test_gene_scores_shuffle_no_pairs(spark, options):
    segs, g = dense(spark)
    assert shuffled_rows(genes.gene_scores(g, segs, **options)) < 150_000  # pairs: 2 million


def test_relaxed_scores_in_regions_shuffle_no_pairs(spark):
    segs, g = dense(spark)
    regions = spark.range(2000).selectExpr("id region_id", "1 r_chrom", "id * 13 + 1 region_start", "id * 13 + 3000 region_end")
    assert shuffled_rows(genes.scores_in_regions(regions, g, segs, ["region_id"], relaxed=True).groupBy().count()) < 150_000  # pairs of regions and genes: 200,000


def test_relaxed_scores_in_regions_are_those_of_all_pairs(spark):
    r = random.Random(11)
    make = lambda n, long: [(r.randrange(1, 3), s := r.randrange(50_000), s + r.randrange(long)) for _ in range(n)]
    regions, gs, segs = [(k % 20, *x) for k, x in enumerate(make(25, 60_000))], make(30, 9000), [("ST"[k % 2], *x, k % 7 - 3) for k, x in enumerate(make(40, 20_000))]
    want = {}
    for i, c, s, e in regions:
        for k, (c2, s2, e2) in enumerate(gs):
            for sample, c3, s3, e3, v in segs:
                if v and c == c2 == c3 and max(s, s2, s3) <= min(e, e2, e3):
                    want.setdefault((i, f"G{k}", sample), []).append((abs(v), -v))
    given = [spark.createDataFrame(regions, "region_id long, r_chrom int, region_start long, region_end long"), spark.createDataFrame([(f"G{k}", *x) for k, x in enumerate(gs)], "gene string, g_chrom int, tx_start long, tx_end long")]
    scored = spark.createDataFrame(segs, "sample string, chrom int, seg_start long, seg_end long, score int")
    got = genes.scores_in_regions(*given, scored, ["region_id"], relaxed=True).collect()
    assert len(got) == len(want) > 100
    assert {(x.region_id, x.gene, x.sample): x.score for x in got} == {k: -max(v)[1] for k, v in want.items()}


@pytest.mark.parametrize("adaptive", ["true", "false"])
def test_genes_in_regions_are_not_broadcast(spark, adaptive):
    """Regions seem small by what they are made of; in bins they are many more rows, which a broadcast takes through the driver."""
    before = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", adaptive)
    try:
        regions = spark.range(300).selectExpr("id region_id", "cast(id % 2 as int) r_chrom", "id * 131 % 30000 region_start", "id * 131 % 30000 + 3000 region_end")
        g = spark.range(200).selectExpr("concat('G', id) gene", "cast(id % 2 as int) g_chrom", "id * 61 % 30000 tx_start", "id * 61 % 30000 + 900 tx_end")
        got = genes.inside(regions, g, ["region_id"])
        want = {(i, f"G{k}") for i in range(300) for k in range(200) if i % 2 == k % 2 and i * 131 % 30000 <= k * 61 % 30000 + 900 and k * 61 % 30000 <= i * 131 % 30000 + 3000}
        rows = got.collect()
        assert len(rows) == len(want) > 1000 and {(r.region_id, r.gene) for r in rows} == want
        assert "Broadcast" not in got._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", before)


def test_rows_of_one_gene_are_one_target(spark):
    segs = spark.createDataFrame([("S", 1, 10, 20, 2), ("S", 2, 10, 20, -3), ("T", 1, 100_000, 900_000, 1)], "sample string, chrom int, seg_start long, seg_end long, score int")
    g = spark.createDataFrame([("A", 1, 1, 30), ("A", 2, 1, 30), ("B", 1, 1, 5_000_000), ("C", None, 1, 30)], "gene string, g_chrom int, tx_start long, tx_end long")
    got = genes.gene_scores(g, segs, relaxed=True)
    assert {(r.gene, r.sample, r.score) for r in got.collect()} == {("A", "S", -3), ("B", "S", 2), ("B", "T", 1)}


def test_united_intervals_and_scores_in_any_region(spark):
    r = random.Random(5)
    make = lambda n, long: [(r.randrange(1, 3), s := r.randrange(200), s + r.randrange(long)) for _ in range(n)]
    regions, gs, segs = make(12, 12), make(30, 9), [("ST"[k % 2], *x, k % 7 - 3) for k, x in enumerate(make(60, 20))]
    df = spark.createDataFrame(regions, "r_chrom int, region_start long, region_end long")
    for width in (7, 20_000):
        got = [tuple(x) for x in genes.united(df, ["r_chrom"], ("region_start", "region_end"), width).collect()]
        places = [(c, p) for c, s, e in got for p in range(s, e + 1)]
        assert len(places) == len(set(places)) and set(places) == {(c, p) for c, s, e in regions for p in range(s, e + 1)}
    want = {}
    for k, (c, s, e) in enumerate(gs):
        for sample, c2, s2, e2, v in segs:
            if v and any(c == c2 == c3 and max(s, s2, s3) <= min(e, e2, e3) for c3, s3, e3 in regions):
                want.setdefault((f"G{k}", sample), []).append((abs(v), -v))
    g = spark.createDataFrame([(f"G{k}", *x) for k, x in enumerate(gs)], "gene string, g_chrom int, tx_start long, tx_end long")
    scored = spark.createDataFrame(segs, "sample string, chrom int, seg_start long, seg_end long, score int")
    assert {(x.gene, x.sample): x.score for x in genes.scores_in_any_region(df, g, scored).collect()} == {k: -max(v)[1] for k, v in want.items()}


def test_exons_beyond_the_unrolled_ones_count(spark):
    df = spark.createDataFrame([(list(zip(range(1, 200, 10), range(5, 200, 10), strict=True)), 3, 97), ([(1, 4)], 2, 3), ([], 1, 2), (None, 1, 2)], "exons array<struct<start: long, end: long>>, s long, e long")
    got = df.filter("size(exons) > 0").select(genes.covered("exons", F.col("s"), F.col("e")).alias("c")).collect()
    assert [x.c for x in got] == [48 / 100, 0.5]
    assert df.filter("exons is null").select(genes.covered("exons", F.col("s"), F.col("e")).alias("c")).first().c is None


def test_genes_of_regions_with_shared_keys_and_without_places(spark):
    r = random.Random(8)
    regions = [(k % 9 if k < 20 else k, r.randrange(1, 3), s := r.randrange(60_000), s + int(10 ** (r.random() * 5))) for k in range(40)] + [(99, None, 1, 2), (98, 7, 1, 2)]
    gs = [(f"G{k % 70}" if k < 90 else None, r.randrange(1, 3), s := r.randrange(60_000), s + r.randrange(3000)) for k in range(100)]
    df, g = spark.createDataFrame(regions, "region_id int, c int, s long, e long"), spark.createDataFrame(gs, "gene string, g_chrom int, tx_start long, tx_end long")
    for some in (regions, regions[20:]):  # with keys of several rows, and without
        want = {k: sorted({n for k2, c, s, e in some for n, c2, s2, e2 in gs if k2 == k and n and c == c2 and s <= e2 and s2 <= e}) for k, *_ in some}
        rows = df if some is regions else df.filter("region_id >= 20")
        got = genes.genes_of(rows, g, ["region_id"], ("c", "s", "e")).collect()
        assert len(got) == len(want) and {x.region_id: x.genes for x in got} == {k: ",".join(v) for k, v in want.items()} and all(x.n_genes == len(want[x.region_id]) for x in got)
        near = genes.inside(rows.dropna(), g.dropna(), ["region_id"], ("c", "s", "e"))
        assert sorted(map(tuple, near.collect())) == sorted((k, n) for k, v in want.items() for n in v)


@pytest.mark.parametrize("alleles", [False, True])
def test_raw_values_are_of_the_first_segment_to_start(spark, alleles):
    r = random.Random(3)
    segs = [("ST"[k % 2], r.randrange(1, 3), s := r.randrange(100), s + r.randrange(20), r.choice([None, 0.5, 1.0])) for k in range(80)]
    df = spark.createDataFrame(segs, "sample string, chrom int, seg_start long, seg_end long, state double")
    if alleles:
        df = df.withColumn("state", F.when(F.col("state").isNotNull(), F.struct(F.col("state").alias("a"), F.lit(1).alias("b"))))
    markers = spark.createDataFrame([(c, p, f"{c}:{p}") for c in (1, 2, 3) for p in range(0, 130, 3)], "chrom int, pos long, marker string")
    got = {(x.sample, x.chrom, x.pos): x.value for x in merge.to_raw(df, markers.union(markers.limit(1))).collect()}
    for (sample, c, p), value in got.items():
        met = [(s, e, (v is not None, v or 0)) for q, c2, s, e, v in segs if q == sample and c == c2 and s <= p <= e]
        want = min(met)[2] if met else (False, 0)
        assert (None if not want[0] else (want[1], 1) if alleles else want[1]) == (tuple(value) if alleles and value else value)
    assert len(got) == 2 * 3 * 44


def test_few_bytes_with_many_pairs_are_dealt_to_many_tasks(spark):
    """By bytes all of this is one task's."""
    q = spark.range(3000).selectExpr("id % 24 c", "id * 7919 % 1000000 s", "id * 7919 % 1000000 + 20000 e")
    r = spark.range(3000).selectExpr("id % 24 c2", "id * 4099 % 1000000 s2", "id * 4099 % 1000000 + 5000 e2")
    got = intervals.overlap_join(q, r, ("c", "s", "e"), ("c2", "s2", "e2"))
    assert got.rdd.getNumPartitions() == int(spark.conf.get("spark.sql.shuffle.partitions"))


def test_pairs_come_by_start_and_only_levels_that_are_there_are_dealt(spark, monkeypatch):
    """Neighbours with the same partners follow each other, so that written pairs compress; no row is dealt to a level without rows."""
    dealt, binned = [], intervals._binned
    monkeypatch.setattr(intervals, "_binned", lambda df, start, end, width, levels, own: dealt.append(levels) or binned(df, start, end, width, levels, own))
    q = [(1 + k % 2, k * 7919 % 20_000, k * 7919 % 20_000 + k % 50 * 100) for k in range(300)] + [(None, 5, 9), (1, None, 9), (1, 5, None)]
    r = [(1 + k % 2, k * 4099 % 20_000, k * 4099 % 20_000 + k % 70 * 90) for k in range(100)] + [(None, 5, 9)]
    a, b = spark.createDataFrame(q, "c int, s long, e long").repartition(5), spark.createDataFrame(r, "c2 int, s2 long, e2 long").repartition(3)
    for longest, levels in ((6210, 1), (8 * 20_000 * 64 + 1, 3)):
        more = [(1, 0, longest)]
        got = intervals.overlap_join(a, b.union(spark.createDataFrame(more, b.schema)), ("c", "s", "e"), ("c2", "s2", "e2"))
        tasks = [[tuple(x) for x in t] for t in got.rdd.glom().collect()]
        want = [x + y for x in q for y in r + more if None not in x + y and x[0] == y[0] and x[1] <= y[2] and y[1] <= x[2]]
        assert sorted(sum(tasks, [])) == sorted(want) and set(dealt) == {levels}
        dealt.clear()
    got = intervals.overlap_join(a, b, ("c", "s", "e"), ("c2", "s2", "e2"), bin_width=1_000_000, levels=1)
    for t in got.rdd.glom().collect():
        for c in (1, 2):
            starts = [(x.s, x.e, x.s2) for x in t if x.c == c]
            assert [x[0] for x in starts] == sorted(x[0] for x in starts)
            assert all(x[2] <= y[2] for x, y in zip(starts, starts[1:]) if x[:2] == y[:2])
