"""Queries whose results are pairs, on tables with what larger ones have: places and names that repeat."""

import duckdb
import pandas as pd
import pytest
from pyspark.sql import functions as F

from chromaspan.operators import best, genes, intervals
from chromaspan.plans.queries import ORACLE_SQL, QUERIES

from .test_queries import SF, rows


@pytest.fixture(scope="module")
def repeated(tmp_path_factory):
    """Orders with one sample's segments at one place (keys 3,000,000 apart) up to five times and with whole rows twice;
    parts twice, some with another size or none; suppliers twice, and again under other keys."""
    d, c = tmp_path_factory.mktemp("repeated"), duckdb.connect()
    at = lambda t: f"'{SF}/{t}.parquet'"
    again = f"SELECT o.* REPLACE (o_orderkey + 3000000 * (i + 1) AS o_orderkey, o_totalprice * (1 + i * 0.3) AS o_totalprice) FROM {at('orders')} o, range(4) r(i) WHERE o_orderkey % 3 <> 0 OR i = 0"
    tables = {
        "orders": f"SELECT * FROM {at('orders')} UNION ALL {again} UNION ALL SELECT * FROM {at('orders')} WHERE o_orderkey % 11 = 0",
        "part": f"""SELECT * FROM {at('part')} UNION ALL SELECT * FROM {at('part')} WHERE p_partkey % 9 = 0 UNION ALL SELECT * REPLACE (p_size + 5 AS p_size) FROM {at('part')} WHERE p_partkey % 13 = 0
            UNION ALL SELECT * REPLACE (NULL AS p_size) FROM {at('part')} WHERE p_partkey % 20 = 0""",
        "supplier": f"SELECT * FROM {at('supplier')} UNION ALL SELECT * FROM {at('supplier')} UNION ALL SELECT * REPLACE (s_suppkey + 1000 AS s_suppkey) FROM {at('supplier')}",
    }
    for t, sql in tables.items():
        c.sql(f"COPY ({sql}) TO '{d}/{t}.parquet'")
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{d}/{t}.parquet'")
    return c, str(d)


@pytest.mark.parametrize("name", ["j12_overlap_pairs", "j26_exon_coverage", "j27_coding_coverage", "j29_annotate_segments", "s12_gene_tables", "a16_relaxed_in_regions"])
def test_places_and_names_repeat(spark, repeated, name):
    con, d = repeated
    df, rel = QUERIES[name](spark, d), con.sql(ORACLE_SQL[name])
    assert rows(df.columns, df.collect()) == rows(rel.columns, rel.fetchall())


def test_coverage_of_many_exons_and_ends(spark):
    """Exons and ends beyond those written out count; genes without exons or with unknown ones have no coverage."""
    some = [(10 * k, 10 * k + k % 7) for k in range(12)]
    g = spark.createDataFrame([("A", 1, 0, 120, some), ("B", 1, 50, 60, some[:3]), ("C", 1, 0, 99, []), ("D", 1, 0, 99, None)], "gene string, g_chrom int, tx_start long, tx_end long, exons array<struct<start: long, end: long>>")
    ends = [5, 40, 40, 77, 118]
    s = spark.createDataFrame([("S", 1, 3, e) for e in ends] + [("T", 1, 55, 58), ("T", 2, 55, 58)], "sample string, chrom int, seg_start long, seg_end long")
    share = lambda start, end, xs: sum(max(0, min(end, b) - max(start, a) + 1) for a, b in xs) / sum(b - a + 1 for a, b in xs)
    want = {("S", "A"): sum(share(3, e, some) for e in ends) / 5, ("S", "B"): sum(share(3, e, some[:3]) for e in ends[3:]) / 2, ("T", "A"): share(55, 58, some), ("T", "B"): 0.0}
    got = {(x.sample, x.gene): x.coverage for x in genes.coverage(s, g, ["sample", "seg_start"]).collect()}
    assert got == pytest.approx(want, abs=1e-9)


def test_generated_code_covers_exons(spark):
    """No lambda is met where pairs arise, as Spark's generated code ends there."""
    g = spark.createDataFrame([("A", 1, 0, 120, [(1, 9), (20, 30)])], "gene string, g_chrom int, tx_start long, tx_end long, exons array<struct<start: long, end: long>>")
    s = spark.createDataFrame([("S", 1, 3, 9)], "sample string, chrom int, seg_start long, seg_end long")
    plan = genes.coverage(s, g, ["sample", "seg_start"])._jdf.queryExecution().executedPlan().toString()
    assert "aggregate(" not in plan.split("SortMergeJoin")[0]
    assert genes.coverage(s, g, ["sample", "seg_start"]).select(F.sum("coverage")).first()[0] == round(7 / 20, 9)


def test_gene_lists_are_handed_on_in_parts(spark, monkeypatch):
    """However many lists a bin has, a task holds a part of them and one more at most."""
    seen = []

    def at_home(q, r, q_cols, r_cols, f, *args, **options):
        x = pd.DataFrame({"id": range(40), "_s": [k * 13 % 100 for k in range(40)], "_e": [k * 13 % 100 + 30 for k in range(40)]})
        y = pd.DataFrame({"gene": [f"G{k}" for k in range(50)] + [None], "_s": [2 * k for k in range(51)], "_e": [2 * k + 5 for k in range(51)]})
        seen.append((x, y, list(f(x, y))))
        return intervals.at_home(q, r, q_cols, r_cols, f, *args, **options)

    monkeypatch.setattr(genes, "at_home", at_home)
    rows = [(k, 1, k * 13 % 100, k * 13 % 100 + 30) for k in range(40)] + [(99, 2, 5, 9), (98, None, 5, 9)]
    again = [(k % 4, *x[1:]) for k, x in enumerate(rows)]
    g = spark.createDataFrame([(f"G{k}", 1, 2 * k, 2 * k + 5) for k in range(50)], "gene string, g_chrom int, tx_start long, tx_end long")
    for given in (rows, again):
        got = genes.genes_of(spark.createDataFrame(given, "id int, c int, s long, e long"), g, ["id"], ("c", "s", "e"), part=200)
        want = {}
        for i, c, s, e in given:
            want.setdefault(i, set()).update(f"G{k}" for k in range(50) if c == 1 and 2 * k <= e and s <= 2 * k + 5)
        assert {x.id: (x.n_genes, x.genes) for x in got.collect()} == {i: (len(v), ",".join(sorted(v))) for i, v in want.items()}
    for (x, y, parts), column in zip(seen, ("genes", "_g"), strict=True):
        one = max(len(",".join(v) if column == "_g" else v) for p in parts for v in p[column])
        assert len(parts) > 5 and sum(map(len, parts)) == len(x)
        assert all(sum(len(",".join(v) if column == "_g" else v) + 1 for v in p[column]) <= 200 + one + 1 for p in parts)


def test_scores_in_regions_are_handed_on_in_parts(monkeypatch):
    """However many pairs of regions and genes a bin has, a task lays out CHUNK places for them (or one region's genes) and hands on CHUNK scores."""
    monkeypatch.setattr(best, "CHUNK", 60)
    regions = pd.DataFrame({"region_id": range(30), "_s": [7 * k for k in range(30)], "_e": [7 * k + 40 for k in range(30)]})
    g = [(f"G{k}", 10 * k, 10 * k + 15) for k in range(20)]
    segs = [("ST"[k % 2], 6 * k, 6 * k + 9, k % 5 - 2) for k in range(40)]
    segs = [x for x in segs if x[3]]
    others = pd.concat([pd.DataFrame(g, columns=["gene", "_s", "_e"]).assign(_gene=True), pd.DataFrame(segs, columns=["sample", "_s", "_e", "score"]).assign(_gene=False)])
    laid, score = [], best.best_parts
    monkeypatch.setattr(best, "best_parts", lambda key, rule: lambda targets, segments: laid.append(len(targets)) or score(key, rule)(targets, segments))
    parts = list(best.best_in_regions(["region_id"], best.Rule(relaxed=True))(regions, others))
    want = {}
    for r in regions.itertuples(index=False):
        for name, gs, ge in g:
            for sample, s, e, v in segs:
                if max(r[1], gs, s) <= min(r[2], ge, e):
                    want.setdefault((r[0], name, sample), []).append((abs(v), -v))
    got = [tuple(x) for p in parts for x in p[["region_id", "gene", "sample", "score"]].itertuples(index=False)]
    assert sorted(got) == sorted((*k, -max(v)[1]) for k, v in want.items())
    assert max(laid) <= 60 and max(map(len, parts)) <= 60 and len(parts) >= 10
