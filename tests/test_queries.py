"""Every query with SQL against DuckDB on the same tables."""

import datetime
import math
from pathlib import Path

import duckdb
import pytest

from chromaspan.plans.queries import ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for p in Path(SF).glob("*.parquet"):
        c.sql(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return c


def rows(names, data):
    def plain(x):
        if isinstance(x, float):
            return None if math.isnan(x) else round(x, 6) + 0.0
        return x.isoformat() if isinstance(x, datetime.datetime) else x

    order = sorted(range(len(names)), key=lambda k: names[k])
    return [names[k] for k in order], sorted((tuple(plain(r[k]) for k in order) for r in data), key=str)


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query(spark, con, name):
    df = QUERIES[name](spark, SF)
    rel = con.sql(ORACLE_SQL[name])
    assert rows(df.columns, df.collect()) == rows(rel.columns, rel.fetchall())


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE_SQL)))
def test_runs(spark, name):
    assert QUERIES[name](spark, SF).count() > 0


@pytest.mark.parametrize(("name", "order"), [("t2_sorted_raw", "chrom pos sample"), ("t3_sorted_segments", "sample chrom seg_start seg_end"), ("t6_genes_by_start", "g_chrom tx_start gene")])
def test_rows_come_in_order(spark, name, order):
    """By collecting, and by reading written files one after the other."""
    got = [tuple(r[c] for c in order.split()) for r in QUERIES[name](spark, SF).collect()]
    assert len(got) > 50 and got == sorted(got)


def test_sorted_files_hold_rows_in_order(spark, tmp_path):
    from chromaspan import commands

    rows = QUERIES["t2_sorted_raw"](spark, SF).selectExpr("concat('m', pos) marker", "chrom", "pos").distinct().repartition(5, "pos")
    given, out = str(tmp_path / "markers"), tmp_path / "sorted"
    rows.write.option("sep", "\t").option("header", True).csv(given)
    commands.run(spark, ["sort", given, str(out)])
    lines = [x.split("\t") for p in sorted(out.glob("part-*")) for x in p.read_text().splitlines()[1:]]
    names = {"X": 23, "Y": 24}
    got = [(names.get(c) or int(c), int(p)) for _, c, p in lines]
    assert len(got) == rows.count() and got == sorted(got)
