"""Copy-number shapes derived from the test tables: one SQL text for Spark and for DuckDB."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

TABLES = ["orders", "lineitem", "part", "supplier", "nation", "region", "customer", "events"]

VIEWS = {
    "v_seg": """SELECT concat('S', CAST(o_custkey % 20 AS varchar(10))) AS sample, CAST(o_orderkey % 24 + 1 AS INT) AS chrom,
        (o_orderkey * 7919) % 1000000 + 1 AS seg_start, (o_orderkey * 7919) % 1000000 + 1 + CAST(floor(o_totalprice) AS BIGINT) % 5000 AS seg_end,
        o_orderkey % 200 + 1 AS n_markers, CAST(o_custkey % 101 - 50 AS DOUBLE) / CAST(50 AS DOUBLE) AS state FROM {orders}""",
    "v_ref": """SELECT DISTINCT CAST(l_partkey % 24 + 1 AS INT) AS chrom, (l_orderkey * 6101 + l_linenumber * 131) % 1000000 + 1 AS seg_start,
        (l_orderkey * 6101 + l_linenumber * 131) % 1000000 + 1 + CAST(floor(l_quantity) AS BIGINT) * 100 AS seg_end FROM {lineitem}""",
    "v_raw": """SELECT concat('S', CAST(l_suppkey % 10 AS varchar(10))) AS sample, CAST(l_partkey % 24 + 1 AS INT) AS chrom, l_orderkey * 8 + l_linenumber AS pos,
        concat(CAST(CAST(l_partkey % 24 + 1 AS INT) AS varchar(10)), ':', CAST(l_orderkey * 8 + l_linenumber AS varchar(20))) AS marker,
        max(l_discount) - CAST(0.05 AS DOUBLE) AS value, CAST(max(CAST(floor(l_quantity) AS INT)) % 3 AS INT) AS cn
        FROM {lineitem} GROUP BY l_suppkey % 10, l_partkey % 24 + 1, l_orderkey * 8 + l_linenumber""",
    "v_gene": """SELECT concat('G', CAST(p_partkey AS varchar(10))) AS gene, CAST(p_partkey % 24 + 1 AS INT) AS g_chrom, (p_partkey * 4099) % 1000000 + 1 AS tx_start,
        (p_partkey * 4099) % 1000000 + 1 + p_size * 200 AS tx_end, CAST(p_size AS BIGINT) AS p_size, p_brand FROM {part}""",
    "v_region": """SELECT s_suppkey AS region_id, CAST(s_suppkey % 24 + 1 AS INT) AS r_chrom, (s_suppkey * 104729) % 900000 + 1 AS region_start,
        (s_suppkey * 104729) % 900000 + 1 + s_suppkey % 17 * 2000 + 500 AS region_end FROM {supplier}""",
    "v_point": """SELECT DISTINCT CAST(event_id % 24 + 1 AS INT) AS p_chrom, (event_id * 3571) % 1000000 + 1 AS pos FROM {events}""",
}


def spark_view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.sql(VIEWS[name].format(**{t: f"parquet.`{sf_dir}/{t}.parquet`" for t in TABLES}))


def with_views(sql: str) -> str:
    """SQL preceded by the views that it names."""
    used = [f"{n} AS ({v.format(**{t: t for t in TABLES})})" for n, v in VIEWS.items() if re.search(rf"\b{n}\b", sql)]
    if not used:
        return sql
    recursive = "RECURSIVE " if sql.strip().upper().startswith("WITH RECURSIVE ") else ""
    head = f"WITH {recursive}" + ", ".join(used)
    return head + (", " + sql.strip()[5 + len(recursive) :] if sql.strip().upper().startswith("WITH ") else " " + sql)
