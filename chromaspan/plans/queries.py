"""The engine's queries over the test tables, each beside the SQL of the same result."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import alleles, coords, predicates
from ..operators import cbs, genes, intervals, merge, segmentation, stats
from ..sources import files
from ..streaming import segments
from .views import VIEWS, spark_view, with_views

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


class Views:
    """The views by attribute: V(spark, sf_dir).seg is v_seg."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        return spark_view(self.spark, self.sf_dir, f"v_{name}")

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    def folder(self, name: str) -> str:
        import tempfile
        import uuid

        base = self.spark.conf.get("spark.checkpoint.dir", None) or tempfile.mkdtemp(prefix="chromaspan-")
        return f"{base}/{uuid.uuid4().hex}/{name}"


def query(name: str, sql: str | None = None):
    def add(f: Callable[[Views], DataFrame]):
        QUERIES[name] = lambda spark, sf_dir: f(Views(spark, sf_dir))
        if sql:
            ORACLE_SQL[name] = with_views(sql)
        return f

    return add


I = "greatest(least(q.seg_end, r.seg_end) - greatest(q.seg_start, r.seg_start) + 1, 0)"  # noqa: E741
Q, R = "(q.seg_end - q.seg_start + 1)", "(r.seg_end - r.seg_start + 1)"
SCORE_SQL = {
    "dice": f"2 * {I} / CAST({Q} + {R} AS DOUBLE)", "reference": f"{I} / CAST({R} AS DOUBLE)", "query": f"{I} / CAST({Q} AS DOUBLE)",
    "union": f"{I} / CAST({Q} + {R} - {I} AS DOUBLE)", "min": f"{I} / CAST(greatest({Q}, {R}) AS DOUBLE)", "max": f"{I} / CAST(least({Q}, {R}) AS DOUBLE)",
}
COLS = "sample, chrom, seg_start, seg_end, n_markers, state"


def _exists(kind: str, t: float, inverse: bool, aberrant: bool = False) -> str:
    ab = "(q.state <= 0 - CAST(0.4 AS DOUBLE) OR q.state >= 0 + CAST(0.4 AS DOUBLE))"
    e = f"EXISTS (SELECT 1 FROM v_ref r WHERE q.chrom = r.chrom AND q.seg_start <= r.seg_end AND r.seg_start <= q.seg_end AND {SCORE_SQL[kind]} >= {t})"
    flag = f"({ab} AND {e})" if aberrant else e
    return f"SELECT {COLS} FROM v_seg q WHERE {'' if inverse else 'NOT '}{flag}"


def _existence(kind: str, t: float, inverse: bool, aberrant: bool = False, optimize: bool = True, name: str | None = None) -> None:
    ids = {"reference": "j6", "query": "j7", "union": "j8", "min": "j9", "max": "j10", "dice": "j4" if inverse else "j3"}
    name = name or f"{'j5' if aberrant else ids[kind]}_{kind}_{'semi' if inverse else 'anti'}"

    @query(name, _exists(kind, t, inverse, aberrant))
    def _(v: Views) -> DataFrame:
        return intervals.exists_filter(v.seg, v.ref, kind, t, inverse, (0.0, 0.4) if aberrant else None, optimize).select(*COLS.split(", "))


for _k, _t in (("dice", 0.5), ("reference", 0.5), ("query", 0.5), ("union", 0.34), ("min", 0.5), ("max", 0.5)):
    _existence(_k, _t, False)
    _existence(_k, _t, True)
_existence("dice", 0.2, False, aberrant=True)
_existence("dice", 0.2, True, aberrant=True)
_existence("dice", 0.5, False, optimize=False, name="o16_dice_anti_unpruned")

# Predicates and filters


@query("p1_spurious", f"SELECT {COLS} FROM v_seg WHERE NOT n_markers < 25")
def _(v):
    return v.seg.filter(~predicates.spurious(F.col("n_markers"), 25)).select(*COLS.split(", "))


@query("p2_small", f"SELECT {COLS} FROM v_seg WHERE NOT seg_end - seg_start + 1 < 700")
def _(v):
    return v.seg.filter(~predicates.small(F.col("seg_start"), F.col("seg_end"), 700)).select(*COLS.split(", "))


@query("p3_aberrant", f"SELECT {COLS} FROM v_seg WHERE state <= 0.1 - CAST(0.5 AS DOUBLE) OR state >= 0.1 + CAST(0.5 AS DOUBLE)")
def _(v):
    return v.seg.filter(predicates.is_aberrant(F.col("state"), 0.1, 0.5)).select(*COLS.split(", "))


@query("p4_aberrant_alleles", "SELECT sample, chrom, seg_start, n_markers % 4 AS a, n_markers % 3 AS b FROM v_seg WHERE n_markers % 4 + n_markers % 3 <= 1 OR n_markers % 4 + n_markers % 3 >= 3")
def _(v):
    s = v.seg.withColumn("state", F.struct((F.col("n_markers") % 4).alias("a"), (F.col("n_markers") % 3).alias("b")))
    return s.filter(predicates.is_aberrant(predicates.total(F.col("state")), 2, 1)).select("sample", "chrom", "seg_start", "state.a", "state.b")


@query("p5_filter", f"SELECT {COLS} FROM v_seg WHERE NOT n_markers < 25")
def _(v):
    return merge.remove_flagged(v.seg, predicates.spurious(F.col("n_markers"), 25))


@query("p6_filter_chain_inverse", f"SELECT {COLS} FROM v_seg WHERE n_markers < 50 AND seg_end - seg_start + 1 < 2000")
def _(v):
    flags = [predicates.spurious(F.col("n_markers"), 50), predicates.small(F.col("seg_start"), F.col("seg_end"), 2000)]
    return merge.remove_flagged(v.seg, predicates.chain(flags, inverse=True))


@query("p8_known_chromosomes", "SELECT n_nationkey, CAST(CASE WHEN n_nationkey BETWEEN 1 AND 24 THEN n_nationkey END AS INT) AS chrom FROM nation WHERE n_nationkey BETWEEN 1 AND 24")
def _(v):
    return v.table("nation").select("n_nationkey", coords.chrom_id(F.concat(F.lit("chr"), F.col("n_nationkey").cast("string"))).alias("chrom")).filter("chrom is not null")


@query("p9_log_scale", "SELECT count(*) AS n FROM v_raw WHERE value < 0")
def _(v):
    return predicates.ensure_log_scale(v.raw).filter("value < 0").agg(F.count("*").alias("n"))


SCORED = predicates.StateThresholds(gain_high=0.6, loss_high=-0.6, gain_size=3000, loss_size=2000)
SCORE_CASE = """CASE WHEN state > 0 THEN CASE WHEN state > CAST(0.2 AS DOUBLE) THEN CASE WHEN seg_end - seg_start + 1 < 3000 THEN CASE WHEN state > CAST(0.6 AS DOUBLE) THEN 3 ELSE 2 END ELSE 1 END ELSE 0 END
    ELSE -(CASE WHEN state < CAST(-0.2 AS DOUBLE) THEN CASE WHEN seg_end - seg_start + 1 < 2000 THEN CASE WHEN state < CAST(-0.6 AS DOUBLE) THEN 3 ELSE 2 END ELSE 1 END ELSE 0 END) END"""
SCORED_SQL = f"WITH scored AS (SELECT *, CAST({SCORE_CASE} AS INT) AS score FROM v_seg) "


def scored(v: Views) -> DataFrame:
    return v.seg.withColumn("score", predicates.state_score(F.col("state"), F.col("seg_start"), F.col("seg_end"), SCORED))


@query("p10_state_score", SCORED_SQL + "SELECT sample, chrom, seg_start, seg_end, score FROM scored")
def _(v):
    return scored(v).select("sample", "chrom", "seg_start", "seg_end", "score")


@query("p12_window", f"SELECT {COLS} FROM v_seg WHERE chrom = 3 AND seg_start BETWEEN 200000 AND 400000")
def _(v):
    return v.seg.filter((F.col("chrom") == 3) & F.col("seg_start").between(200_000, 400_000)).select(*COLS.split(", "))


@query("p13_log_ratio", "SELECT sample, chrom, seg_start, round(log2(n_markers / CAST(2 AS DOUBLE)), 9) AS ratio FROM v_seg")
def _(v):
    return v.seg.select("sample", "chrom", "seg_start", F.round(predicates.log_ratio(F.col("n_markers").cast("double")), 9).alias("ratio"))


@query("p14_stride", "SELECT sample, chrom, pos, value FROM (SELECT *, row_number() OVER (PARTITION BY sample, chrom ORDER BY pos) - 1 AS i FROM v_raw) WHERE i % 5 = 0")
def _(v):
    return stats.every_nth(v.raw, ["sample", "chrom"], ["pos"], 5).select("sample", "chrom", "pos", "value")


@query("p15_colour", "SELECT CASE WHEN state > CAST(0.2 AS DOUBLE) THEN 'red' WHEN state < CAST(-0.2 AS DOUBLE) THEN 'blue' ELSE 'grey' END AS colour, count(*) AS n FROM v_seg GROUP BY 1")
def _(v):
    return v.seg.groupBy(predicates.colour(F.col("state")).alias("colour")).agg(F.count("*").alias("n"))


@query("p16_label_state", "SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN 1 WHEN p_partkey % 3 = 1 THEN -1 ELSE 0 END AS state FROM part")
def _(v):
    label = F.when(F.col("p_partkey") % 3 == 0, "Amplification Peak 1").when(F.col("p_partkey") % 3 == 1, "Deletion Peak 2").otherwise("other")
    return v.table("part").select("p_partkey", predicates.label_state(label).alias("state"))


# Joins


@query("j1_marker_anti", "SELECT sample, marker, chrom, pos, value FROM v_raw r WHERE NOT EXISTS (SELECT 1 FROM v_raw x WHERE x.marker = r.marker AND x.cn = 0)")
def _(v):
    return intervals.marker_filter(v.raw, v.raw.filter("cn = 0")).select("sample", "marker", "chrom", "pos", "value")


@query("j2_marker_list", "SELECT sample, marker, value FROM v_raw WHERE marker NOT IN ('3:3', '11:5', '8:1', '4:2', '15:3', '4:4')")
def _(v):
    return v.raw.filter(~F.col("marker").isin("3:3", "11:5", "8:1", "4:2", "15:3", "4:4")).select("sample", "marker", "value")


OVER = "q.chrom = g.g_chrom AND q.seg_start <= g.tx_end AND g.tx_start <= q.seg_end"


@query("j12_overlap_pairs", f"SELECT sample, seg_start, gene FROM v_seg q JOIN v_gene g ON {OVER}")
def _(v):
    return intervals.overlap_join(v.seg, v.gene, genes.SEG, genes.GENE).select("sample", "seg_start", "gene")


@query("j13_overlaps_any", f"SELECT {COLS} FROM v_seg q WHERE EXISTS (SELECT 1 FROM v_gene g WHERE {OVER})")
def _(v):
    g = v.gene.select(F.col("g_chrom").alias("chrom"), F.col("tx_start").alias("seg_start"), F.col("tx_end").alias("seg_end"))
    return intervals.exists_filter(v.seg, g, "max", 0.0, inverse=True).select(*COLS.split(", "))


@query("j15_containment", """SELECT gene AS child, parent FROM (SELECT a.gene, b.gene AS parent, row_number() OVER (PARTITION BY a.gene ORDER BY b.tx_end - b.tx_start, b.gene) AS rn FROM v_gene a JOIN v_gene b
    ON a.g_chrom = b.g_chrom AND b.tx_start <= a.tx_start AND a.tx_end <= b.tx_end AND (b.tx_start < a.tx_start OR a.tx_end < b.tx_end OR b.gene < a.gene)) WHERE rn = 1""")
def _(v):
    return intervals.self_containment(v.gene, "gene", genes.GENE)


@query("j16_valid_intervals", "SELECT sample, chrom, seg_start, seg_end - 1500 AS seg_end, seg_start <= seg_end - 1500 AS valid FROM v_seg")
def _(v):
    """Intervals of which some end before they start; those that don't also pass the check that raises."""
    rows = v.seg.select("sample", "chrom", "seg_start", (F.col("seg_end") - 1500).alias("seg_end")).withColumn("valid", intervals.is_valid())
    return intervals.validated(rows.filter("valid")).unionByName(rows.filter("not valid"))


@query("j17_predecessor", """SELECT p_chrom AS chrom, pos, CAST(greatest((SELECT count(DISTINCT seg_start) FROM v_seg s WHERE s.chrom = p.p_chrom AND s.seg_start <= p.pos) - 1, 0) AS BIGINT) AS ordinal FROM v_point p""")
def _(v):
    return intervals.predecessor(v.point.withColumnRenamed("p_chrom", "chrom"), v.seg.select("chrom", F.col("seg_start").alias("start")), ["chrom"]).select("chrom", "pos", "ordinal")


@query("j18_stab", "SELECT p_chrom, pos, sample, seg_start FROM v_point JOIN v_seg ON p_chrom = chrom AND seg_start <= pos AND pos <= seg_end")
def _(v):
    return intervals.stab(v.point, v.seg).select("p_chrom", "pos", "sample", "seg_start")


@query("j19_segments_in_regions", "SELECT region_id, sample, seg_start, seg_end FROM v_region JOIN v_seg ON r_chrom = chrom AND region_start <= seg_end AND seg_start <= region_end")
def _(v):
    return intervals.overlap_join(v.region, v.seg, ("r_chrom", "region_start", "region_end"), genes.SEG).select("region_id", "sample", "seg_start", "seg_end")


@query("j20_genes_in_regions", "SELECT DISTINCT region_id, gene FROM v_region JOIN v_gene ON r_chrom = g_chrom AND region_start <= tx_end AND tx_start <= region_end")
def _(v):
    return genes.inside(v.region, v.gene, ["region_id"])


@query("j21_named_genes", "SELECT gene FROM v_gene WHERE p_brand IN (SELECT p_brand FROM part WHERE p_size > 49)")
def _(v):
    return v.gene.join(v.table("part").filter("p_size > 49").select("p_brand"), "p_brand", "left_semi").select("gene")


@query("j22_first_transcript", "SELECT gene, tx_start, tx_end FROM (SELECT p_brand AS gene, tx_start, tx_end, row_number() OVER (PARTITION BY p_brand ORDER BY tx_start, tx_end) AS rn FROM v_gene) WHERE rn = 1")
def _(v):
    return genes.first_transcripts(v.gene.select(F.col("p_brand").alias("gene"), "tx_start", "tx_end"))


@query("j23_genes_on_chromosome", "SELECT gene FROM v_gene WHERE g_chrom = 7")
def _(v):
    return v.gene.filter("g_chrom = 7").select("gene")


@query("j24_genome", "SELECT DISTINCT p_brand AS gene FROM v_gene")
def _(v):
    return v.gene.select(F.col("p_brand").alias("gene")).distinct()


@query("j25_region_algebra", """SELECT region_id, gene, least(region_start, tx_start) AS union_start, greatest(region_end, tx_end) AS union_end, greatest(region_start, tx_start) AS both_start, least(region_end, tx_end) AS both_end
    FROM v_region JOIN v_gene ON r_chrom = g_chrom AND region_start <= tx_end AND tx_start <= region_end""")
def _(v):
    p = intervals.overlap_join(v.region, v.gene, ("r_chrom", "region_start", "region_end"), genes.GENE)
    c = [F.col(x) for x in ("region_start", "region_end", "tx_start", "tx_end")]
    p = p.select("region_id", "gene", genes.region_union(*c).alias("u"), genes.region_intersection(*c).alias("b"))
    return p.select("region_id", "gene", F.col("u.region_start").alias("union_start"), F.col("u.region_end").alias("union_end"), F.col("b.region_start").alias("both_start"), F.col("b.region_end").alias("both_end"))


EXONS = """exon AS (SELECT gene, g_chrom, k, tx_start + k * p_size * 60 AS e_start, tx_start + k * p_size * 60 + p_size * 30 AS e_end FROM v_gene CROSS JOIN (SELECT unnest([0, 1, 2]) AS k))"""


def with_exons(g: DataFrame) -> DataFrame:
    """Three exons of a gene: each 30 sizes long, every 60 sizes."""
    one = lambda k: F.struct((F.col("tx_start") + k * F.col("p_size") * 60).alias("start"), (F.col("tx_start") + k * F.col("p_size") * 60 + F.col("p_size") * 30).alias("end"))
    return g.withColumn("exons", F.array(*map(one, range(3))))


COVER = "sum(greatest(least(seg_end, e_end) - greatest(seg_start, e_start) + 1, 0)) / CAST(sum(e_end - e_start + 1) AS DOUBLE)"


@query("j26_exon_coverage", f"WITH {EXONS} SELECT sample, seg_start, gene, round({COVER}, 9) AS coverage FROM v_seg q JOIN v_gene g USING (gene) JOIN exon USING (gene) GROUP BY ALL".replace("v_seg q JOIN v_gene g USING (gene)", f"(SELECT * FROM v_seg q JOIN v_gene g ON {OVER}) x"))
def _(v):
    return genes.coverage(v.seg, with_exons(v.gene), ["sample", "seg_start"])


@query("j28_coding_exons", f"""WITH {EXONS} SELECT e.gene, k, greatest(e_start, tx_start + p_size * 10) AS c_start, least(e_end, tx_end - p_size * 70) AS c_end FROM exon e JOIN v_gene USING (gene)
    WHERE e_end >= tx_start + p_size * 10 AND e_start <= tx_end - p_size * 70""")
def _(v):
    cds = (F.col("tx_start") + F.col("p_size") * 10, F.col("tx_end") - F.col("p_size") * 70)
    g = with_exons(v.gene).select("gene", F.posexplode(genes.coding_exons(F.col("exons"), *cds)).alias("k", "x"))
    return g.select("gene", "k", F.col("x.start").alias("c_start"), F.col("x.end").alias("c_end"))


@query("j27_coding_coverage", f"""WITH {EXONS}, cds AS (SELECT e.gene, greatest(e_start, tx_start + p_size * 10) AS e_start, least(e_end, tx_end - p_size * 70) AS e_end FROM exon e JOIN v_gene USING (gene)
    WHERE e_end >= tx_start + p_size * 10 AND e_start <= tx_end - p_size * 70)
    SELECT sample, seg_start, gene, round({COVER}, 9) AS coverage FROM (SELECT * FROM v_seg q JOIN v_gene g ON {OVER}) x JOIN cds USING (gene) GROUP BY ALL""")
def _(v):
    cds = (F.col("tx_start") + F.col("p_size") * 10, F.col("tx_end") - F.col("p_size") * 70)
    g = genes.of_name(with_exons(v.gene), "exons").withColumn("coding", genes.coding_exons(F.col("exons"), *cds))
    return genes.coverage(v.seg, g, ["sample", "seg_start"], "coding")


for _name, _src, _key, _c in (("j29_annotate_segments", "v_seg", ["sample", "chrom", "seg_start", "seg_end"], genes.SEG), ("j30_annotate_regions", "v_region", ["region_id"], ("r_chrom", "region_start", "region_end"))):
    _k = ", ".join(_key)

    @query(_name, f"""SELECT {_k}, count(DISTINCT gene) AS n_genes, coalesce(string_agg(DISTINCT gene, ',' ORDER BY gene), '') AS genes
        FROM {_src} q LEFT JOIN v_gene g ON q.{_c[0]} = g.g_chrom AND q.{_c[1]} <= g.tx_end AND g.tx_start <= q.{_c[2]} GROUP BY {_k}""")
    def _(v, src=_src, key=_key, c=_c):
        return genes.genes_of(getattr(v, src[2:]), v.gene, key, c)


@query("j31_gene_coordinates", "SELECT p_partkey, gene, g_chrom, tx_start, tx_end FROM part JOIN v_gene ON gene = concat('G', CAST(p_partkey AS varchar(10)))")
def _(v):
    return v.table("part").select("p_partkey", F.concat(F.lit("G"), F.col("p_partkey").cast("string")).alias("gene")).join(v.gene.select("gene", "g_chrom", "tx_start", "tx_end"), "gene")


# Merging


RUNS = """WITH a AS (SELECT *, CASE WHEN lag(cn) OVER w IS NULL OR lag(cn) OVER w <> cn THEN 1 ELSE 0 END AS n FROM v_raw WINDOW w AS (PARTITION BY sample, chrom ORDER BY pos)),
    b AS (SELECT *, sum(n) OVER (PARTITION BY sample, chrom ORDER BY pos) AS run FROM a) SELECT sample, chrom, min(pos) AS seg_start, max(pos) AS seg_end, count(*) AS n_markers, min(cn) AS state FROM b GROUP BY sample, chrom, run"""


@query("m3_runs", RUNS)
def _(v):
    return merge.runs(v.raw.drop("value").withColumnRenamed("cn", "value"))


@query("m4_allele_runs", """WITH a AS (SELECT *, cn % 2 AS a, cn AS b FROM v_raw), c AS (SELECT *, CASE WHEN lag(cn) OVER w IS NULL OR lag(a) OVER w <> a OR lag(b) OVER w <> b THEN 1 ELSE 0 END AS n FROM a WINDOW w AS (PARTITION BY sample, chrom ORDER BY pos)),
    d AS (SELECT *, sum(n) OVER (PARTITION BY sample, chrom ORDER BY pos) AS run FROM c) SELECT sample, chrom, min(pos) AS seg_start, count(*) AS n_markers, min(a) AS a, min(b) AS b FROM d GROUP BY sample, chrom, run""")
def _(v):
    raw = v.raw.withColumn("value", F.struct((F.col("cn") % 2).alias("a"), F.col("cn").alias("b")))
    return merge.runs(raw).select("sample", "chrom", "seg_start", "n_markers", "state.a", "state.b")


@query("m5_segments_to_raw", """WITH p AS (SELECT p_chrom AS chrom, pos, s.sample FROM v_point CROSS JOIN (SELECT DISTINCT sample FROM v_seg) s),
    c AS (SELECT p.*, state, row_number() OVER (PARTITION BY p.sample, p.chrom, p.pos ORDER BY seg_start, seg_end, state) AS rn FROM p LEFT JOIN v_seg g ON p.sample = g.sample AND p.chrom = g.chrom AND seg_start <= pos AND pos <= seg_end)
    SELECT sample, chrom, pos, state AS value FROM c WHERE rn = 1""")
def _(v):
    markers = v.point.select(F.col("p_chrom").alias("chrom"), "pos", F.concat_ws(":", "p_chrom", "pos").alias("marker"))
    return merge.to_raw(v.seg, markers).select("sample", "chrom", "pos", "value")


@query("m6_pooled", "SELECT 'ALL' AS sample, chrom, seg_start, seg_end, CAST(0 AS BIGINT) AS n_markers, CAST(0 AS DOUBLE) AS state FROM v_seg")
def _(v):
    return merge.pooled(v.seg)


#: One row of each (sample, chromosome) at a time: c.. is the last kept segment, w whether it is single, r.. the first of an open run of flagged ones, and o.. what this row sets free.
MERGED = """WITH RECURSIVE g AS (SELECT sample, chrom, n_markers < 25 AS flag, seg_start AS s, seg_end AS e, n_markers AS n, state AS x,
        row_number() OVER (PARTITION BY sample, chrom ORDER BY seg_start, seg_end, n_markers, state) AS k, count(*) OVER (PARTITION BY sample, chrom) AS final FROM v_seg),
    f AS (SELECT DISTINCT sample, chrom, final, CAST(0 AS BIGINT) AS k, CAST(NULL AS BIGINT) AS cs, CAST(NULL AS BIGINT) AS ce, CAST(NULL AS BIGINT) AS cn, CAST(NULL AS DOUBLE) AS cx, false AS w, CAST(NULL AS BIGINT) AS rs, CAST(NULL AS BIGINT) AS re,
            CAST(NULL AS BIGINT) AS os, CAST(NULL AS BIGINT) AS oe, CAST(NULL AS BIGINT) AS o_n, CAST(NULL AS DOUBLE) AS ox FROM g
        UNION ALL
        SELECT sample, chrom, final, k, CASE WHEN flag OR joins THEN cs WHEN later THEN rs ELSE s END, CASE WHEN flag THEN ce ELSE e END, CASE WHEN flag THEN cn WHEN joins THEN cn + n ELSE n END,
            CASE WHEN flag THEN cx WHEN NOT joins THEN x WHEN cx = x THEN x ELSE (cx * (cn + n) + x * n) / (cn + n + n) END, CASE WHEN flag THEN w ELSE NOT joins END,
            CASE WHEN flag THEN coalesce(rs, s) END, CASE WHEN flag THEN coalesce(re, e) END,
            CASE WHEN frees THEN cs END, CASE WHEN frees THEN CASE WHEN sooner THEN re ELSE ce END END, CASE WHEN frees THEN cn END, CASE WHEN frees THEN cx END
        FROM (SELECT *, NOT flag AND NOT joins AND cs IS NOT NULL AS frees, NOT flag AND NOT joins AND NOT sooner AND rs IS NOT NULL AND s > rs AS later
            FROM (SELECT g.*, cs, ce, cn, cx, w, rs, re, NOT flag AND coalesce(abs(cx - x) <= CAST(0.1 AS DOUBLE), false) AND (rs IS NOT NULL OR w) AS joins, coalesce(rs IS NOT NULL AND ce - cs >= e - s, false) AS sooner
                FROM f JOIN g ON f.sample = g.sample AND f.chrom = g.chrom AND f.k + 1 = g.k) q1) q2)
    SELECT sample, chrom, os AS seg_start, oe AS seg_end, o_n AS n_markers, round(ox, 9) AS state FROM f WHERE os IS NOT NULL
    UNION ALL SELECT sample, chrom, cs, coalesce(re, ce), cn, round(cx, 9) FROM f WHERE k = final AND cs IS NOT NULL"""


@query("m1_merge_flagged", MERGED)
def _(v):
    return merge.remove_flagged(v.seg, predicates.spurious(F.col("n_markers"), 25), 0.1, merge=True).withColumn("state", F.round("state", 9))


@query("m2_merge_pairs", MERGED.replace("n_markers < 25 AS flag", "false AS flag").replace("0.1", "0.3"))
def _(v):
    return merge.remove_flagged(v.seg, F.lit(False), 0.3, merge=True).withColumn("state", F.round("state", 9))


@query("clean", f"SELECT {COLS} FROM v_seg WHERE n_markers >= 20 AND seg_end - seg_start + 1 >= 500 AND state > 0 - CAST(0.4 AS DOUBLE) AND state < CAST(0.4 AS DOUBLE)")
def _(v):
    return merge.clean(v.seg, 20, 500, True, 0.0, 0.4)


# Aggregates and windows

for _n, _f, _s in (("a1_mean", F.avg, "avg(value)"), ("a2_variance", stats.variance, "coalesce(var_samp(value), 0)"), ("a3_pvariance", lambda c: stats.variance(c, False), "coalesce(var_pop(value), 0)")):

    @query(_n, f"SELECT sample, chrom, round({_s}, 9) AS stat FROM v_raw GROUP BY sample, chrom")
    def _(v, f=_f):
        return v.raw.groupBy("sample", "chrom").agg(F.round(f("value"), 9).alias("stat"))


@query("a5_running", """SELECT sample, chrom, pos, round(avg(value) OVER w, 7) AS run_mean, round(coalesce(stddev_samp(value) OVER w, 0), 7) AS run_sd, round(stddev_pop(value) OVER w, 7) AS run_psd, round(coalesce(var_samp(value) OVER w, 0), 7) AS run_var
    FROM v_raw WINDOW w AS (PARTITION BY sample, chrom ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)""")
def _(v):
    r = stats.running(v.raw, ["sample", "chrom"], ["pos"], "value")
    return r.select("sample", "chrom", "pos", *(F.round(c, 7).alias(c) for c in ("run_mean", "run_sd", "run_psd", "run_var")))


DIFF = "WITH d AS (SELECT sample, chrom, pos, value - lag(value) OVER (PARTITION BY sample, chrom ORDER BY pos) AS diff FROM v_raw) "


@query("a6_datum_variance", DIFF + "SELECT sample, chrom, round(coalesce(var_samp(diff), 0) / 2, 9) AS datum_var FROM d GROUP BY sample, chrom")
def _(v):
    return stats.datum_variance(v.raw, ["sample", "chrom"], ["pos"], "value").withColumn("datum_var", F.round("datum_var", 9))


@query("a7_trimmed_variance", DIFF + f""", e AS (SELECT sample, chrom, abs(diff) AS a, row_number() OVER (PARTITION BY sample, chrom ORDER BY abs(diff)) AS rn, floor((1 - 2 * CAST(0.025 AS DOUBLE)) * count(*) OVER (PARTITION BY sample, chrom) + 0.5) AS keep FROM d WHERE diff IS NOT NULL)
    SELECT sample, chrom, round({stats.inflation(0.025)!r} * sum(a * a) / (2 * max(keep)), 9) AS trimmed_var FROM e WHERE rn <= keep GROUP BY sample, chrom""")
def _(v):
    return stats.trimmed_variance(v.raw, ["sample", "chrom"], ["pos"], "value").withColumn("trimmed_var", F.round("trimmed_var", 9))


#: Quantiles of the normal distribution at 1 - trim. The integral of x^2 between them is known in closed form.
QUANTILES = {0.025: 1.959963984540054, 0.05: 1.6448536269514722, 0.1: 1.2815515655446004}


@query("a8_inflation", DIFF + f""", t AS (SELECT CAST(trim AS DOUBLE) AS trim, CAST(a AS DOUBLE) AS a FROM (VALUES {', '.join(map(str, QUANTILES.items()))}) v(trim, a)),
    e AS (SELECT sample, abs(diff) AS d, row_number() OVER (PARTITION BY sample ORDER BY abs(diff)) AS rn, count(*) OVER (PARTITION BY sample) AS n FROM d WHERE diff IS NOT NULL)
    SELECT sample, trim, round((1 - 2 * trim) / (1 - 2 * trim - 2 * a * exp(-a * a / 2) / sqrt(2 * pi())) * sum(d * d) / (2 * count(*)), 8) AS inflated FROM e CROSS JOIN t WHERE rn <= floor((1 - 2 * trim) * n + 0.5) GROUP BY sample, trim, a""")
def _(v):
    """Each sample's trimmed variance at several trims, inflated for each."""
    d = stats.differences(v.raw, ["sample", "chrom"], ["pos"], "value").filter("diff is not null").select("sample", F.abs("diff").alias("a"))
    parts = [stats.trimmed_squares(d, ["sample"], t).select("sample", F.lit(t).alias("trim"), F.round("_variance", 8).alias("inflated")) for t in QUANTILES]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


SUMMARY = """SELECT chrom, pos, round(CASE WHEN sum(CASE WHEN {d} * state > CAST(0.3 AS DOUBLE) THEN exp({d} * state) ELSE 0 END) IS NULL THEN 0 ELSE sum(CASE WHEN {d} * state > CAST(0.3 AS DOUBLE) THEN exp({d} * state) ELSE 0 END) / count(seg_start) END, 8) AS value
    FROM {p} p LEFT JOIN (SELECT chrom AS c, seg_start, seg_end, state FROM v_seg) s ON s.c = p.chrom AND seg_start <= pos AND pos <= seg_end GROUP BY chrom, pos"""


@query("a9_summary_at_positions", SUMMARY.format(d=1, p="(SELECT p_chrom AS chrom, pos FROM v_point)").replace("/ count(seg_start)", "/ greatest(count(seg_start), 1)"))
def _(v):
    return stats.summarize(v.seg, 1, 0.3, v.point.withColumnRenamed("p_chrom", "chrom")).withColumn("value", F.round("value", 8))


@query("a10_summary_at_breakpoints", SUMMARY.format(d=-1, p="(SELECT chrom, seg_start AS pos FROM v_seg UNION SELECT chrom, seg_end FROM v_seg)"))
def _(v):
    return stats.summarize(v.seg, -1, 0.3).withColumn("value", F.round("value", 8))


EXTREME = "CAST(coalesce(arg_max(score, abs(score) * 10 + CASE WHEN score < 0 THEN 1 ELSE 0 END), 0) AS INT)"
REGION_ON = "r_chrom = chrom AND region_start <= seg_end AND seg_start <= region_end"


@query("a11_region_scores", SCORED_SQL + f"SELECT region_id, s.sample, {EXTREME} AS score FROM v_region CROSS JOIN (SELECT DISTINCT sample FROM v_seg) s LEFT JOIN scored q ON q.sample = s.sample AND {REGION_ON} GROUP BY region_id, s.sample")
def _(v):
    return genes.region_scores(v.region, scored(v), ["region_id"])


@query("a17_region_vectors", SCORED_SQL + f"""SELECT region_id, s.sample, {EXTREME} AS score FROM v_region CROSS JOIN (SELECT DISTINCT sample FROM v_seg) s
    LEFT JOIN scored q ON q.sample = s.sample AND {REGION_ON} AND greatest(least(region_end, seg_end) - greatest(region_start, seg_start) + 1, 0) / CAST(region_end - region_start + 1 AS DOUBLE) > 0.1 GROUP BY region_id, s.sample""")
def _(v):
    return genes.region_scores(v.region, scored(v), ["region_id"], least=0.1)


PAIR = "pair AS (SELECT sample, gene, seg_start, seg_end, score FROM scored q JOIN v_gene g ON q.chrom = g.g_chrom AND q.seg_start <= g.tx_end AND g.tx_start <= q.seg_end WHERE score <> 0)"
COVERED = f"cov AS (SELECT sample, gene, seg_start, seg_end, score, {COVER} AS c FROM pair JOIN exon USING (gene) GROUP BY ALL)"
GENE_SQL = SCORED_SQL.strip() + f", {EXONS}, {PAIR}, {COVERED} "


@query("a12_gene_scores", GENE_SQL + f"SELECT gene, sample, {EXTREME} AS score FROM cov WHERE score > 0 AND c > 0.3 OR score < 0 AND c > 0.2 GROUP BY gene, sample")
def _(v):
    return genes.gene_scores(with_exons(v.gene), scored(v), 0.3, 0.2)


@query("a13_gene_scores_relaxed", SCORED_SQL.strip() + f", {PAIR} SELECT gene, sample, {EXTREME} AS score FROM pair GROUP BY gene, sample")
def _(v):
    return genes.gene_scores(with_exons(v.gene), scored(v), relaxed=True)


@query("a14_gene_scores_greatest", GENE_SQL + "SELECT gene, sample, CAST(arg_max(score, c * 1000000000 + (3 - score) * 0.000001) AS INT) AS score FROM cov GROUP BY gene, sample")
def _(v):
    return genes.gene_scores(with_exons(v.gene), scored(v), relaxed=True, greatest=True)


@query("a15_gene_scores_in_regions", GENE_SQL + f""", s AS (SELECT gene, sample, {EXTREME} AS score FROM cov WHERE score > 0 AND c > 0.3 OR score < 0 AND c > 0.2 GROUP BY gene, sample)
    SELECT DISTINCT region_id, gene, sample, score FROM v_region JOIN v_gene ON r_chrom = g_chrom AND region_start <= tx_end AND tx_start <= region_end JOIN s USING (gene)""")
def _(v):
    return genes.scores_in_regions(v.region, with_exons(v.gene), scored(v), ["region_id"], gain=0.3, loss=0.2).select("region_id", "gene", "sample", "score")


@query("a16_relaxed_in_regions", SCORED_SQL + f"""SELECT region_id, gene, sample, {EXTREME} AS score FROM v_region JOIN scored ON {REGION_ON} AND score <> 0
    JOIN v_gene ON g_chrom = chrom AND greatest(region_start, seg_start) <= tx_end AND tx_start <= least(region_end, seg_end) GROUP BY region_id, gene, sample""")
def _(v):
    return genes.scores_in_regions(v.region, v.gene, scored(v), ["region_id"], relaxed=True)


#: SQL has to name the columns of a pivot; the queries find the samples themselves.
SAMPLES = [f"S{k}" for k in range(20)]
PIVOT = ", ".join(f"CAST(coalesce(max(score) FILTER (WHERE sample = '{s}'), 0) AS INT) AS {s}" for s in SAMPLES)


@query("a18_gene_matrix", SCORED_SQL.strip() + f", {PAIR}, s AS (SELECT gene, sample, {EXTREME} AS score FROM pair GROUP BY gene, sample) SELECT gene, {PIVOT} FROM s GROUP BY gene")
def _(v):
    return genes.matrix(genes.gene_scores(with_exons(v.gene), scored(v), relaxed=True), "gene", files.sample_names(v.seg))


@query("a19_region_matrix", SCORED_SQL.strip() + f", s AS (SELECT region_id, s.sample, {EXTREME} AS score FROM v_region CROSS JOIN (SELECT DISTINCT sample FROM v_seg) s LEFT JOIN scored q ON q.sample = s.sample AND {REGION_ON} GROUP BY region_id, s.sample) SELECT region_id, {PIVOT} FROM s GROUP BY region_id")
def _(v):
    got = genes.region_scores(v.region, scored(v), ["region_id"], dense=False)
    wide = genes.matrix(got, "region_id", files.sample_names(v.seg))
    return v.region.select("region_id").distinct().join(wide, "region_id", "left").na.fill(0)


@query("a20_lesion_matrix", SCORED_SQL.strip() + f""", s AS (SELECT gene, sample, {EXTREME} AS score FROM v_region JOIN scored ON {REGION_ON} AND score <> 0 JOIN v_gene ON g_chrom = chrom AND greatest(region_start, seg_start) <= tx_end AND tx_start <= least(region_end, seg_end) GROUP BY gene, sample)
    SELECT gene, {PIVOT} FROM s GROUP BY gene""")
def _(v):
    return genes.matrix(genes.scores_in_any_region(v.region, v.gene, scored(v)), "gene", files.sample_names(v.seg))


@query("a21_set_overlaps", "SELECT p_brand AS set_name, count(DISTINCT gene) FILTER (WHERE g_chrom <= 6) AS n FROM v_gene GROUP BY p_brand")
def _(v):
    sets = v.gene.groupBy(F.col("p_brand").alias("set_name")).agg(F.collect_set("gene").alias("genes"))
    return genes.set_overlaps(sets, v.gene.filter("g_chrom <= 6"))


@query("w1_differences", DIFF + "SELECT sample, chrom, pos, round(diff, 9) AS diff FROM d WHERE diff IS NOT NULL")
def _(v):
    return stats.differences(v.raw, ["sample", "chrom"], ["pos"], "value").filter("diff is not null").select("sample", "chrom", "pos", F.round("diff", 9).alias("diff"))


@query("w2_runs", """WITH a AS (SELECT *, CASE WHEN lag(cn) OVER w IS NULL OR lag(cn) OVER w <> cn THEN 1 ELSE 0 END AS n FROM v_raw WINDOW w AS (PARTITION BY sample, chrom ORDER BY pos)),
    b AS (SELECT *, CAST(sum(n) OVER (PARTITION BY sample, chrom ORDER BY pos) AS BIGINT) AS run_id FROM a) SELECT sample, chrom, pos, run_id, count(*) OVER (PARTITION BY sample, chrom, run_id) AS run_length FROM b""")
def _(v):
    return stats.run_ids(v.raw, ["sample", "chrom"], ["pos"], "cn").select("sample", "chrom", "pos", "run_id", "run_length")


@query("w3_median", "SELECT sample, chrom, pos, round(median(value) OVER (PARTITION BY sample, chrom ORDER BY pos ROWS BETWEEN 5 PRECEDING AND 5 FOLLOWING), 9) AS med FROM v_raw")
def _(v):
    return stats.neighbour_median(v.raw, ["sample", "chrom"], ["pos"], "value").select("sample", "chrom", "pos", F.round("med", 9).alias("med"))


@query("w5_smooth", f"""WITH d AS (SELECT sample, abs(value - lag(value) OVER (PARTITION BY sample ORDER BY chrom, pos, marker)) AS a FROM v_raw),
    r AS (SELECT sample, a, row_number() OVER (PARTITION BY sample ORDER BY a) AS i, count(*) OVER (PARTITION BY sample) AS n FROM d WHERE a IS NOT NULL),
    s AS (SELECT sample, sqrt({stats.inflation(0.025)!r} * sum(a * a) / (2 * count(*))) AS sd FROM r WHERE i <= floor(0.95 * n + 0.5) GROUP BY sample),
    w AS (SELECT v.*, s.sd, list(v.value) OVER (PARTITION BY v.sample, v.chrom ORDER BY v.pos, v.marker ROWS BETWEEN 10 PRECEDING AND 10 FOLLOWING EXCLUDE CURRENT ROW) AS near FROM v_raw v JOIN s ON v.sample = s.sample)
    SELECT sample, marker, chrom, pos, round(CASE WHEN near IS NULL OR len(near) = 0 THEN value - 2 * sd WHEN value - list_max(near) > 4 * sd THEN list_median(list_append(near, value)) + 2 * sd
    WHEN list_min(near) - value > 4 * sd THEN list_median(list_append(near, value)) - 2 * sd ELSE value END, 9) AS value FROM w""")
def _(v):
    return cbs.smooth_raw(v.raw).withColumn("value", F.round("value", 9))


@query("w6_smooth_chromosomes", f"""WITH d AS (SELECT sample, chrom, abs(value - lag(value) OVER (PARTITION BY sample, chrom ORDER BY pos, marker)) AS a FROM v_raw),
    r AS (SELECT sample, chrom, a, row_number() OVER (PARTITION BY sample, chrom ORDER BY a) AS i, count(*) OVER (PARTITION BY sample, chrom) AS n FROM d WHERE a IS NOT NULL),
    s AS (SELECT sample, chrom, sqrt({stats.inflation(0.025)!r} * sum(a * a) / (2 * count(*))) AS sd FROM r WHERE i <= floor(0.95 * n + 0.5) GROUP BY sample, chrom),
    w AS (SELECT v.*, s.sd, list(v.value) OVER (PARTITION BY v.sample, v.chrom ORDER BY v.pos, v.marker ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING EXCLUDE CURRENT ROW) AS near FROM v_raw v JOIN s ON v.sample = s.sample AND v.chrom = s.chrom)
    SELECT sample, marker, chrom, pos, round(CASE WHEN near IS NULL OR len(near) = 0 THEN value - 2 * sd WHEN value - list_max(near) > 0.5 * sd THEN list_median(list_append(near, value)) + 2 * sd
    WHEN list_min(near) - value > 0.5 * sd THEN list_median(list_append(near, value)) - 2 * sd ELSE value END, 9) AS value FROM w""")
def _(v):
    """Each chromosome by its own deviation, three neighbours on either side."""
    return cbs.smooth_raw(v.raw, "chromosome", region=3, outlier_sd=0.5).withColumn("value", F.round("value", 9))


@query("w7_peaks", """WITH a AS (SELECT sample, chrom, value > avg(value) OVER p + 1.6448536269514715 * sqrt(coalesce(var_samp(value) OVER p, 0) / count(value) OVER p) AS high, row_number() OVER (PARTITION BY sample, chrom ORDER BY pos) - 1 AS i FROM v_raw WINDOW p AS (PARTITION BY sample, chrom)),
    b AS (SELECT *, i - row_number() OVER (PARTITION BY sample, chrom ORDER BY i) AS run FROM a WHERE high) SELECT sample, chrom, min(i) AS peak_start, max(i) AS peak_end FROM b GROUP BY sample, chrom, run""")
def _(v):
    return stats.peaks(v.raw, ["sample", "chrom"], ["pos"], "value")


@query("w8_prefix_sums", "SELECT sample, chrom, pos, round(sum(value) OVER (PARTITION BY sample, chrom ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 7) AS prefix_sum FROM v_raw")
def _(v):
    return stats.prefix_sums(v.raw, ["sample", "chrom"], ["pos"], "value").select("sample", "chrom", "pos", F.round("prefix_sum", 7).alias("prefix_sum"))


@query("t1_sorted_markers", "SELECT chrom, pos, marker, row_number() OVER (PARTITION BY chrom ORDER BY pos, marker) - 1 AS ordinal FROM (SELECT DISTINCT chrom, pos, marker FROM v_raw)")
def _(v):
    return files.ordinal(v.raw.select("chrom", "pos", "marker").distinct())


@query("t3_sorted_segments", f"SELECT {COLS} FROM v_seg ORDER BY sample, chrom, seg_start, seg_end")
def _(v):
    return v.seg.orderBy("sample", "chrom", "seg_start", "seg_end").select(*COLS.split(", "))


@query("u1_breakpoints", "SELECT chrom, seg_start AS pos FROM v_seg UNION SELECT chrom, seg_end FROM v_seg")
def _(v):
    return stats.breakpoints(v.seg)


@query("u2_distinct_regions", "SELECT DISTINCT chrom, seg_start, seg_end FROM (SELECT * FROM v_seg UNION ALL SELECT * FROM v_seg WHERE n_markers > 50) q")
def _(v):
    return v.seg.unionByName(v.seg.filter("n_markers > 50")).select("chrom", "seg_start", "seg_end").dropDuplicates(["chrom", "seg_start", "seg_end"])


@query("u5_append", "SELECT sample, count(*) AS n FROM (SELECT sample FROM v_seg UNION ALL SELECT 'ALL' FROM v_seg) GROUP BY sample")
def _(v):
    return v.seg.select("sample").unionByName(merge.pooled(v.seg).select("sample")).groupBy("sample").agg(F.count("*").alias("n"))


@query("u6_gene_set_of_regions", "SELECT DISTINCT gene FROM v_region JOIN v_gene ON r_chrom = g_chrom AND region_start <= tx_end AND tx_start <= region_end")
def _(v):
    return intervals.overlap_join(v.region, v.gene, ("r_chrom", "region_start", "region_end"), genes.GENE).select("gene").distinct()


@query("x1_chromosomes", "SELECT n_nationkey, CAST(CASE WHEN n_nationkey BETWEEN 1 AND 24 THEN n_nationkey END AS INT) AS id, CASE n_nationkey WHEN 0 THEN NULL WHEN 23 THEN 'X' WHEN 24 THEN 'Y' ELSE CAST(n_nationkey AS VARCHAR) END AS name FROM nation")
def _(v):
    k = F.col("n_nationkey")
    return v.table("nation").select(k, coords.chrom_id(F.concat(F.lit("chr"), k.cast("string"))).alias("id"), coords.chrom_name(F.when(k > 0, k)).alias("name"))


@query("x2_common_prefix", "SELECT p_partkey, concat('s', CAST(p_partkey AS VARCHAR)) AS prefix FROM part")
def _(v):
    s = F.concat(F.lit("s"), F.col("p_partkey").cast("string"))
    return v.table("part").select("p_partkey", coords.common_prefix(F.concat(s, F.lit(".A")), F.concat(s, F.lit(".B"))).alias("prefix"))


@query("x3_file_names", "SELECT p_partkey, 'seg' AS ext, concat('f', CAST(p_partkey AS VARCHAR)) AS stem, '/a/b/' AS dir FROM part")
def _(v):
    f = F.concat(F.lit("/a/b/f"), F.col("p_partkey").cast("string"), F.lit(".seg"))
    return v.table("part").select("p_partkey", coords.file_extension(f).alias("ext"), coords.file_stem(f).alias("stem"), coords.file_path(f).alias("dir"))


@query("r1_region_strings", "SELECT region_id, CAST(r_chrom AS VARCHAR) AS chrom, region_start, region_end, CASE WHEN region_id % 3 = 0 THEN 0 WHEN region_id % 3 = 1 THEN 1 ELSE -1 END AS state FROM v_region")
def _(v):
    state = F.when(F.col("region_id") % 3 == 0, 0).when(F.col("region_id") % 3 == 1, 1).otherwise(-1)
    text = coords.region_string(F.col("r_chrom"), F.col("region_start"), F.col("region_end"), state)
    return v.region.select("region_id", coords.parse_region(text).alias("p")).select("region_id", "p.chrom", "p.region_start", "p.region_end", "p.state")


@query("r2_bands", """WITH band AS (SELECT CAST(g_chrom AS VARCHAR) AS chrom, concat(CASE WHEN p_size % 2 = 0 THEN 'p' ELSE 'q' END, CAST(p_size % 40 + 10 AS VARCHAR)) AS band, tx_start, tx_end FROM v_gene)
    SELECT k.chrom, k.arm, min(tx_start) AS band_start, max(tx_end) AS band_end FROM (SELECT DISTINCT chrom, left(band, 2) AS arm FROM band) k JOIN band b ON k.chrom = b.chrom AND starts_with(b.band, k.arm) GROUP BY k.chrom, k.arm""")
def _(v):
    b = v.gene.select(F.col("g_chrom").cast("string").alias("chrom"), F.concat(F.when(F.col("p_size") % 2 == 0, "p").otherwise("q"), (F.col("p_size") % 40 + 10).cast("string")).alias("band"), "tx_start", "tx_end")
    asked = b.select(coords.band_prefix(F.concat(F.lit("chr"), "chrom", F.left("band", F.lit(2)))).alias("k")).distinct().select("k.chrom", F.col("k.prefix").alias("arm"))
    return asked.join(b, "chrom").filter(F.startswith("band", "arm")).groupBy("chrom", "arm").agg(F.min("tx_start").alias("band_start"), F.max("tx_end").alias("band_end"))


# Files: written, then read again


@query("s1_raw_files", "SELECT sample, marker, chrom, pos, round(value, 4) AS value FROM v_raw")
def _(v):
    path = v.folder("raw.cn")
    files.write_raw(v.raw.withColumn("value", F.round("value", 4)), path)
    return files.read_raw(v.spark, path).filter("value is not null").select("sample", "marker", "chrom", "pos", F.round("value", 4).alias("value"))


@query("s2_allele_raw_files", "SELECT sample, marker, chrom, pos, CAST(cn % 2 AS DOUBLE) AS a, CAST(cn AS DOUBLE) AS b FROM v_raw")
def _(v):
    path = v.folder("raw.cnas")
    files.write_raw(v.raw.withColumn("value", F.struct((F.col("cn") % 2).alias("a"), F.col("cn").alias("b"))), path)
    return files.read_raw(v.spark, path, alleles=True).filter("value.a is not null").select("sample", "marker", "chrom", "pos", "value.a", "value.b")


@query("s3_segment_files", f"SELECT {COLS} FROM v_seg")
def _(v):
    path = v.folder("x.seg")
    files.write_segments(v.seg, path)
    return files.read_segments(v.spark, path)


@query("s4_allele_segment_files", "SELECT sample, chrom, seg_start, seg_end, CAST(n_markers % 4 AS DOUBLE) AS a, CAST(n_markers % 3 AS DOUBLE) AS b FROM v_seg")
def _(v):
    path = v.folder("x.segas")
    files.write_segments(v.seg.withColumn("state", F.struct((F.col("n_markers") % 4).alias("a"), (F.col("n_markers") % 3).alias("b"))), path)
    return files.read_allele_segments(v.spark, path).select("sample", "chrom", "seg_start", "seg_end", "state.a", "state.b")


@query("s5_reference_files", "SELECT 'ALL' AS sample, chrom, seg_start, seg_end, CAST(0 AS BIGINT) AS n_markers, CAST(0 AS DOUBLE) AS state FROM v_seg")
def _(v):
    path = v.folder("x.segref")
    files.write_segments(v.seg, path)
    return files.read_any(v.spark, path)[1]


@query("s7_marker_files", "SELECT DISTINCT marker, chrom, pos FROM v_raw")
def _(v):
    path = v.folder("markers")
    files.write_markers(v.raw.select("marker", "chrom", "pos").distinct(), path)
    return files.read_markers(v.spark, path, named=True).select("marker", "chrom", "pos")


@query("s9_several_files", "SELECT sample, count(*) AS n FROM v_seg GROUP BY sample")
def _(v):
    paths = [v.folder("a.seg"), v.folder("b.seg")]
    files.write_segments(v.seg.filter("chrom <= 12"), paths[0])
    files.write_segments(v.seg.filter("chrom > 12"), paths[1])
    return files.read_segments(v.spark, paths).groupBy("sample").agg(F.count("*").alias("n"))


@query("s14_gene_set_files", "SELECT p_brand AS set_name, count(*) AS n, string_agg(gene, ',' ORDER BY gene) AS genes FROM v_gene GROUP BY p_brand")
def _(v):
    path = v.folder("sets.gmt")
    files.write_gene_sets(v.gene.groupBy(F.col("p_brand").alias("set_name")).agg(F.first("p_brand").alias("description"), F.collect_set("gene").alias("genes")), path)
    return files.read_gene_sets(v.spark, path).select("set_name", F.size("genes").cast("long").alias("n"), F.array_join(F.array_sort("genes"), ",").alias("genes"))


@query("convert_raw_to_segments", RUNS.replace("min(cn) AS state", "CAST(min(cn) AS DOUBLE) AS state"))
def _(v):
    path = v.folder("raw.cn")
    files.write_raw(v.raw.withColumn("value", F.col("cn").cast("double")), path)
    kind, df = files.read_any(v.spark, path)
    return files.convert(kind, df.filter("value is not null"), "segmented")


@query("k1_raw_matrix", f"SELECT marker, chrom, pos, {', '.join(f'max(cn) FILTER (WHERE sample = {s!r}) AS {s}' for s in SAMPLES[:10])} FROM v_raw GROUP BY marker, chrom, pos")
def _(v):
    return files.raw_matrix(v.raw.drop("value").withColumnRenamed("cn", "value"))


@query("k2_allele_matrix", f"SELECT marker, chrom, pos, {', '.join(f'max(cn % 2) FILTER (WHERE sample = {s!r}) AS {s}_a, max(cn) FILTER (WHERE sample = {s!r}) AS {s}_b' for s in SAMPLES[:10])} FROM v_raw GROUP BY marker, chrom, pos")
def _(v):
    wide = files.raw_matrix(v.raw.withColumn("value", alleles.pair(F.col("cn") % 2, F.col("cn"))))
    return wide.select("marker", "chrom", "pos", *(F.col(f"`{c}`").alias(c.replace(".A", "_a").replace(".B", "_b")) for c in wide.columns[3:]))


@query("k5_unnamed_markers", "SELECT DISTINCT concat(CAST(chrom AS VARCHAR), ':', CAST(pos AS VARCHAR)) AS marker, chrom, pos FROM v_raw")
def _(v):
    path = v.folder("markers")
    files.write_markers(v.raw.select("marker", "chrom", "pos").distinct(), path, named=False)
    return files.read_markers(v.spark, path).select("marker", "chrom", "pos")


@query("k7_matrix_files", SCORED_SQL.strip() + f", {PAIR}, s AS (SELECT gene, sample, {EXTREME} AS score FROM pair GROUP BY gene, sample) SELECT gene, {PIVOT} FROM s GROUP BY gene")
def _(v):
    path = v.folder("genes.mat")
    files.write_matrix(genes.gene_scores(with_exons(v.gene), scored(v), relaxed=True), "gene", path, files.sample_names(v.seg))
    back = v.spark.read.options(sep="\t", header=True).csv(path)
    first, *samples = back.columns
    return back.select(F.col(f"`{first}`").alias("gene"), *(F.col(f"`{s}`").cast("int").alias(s) for s in samples))


@query("k8_gene_list_files", """SELECT concat('R', CAST(region_id AS VARCHAR)) AS region, count(DISTINCT gene) AS n, coalesce(string_agg(DISTINCT gene, ',' ORDER BY gene), '') AS genes
    FROM v_region LEFT JOIN v_gene ON r_chrom = g_chrom AND region_start <= tx_end AND tx_start <= region_end GROUP BY region_id""")
def _(v):
    path = v.folder("regions.genes")
    listed = genes.genes_of(v.region, v.gene, ["region_id"], ("r_chrom", "region_start", "region_end"))
    files.write_gene_lists(listed.withColumn("region", F.concat(F.lit("R"), F.col("region_id").cast("string"))), "region", path)
    back = v.spark.read.schema("region string, n long, genes string").option("sep", "\t").option("header", True).csv(path)
    return back.select("region", "n", F.coalesce("genes", F.lit("")).alias("genes"))


@query("s13_cytoband_files", "SELECT CAST(g_chrom AS VARCHAR) AS chrom, tx_start AS band_start, tx_end AS band_end, concat('p', CAST(p_size AS VARCHAR)) AS band FROM v_gene")
def _(v):
    path = v.folder("bands")
    lines = F.concat_ws("\t", F.concat(F.lit("chr"), F.col("g_chrom").cast("string")), "tx_start", "tx_end", F.concat(F.lit("p"), F.col("p_size").cast("string")), F.lit("gneg"))
    v.gene.select(lines).write.text(path)
    return files.read_cytobands(v.spark, path).select("chrom", "band_start", "band_end", "band")


@query("s15_lesion_files", """SELECT concat('peak', CAST(p_partkey AS VARCHAR)) AS region, sample, CAST(CASE WHEN p_partkey % 3 = 2 THEN 0 WHEN p_partkey % 3 = 0 THEN 1 ELSE -1 END * CASE WHEN p_size > t THEN 1 ELSE 0 END AS INT) AS state
    FROM part CROSS JOIN (VALUES ('A', 10), ('B', 30)) x(sample, t)""")
def _(v):
    path = v.folder("lesions.txt")
    k = F.col("p_partkey")
    name = F.when(k % 3 == 0, "Amplification Peak").when(k % 3 == 1, "Deletion Peak").otherwise("other")
    called = [(F.col("p_size") > t).cast("int").alias(s) for s, t in (("A", 10), ("B", 30))]
    table = v.table("part").select(name.alias("name"), F.lit("d").alias("descriptor"), F.concat(F.lit("peak"), k.cast("string")).alias("wide"), *(F.lit("x").alias(f"f{i}") for i in range(8)), *called)
    table.write.option("sep", "\t").option("header", True).csv(path)
    return files.read_lesions(v.spark, path).select("region", "sample", F.col("state").cast("int").alias("state"))


@query("s16_region_files", "SELECT CAST(r_chrom AS VARCHAR) AS chrom, region_start, region_end, concat('r', CAST(region_id AS VARCHAR)) AS rest FROM v_region")
def _(v):
    path = v.folder("regions.txt")
    text = coords.region_string(F.col("r_chrom"), F.col("region_start"), F.col("region_end"))
    v.region.select(F.concat(text, F.lit("\t"), F.lit("r"), F.col("region_id").cast("string"))).write.text(path)
    return files.read_regions(v.spark, path).select("chrom", "region_start", "region_end", "rest")


@query("s16_region_tables", "SELECT DISTINCT r_chrom AS chrom, region_start, region_end FROM v_region")
def _(v):
    path = v.folder("regions.tsv")
    v.region.select(F.concat_ws("\t", F.concat(F.lit("chr"), F.col("r_chrom").cast("string")), "region_start", "region_end")).write.text(path)
    return files.read_region_table(v.spark, path)


@query("s6_reference_raw_files", "SELECT 'raw_ref' AS kind, sample, marker, chrom, pos, round(value, 4) AS value FROM v_raw")
def _(v):
    path = v.folder("raw.cnref")
    files.write_raw(v.raw.withColumn("value", F.round("value", 4)), path)
    kind, df = files.read_any(v.spark, path)
    return df.filter("value is not null").select(F.lit(kind).alias("kind"), "sample", "marker", "chrom", "pos", F.round("value", 4).alias("value"))


@query("s12_gene_tables", f"SELECT sample, seg_start, gene, tx_end - tx_start AS size FROM v_seg q JOIN v_gene g ON {OVER}")
def _(v):
    """Genes in the layout of public gene tables, joined to segments."""
    path = v.folder("genes")
    name = F.concat(F.lit("chr"), coords.chrom_name(F.col("g_chrom")))
    ends = [F.concat(F.col(c).cast("string"), F.lit(",")) for c in ("tx_start", "tx_end")]
    table = v.gene.select(F.lit(0), "gene", name, F.lit("+"), *("tx_start", "tx_end") * 2, F.lit(1), *ends, F.lit(0), F.col("gene").alias("name2"), F.lit("cmpl"), F.lit("cmpl"), F.lit("0,"))
    table.toDF(*files.REF_GENE.split()).write.option("sep", "\t").csv(path)
    got = files.read_genes(v.spark, path).select("gene", "g_chrom", "tx_start", "tx_end")
    return intervals.overlap_join(v.seg, got, genes.SEG, genes.GENE).select("sample", "seg_start", "gene", (F.col("tx_end") - F.col("tx_start")).alias("size"))


@query("k6_full_segment_files", "SELECT sample, chrom, seg_start, seg_end, n_markers, state / CAST(3 AS DOUBLE) AS state FROM v_seg")
def _(v):
    path = v.folder("full.seg")
    files.write_segments(v.seg.withColumn("state", F.col("state") / 3), path, full=True)
    return files.read_segments(v.spark, path)


@query("k9_peak_files", """SELECT concat_ws(chr(9), CAST(row_number() OVER (ORDER BY r_chrom, region_start, region_end) AS VARCHAR), CAST(r_chrom AS VARCHAR), CAST(region_start AS VARCHAR), CAST(region_end AS VARCHAR), CAST(region_start AS VARCHAR), CAST(region_end AS VARCHAR),
    CAST(region_start - 10 AS VARCHAR), CAST(region_end + 10 AS VARCHAR), '2', concat('A', CAST(region_id AS VARCHAR), ',B'), '1', 'C') AS line FROM v_region""")
def _(v):
    path = v.folder("peaks.txt")
    genes_of = [F.array(F.concat(F.lit("A"), F.col("region_id").cast("string")), F.lit("B")).alias("region_genes"), F.array(F.lit("C")).alias("wide_genes")]
    places = [F.col("region_start").alias("peak_start"), F.col("region_end").alias("peak_end"), (F.col("region_start") - 10).alias("wide_start"), (F.col("region_end") + 10).alias("wide_end")]
    files.write_peaks(v.region.select(F.col("r_chrom").alias("chrom"), "region_start", "region_end", *places, *genes_of), path)
    return v.spark.read.text(path).filter("value not like 'index%'").withColumnRenamed("value", "line")


DEFAULT_CASE = SCORE_CASE.replace("< 3000", "< 12000000").replace("< 2000", "< 12000000").replace("CAST(0.6 AS DOUBLE)", "log2(CAST(2.5 AS DOUBLE))").replace("CAST(-0.6 AS DOUBLE)", "log2(CAST(0.35 AS DOUBLE))")


@query("p11_default_scores", f"SELECT sample, chrom, seg_start, CAST({DEFAULT_CASE} AS INT) AS score FROM (SELECT sample, chrom, seg_start, seg_end, state * 2 AS state FROM v_seg) q")
def _(v):
    return v.seg.select("sample", "chrom", "seg_start", predicates.state_score(F.col("state") * 2, F.col("seg_start"), F.col("seg_end")).alias("score"))


@query("convert_allele_raw_to_segments", """WITH a AS (SELECT *, cn % 2 AS a, cn AS b FROM v_raw), c AS (SELECT *, CASE WHEN lag(cn) OVER w IS NULL OR lag(a) OVER w <> a OR lag(b) OVER w <> b THEN 1 ELSE 0 END AS n FROM a WINDOW w AS (PARTITION BY sample, chrom ORDER BY pos)),
    d AS (SELECT *, sum(n) OVER (PARTITION BY sample, chrom ORDER BY pos) AS run FROM c) SELECT sample, chrom, min(pos) AS seg_start, max(pos) AS seg_end, count(*) AS n_markers, CAST(min(a) AS DOUBLE) AS a, CAST(min(b) AS DOUBLE) AS b FROM d GROUP BY sample, chrom, run""")
def _(v):
    path = v.folder("raw.cnas")
    files.write_raw(v.raw.withColumn("value", F.struct((F.col("cn") % 2).cast("double").alias("a"), F.col("cn").cast("double").alias("b"))), path)
    kind, df = files.read_any(v.spark, path)
    out = files.convert(kind, df.filter("value.a is not null"), "segmented_ascn")
    return out.select("sample", "chrom", "seg_start", "seg_end", "n_markers", "state.a", "state.b")


def _command(v: Views, *args: str) -> DataFrame:
    """The segments that a command writes of v_seg, with v_ref as its reference."""
    from .. import commands

    given, reference, out = v.folder("x.seg"), v.folder("r.segref"), v.folder("y.seg")
    files.write_segments(v.seg, given)
    files.write_segments(v.ref.select(F.lit("R").alias("sample"), "chrom", "seg_start", "seg_end", F.lit(1).cast("long").alias("n_markers"), F.lit(0.0).alias("state")), reference)
    commands.run(v.spark, [args[0], given, out, *(reference if a == "REFERENCE" else a for a in args[1:])])
    return files.read_segments(v.spark, out)


@query("filter_command", _exists("query", 0.5, False))
def _(v):
    return _command(v, "filter", "--reference", "REFERENCE", "--score", "query")


@query("filter_command_aberrant_inverse", _exists("dice", 0.2, True, aberrant=True))
def _(v):
    return _command(v, "filter", "--reference", "REFERENCE", "--threshold", "0.2", "--aberrant", "--state-diff", "0.4", "--inverse")


@query("clean_command", f"SELECT {COLS} FROM v_seg WHERE n_markers >= 20 AND seg_end - seg_start + 1 >= 500 AND state > 0 - CAST(0.4 AS DOUBLE) AND state < CAST(0.4 AS DOUBLE)")
def _(v):
    return _command(v, "clean", "--count", "20", "--length", "500", "--aberrant", "--state-diff", "0.4")


@query("a22_filtered_counts", "SELECT sample, count(*) FILTER (WHERE n_markers < 25) AS n_filtered, count(*) AS n FROM v_seg GROUP BY sample")
def _(v):
    return v.seg.groupBy("sample").agg(F.count_if(predicates.spurious(F.col("n_markers"), 25)).alias("n_filtered"), F.count("*").alias("n"))


@query("c4_best_split", """WITH a AS (SELECT sample, chrom, pos, value - avg(value) OVER p AS x, count(*) OVER p AS n FROM v_raw WINDOW p AS (PARTITION BY sample, chrom)),
    b AS (SELECT sample, chrom, n, sum(x) OVER w AS s, count(*) OVER w AS i FROM a WINDOW w AS (PARTITION BY sample, chrom ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))
    SELECT sample, chrom, round(sqrt(coalesce(max(CASE WHEN i BETWEEN 2 AND n - 2 THEN n * s * s / (i * (n - i)) END), 0)), 7) AS split_stat FROM b GROUP BY sample, chrom""")
def _(v):
    return stats.best_split(v.raw, ["sample", "chrom"], ["pos"], "value").withColumn("split_stat", F.round("split_stat", 7))


@query("t2_sorted_raw", "SELECT chrom, pos, sample, value FROM v_raw ORDER BY chrom, pos, sample")
def _(v):
    return v.raw.select("chrom", "pos", "sample", "value").orderBy("chrom", "pos", "sample")


@query("t4_sort_command", "SELECT DISTINCT marker, chrom, pos FROM v_raw")
def _(v):
    from .. import commands

    given, out = v.folder("unsorted.txt"), v.folder("sorted.txt")
    rows = v.raw.select("marker", "chrom", "pos").distinct().orderBy(F.desc("marker"))
    rows.write.option("sep", "\t").option("header", True).csv(given)
    commands.run(v.spark, ["sort", given, out])
    return files.read_markers(v.spark, out, named=True).select("marker", "chrom", "pos")


@query("t6_genes_by_start", "SELECT g_chrom, gene, tx_start FROM v_gene ORDER BY g_chrom, tx_start, gene")
def _(v):
    return v.gene.select("g_chrom", "gene", "tx_start").orderBy("g_chrom", "tx_start", "gene")


@query("u3_distinct_peaks", "SELECT r_chrom, region_start, max(region_end) AS region_end FROM (SELECT * FROM v_region UNION ALL SELECT region_id, r_chrom, region_start, region_end + region_id % 3 - 1 FROM v_region) q GROUP BY r_chrom, region_start")
def _(v):
    again = v.region.withColumn("region_end", F.col("region_end") + F.col("region_id") % 3 - 1)
    return v.region.unionByName(again).groupBy("r_chrom", "region_start").agg(F.max("region_end").alias("region_end"))


@query("u4_marker_intersection", "SELECT sample, marker, value FROM v_raw r WHERE EXISTS (SELECT 1 FROM v_raw x WHERE x.marker = r.marker AND x.cn = 0)")
def _(v):
    return v.raw.join(v.raw.filter("cn = 0").select("marker").distinct(), "marker", "left_semi").select("sample", "marker", "value")


@query("r4_region_sizes", "SELECT region_id, region_end - region_start + 1 AS region_size, CASE r_chrom WHEN 23 THEN 'chrX' WHEN 24 THEN 'chrY' ELSE concat('chr', CAST(r_chrom AS VARCHAR)) END AS chrom_name FROM v_region")
def _(v):
    return v.region.select("region_id", coords.size(F.col("region_start"), F.col("region_end")).alias("region_size"), F.concat(F.lit("chr"), coords.chrom_name(F.col("r_chrom"))).alias("chrom_name"))


@query("x5_allele_algebra", """SELECT sample, marker, cn % 2 + 1 AS sum_a, cn + 1 AS sum_b, abs(cn % 2 - 1) AS diff_a, abs(cn - 1) AS diff_b, cn % 2 = 1 AND cn = 1 AS same, cn % 2 <> 1 OR cn <> 1 AS other, cn % 2 + cn <= 1 AS low, cn % 2 + cn >= 2 AS high FROM v_raw""")
def _(v):
    x, y = alleles.pair(F.col("cn") % 2, F.col("cn")), alleles.pair(F.lit(1), F.lit(1))
    s, d = alleles.added(x, y), alleles.difference(x, y)
    return v.raw.select(
        "sample", "marker", s["a"].alias("sum_a"), s["b"].alias("sum_b"), d["a"].alias("diff_a"), d["b"].alias("diff_b"), alleles.near(x, y).alias("same"), alleles.apart(x, y).alias("other"), alleles.at_most(x, 1).alias("low"), alleles.at_least(x, 2).alias("high"),
    )


# Changepoints (no SQL) and randomisation


@query("c20_segment")
def _(v):
    return segmentation.segment_raw(v.raw)


DRAW = "CAST('0x' || left(md5({0}), 13) AS BIGINT)"
NUMBERED = "numbered AS (SELECT gene, row_number() OVER (ORDER BY left(md5(gene), 3), gene) - 1 AS i FROM v_gene)"


@query("z1_resampled", f"WITH {NUMBERED} SELECT DISTINCT replicate, gene FROM (SELECT id % 20 AS replicate, {DRAW.format("'1:' || id")} % n AS i FROM (SELECT unnest(range(20 * n)) AS id, n FROM (SELECT count(*) AS n FROM v_gene) q1) q2) d JOIN numbered USING (i)")
def _(v):
    return genes.resampled(v.gene, 20)


@query("z2_relocated", f"""WITH d AS (SELECT *, {DRAW.format("'1:1:' || region_id || ':' || replicate")} / CAST(4503599627370496 AS DOUBLE) AS u1, {DRAW.format("'1:2:' || region_id || ':' || replicate")} / CAST(4503599627370496 AS DOUBLE) AS u2,
        region_end - region_start + 1 AS size FROM v_region CROSS JOIN (SELECT CAST(unnest(range(20)) AS INT) AS replicate) q),
    p AS (SELECT region_id, replicate, size, CAST(floor(u1 * 24) AS INT) + 1 AS r_chrom, u2 FROM d), b AS (SELECT *, CAST(floor(u2 * greatest(1000000 + r_chrom * 1000 - size + 2, 1)) AS BIGINT) AS region_start FROM p)
    SELECT region_id, replicate, r_chrom, region_start, region_start + size - 1 AS region_end FROM b""")
def _(v):
    lengths = v.spark.range(1, 25).select(F.col("id").cast("int").alias("r_chrom"), (F.col("id") * 1000 + 1_000_000).alias("length"))
    return genes.relocated(v.region, lengths, 20)


@query("z3_null_distribution", f"""WITH {NUMBERED}, hit AS (SELECT gene FROM v_gene WHERE g_chrom <= 6), k AS (SELECT count(*) AS k, (SELECT count(*) FROM v_gene) AS n FROM hit),
    d AS (SELECT DISTINCT id % 50 AS replicate, {DRAW.format("'1:' || id")} % n AS i FROM (SELECT unnest(range(50 * k)) AS id, n FROM k) q1),
    c AS (SELECT p_brand, replicate, count(*) AS c FROM d JOIN numbered USING (i) JOIN v_gene USING (gene) GROUP BY p_brand, replicate),
    o AS (SELECT p_brand, count(*) FILTER (WHERE g_chrom <= 6) AS n FROM v_gene GROUP BY p_brand)
    SELECT p_brand AS set_name, n, round(coalesce(sum(c), 0) / CAST(50 AS DOUBLE), 6) AS mean_n, round((1 + CASE WHEN n = 0 THEN 50 ELSE count(*) FILTER (WHERE c >= n) END) / CAST(51 AS DOUBLE), 6) AS p_value FROM o LEFT JOIN c USING (p_brand) GROUP BY p_brand, n""")
def _(v):
    sets = v.gene.select(F.col("p_brand").alias("set_name"), "gene")
    got = genes.overlap_significance(sets, v.gene, v.gene.filter("g_chrom <= 6"), 50)
    return got.select("set_name", "n", F.round("mean_n", 6).alias("mean_n"), F.round("p_value", 6).alias("p_value"))


# Streams: read from files until all that is there has been read


@query("stream_runs", RUNS.replace("min(cn) AS state", "CAST(min(cn) AS DOUBLE) AS state"))
def _(v):
    """m3_runs over v_raw as a stream of six files in random order, two to a micro-batch."""
    given, out = v.folder("raw"), v.folder("runs")
    v.raw.select("sample", "marker", "chrom", "pos", F.col("cn").cast("double").alias("value")).repartition(6, F.xxhash64("marker")).write.parquet(given)
    segments.runs_into(segments.read(v.spark, given, segments.RAW, maxFilesPerTrigger=2), out, v.folder("state"), available_now=True).awaitTermination()
    return segments.segments_of(v.spark.read.schema(segments.BIN_RUNS + ", batch long").parquet(out))


@query("stream_dice_anti", _exists("dice", 0.5, False))
def _(v):
    """j3_dice_anti with the segments as a stream of the files of orders."""
    out = v.folder("kept")
    orders = v.table("orders")
    orders = v.spark.readStream.schema(orders.schema).parquet(f"{v.sf_dir}/orders.parquet*")
    orders.createOrReplaceTempView("chromaspan_orders_stream")
    seg = v.spark.sql(VIEWS["v_seg"].format(orders="chromaspan_orders_stream"))
    segments.filter_into(seg, v.ref, out, v.folder("state"), available_now=True, kind="dice", threshold=0.5).awaitTermination()
    return v.spark.read.schema(segments.SCHEMA + ", batch long").parquet(out).select(*COLS.split(", "))
