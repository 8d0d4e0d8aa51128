"""Genes, regions and gene sets: coverage, scores, annotation, matrices and randomisation."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, IntegerType, LongType, StringType, StructField, StructType

from ..functions.coords import size
from ..functions.overlap import intersection, overlaps
from . import scan
from .best import Rule, best_in_regions, best_parts
from .intervals import BIN, at_home, bins, for_each_sample, overlap_join, spread

GENE = ("g_chrom", "tx_start", "tx_end")
SEG = ("chrom", "seg_start", "seg_end")
PART = 16_000_000  # characters of lists that are handed on together


def first_transcripts(genes: DataFrame) -> DataFrame:
    """One row for each gene: the transcript that starts, then ends, first."""
    return genes.groupBy("gene").agg(F.min_by(F.struct(*genes.columns), F.struct("tx_start", "tx_end")).alias("_g")).select("_g.*")


def region_union(s1: Column, e1: Column, s2: Column, e2: Column) -> Column:
    """Struct of the hull of two regions that overlap; null else."""
    return F.when(overlaps(s1, e1, s2, e2), F.struct(F.least(s1, s2).alias("region_start"), F.greatest(e1, e2).alias("region_end")))


def region_intersection(s1: Column, e1: Column, s2: Column, e2: Column) -> Column:
    return F.when(overlaps(s1, e1, s2, e2), F.struct(F.greatest(s1, s2).alias("region_start"), F.least(e1, e2).alias("region_end")))


def _added(array: str, f: Callable[[Column], Column], unrolled: int, most: int | None = None) -> Column:
    """The sum of f over an array's elements, of which there are `most` at most (None: unknown). The first `unrolled` are
    written out, as generated code; only if there may be more a lambda is used, which keeps all of a step from that."""
    zero = F.lit(0).cast("long")
    out = zero
    if most is None or most > unrolled:
        out = F.when(F.size(array) > unrolled, F.aggregate(F.slice(array, unrolled + 1, F.greatest(F.size(array) - unrolled, F.lit(0))), zero, lambda s, x: s + f(x))).otherwise(zero)
    for k in reversed(range(unrolled if most is None else min(unrolled, most))):
        out = F.when(F.size(array) > k, f(F.get(array, F.lit(k))) + out).otherwise(zero)
    return F.when(F.col(array).isNotNull(), out)


def covered(exons: str, start: Column, end: Column, unrolled: int = 8) -> Column:
    """The share of the exons' positions that [start, end] covers; exons: an array of structs (start, end)."""
    return _added(exons, lambda x: intersection(start, end, x["start"], x["end"]), unrolled) / _added(exons, lambda x: size(x["start"], x["end"]), unrolled).cast("double")


def of_name(genes: DataFrame, exons: str) -> DataFrame:
    """genes, each with the exons of all rows of its name."""
    return genes if _once(genes, ["gene"]) else genes.withColumn(exons, F.flatten(F.collect_list(exons).over(Window.partitionBy("gene"))))


def coverage(segments: DataFrame, genes: DataFrame, key: list[str], exons: str = "exons", digits: int = 9, few: int = 3) -> DataFrame:
    """(key, gene, coverage): of the genes that a key's segments overlap, the share of the exons' positions that these
    cover on average; genes without exons have none. key has the segments' start.

    Segments of a key and chromosome that start at one place meet a gene together, as one row with their ends, each with
    how many end there, so no pairs are compared but those of genes in several rows. Up to `few` ends are met by
    generated code.
    """
    g = of_name(genes, exons).filter(F.size(exons) > 0)
    apart = _once(g, ["gene"])
    g = g.select("gene", *GENE, F.col(exons).alias("_x"), _added(exons, lambda x: F.coalesce(size(x["start"], x["end"]), F.lit(0)), 8).alias("_size"))
    most = g.agg(F.max(F.size("_x"))).first()[0] or 0
    chrom, start, end = SEG
    s, of = segments.dropna(subset=[*SEG]), list(dict.fromkeys([*key, chrom, start]))
    width, levels = bins(s, g, SEG, GENE)
    alike = spread(s, *of).groupBy(*dict.fromkeys([*of, end])).agg(F.count("*").alias("n"))
    ends = alike.groupBy(*of).count().agg(F.max("count")).first()[0] or 0

    def met(s: DataFrame, ends: int | None) -> DataFrame:
        p = overlap_join(s, g, (chrom, start, "_end"), GENE, bin_width=width, levels=levels)
        places = lambda e: _added("_x", lambda x: intersection(F.col(start), e, x["start"], x["end"]), 8, most)
        if ends == 1:
            times = F.lit(1) if apart else F.col("n")
            return p.select(*key, "gene", (places(F.col("_end")) * times).alias("_n"), (F.col("_size") * times).alias("_of"))
        add = lambda f: _added("_ends", lambda e: F.when(e["end"] >= F.col(GENE[1]), f(e["end"]) * e["n"]).otherwise(F.lit(0).cast("long")), ends or 0, ends)
        return p.select(*key, "gene", add(places).alias("_n"), (add(lambda _: F.lit(1).cast("long")) * F.col("_size")).alias("_of"))

    if ends <= 1:
        p = met(alike.select(*of, F.col(end).alias("_end"), "n"), 1)
    else:
        s = alike.groupBy(*of).agg(F.collect_list(F.struct(F.col(end).alias("end"), "n")).alias("_ends"), F.max(end).alias("_end"))
        p = met(s.filter(F.size("_ends") == 1).select(*of, "_end", F.get("_ends", F.lit(0))["n"].alias("n")), 1).unionByName(met(s.filter(F.size("_ends").between(2, few)), few))
        p = p.unionByName(met(s.filter(F.size("_ends") > few), None)) if ends > few else p
    if not apart:
        p = p.groupBy(*key, "gene").agg(F.sum("_n").alias("_n"), F.sum("_of").alias("_of"))
    return p.select(*key, "gene", nearest(F.col("_n") / F.nullif(F.col("_of"), F.lit(0)).cast("double"), digits).alias("coverage"))


def nearest(x: Column, digits: int) -> Column:
    """x, from 0 to 1, rounded half up. Spark's round takes each value through its decimal digits."""
    return F.floor(x * float(10**digits) + 0.5) / float(10**digits)


def coding_exons(exons: Column, cds_start: Column, cds_end: Column, compat: bool = False) -> Column:
    """The exons' parts within the coding region. compat: where one exon holds all of it, its two overlapping pieces."""
    parts = F.transform(F.filter(exons, lambda x: (x["end"] >= cds_start) & (x["start"] <= cds_end)), lambda x: F.struct(F.greatest(x["start"], cds_start).alias("start"), F.least(x["end"], cds_end).alias("end")))
    if not compat:
        return parts
    one = F.filter(exons, lambda x: (x["end"] >= cds_start) & (x["start"] <= cds_end))
    twice = F.array(F.struct(cds_start.alias("start"), F.get(one, F.lit(0))["end"].alias("end")), F.struct(F.get(one, F.lit(0))["start"].alias("start"), cds_end.alias("end")))
    return F.when(F.size(parts) == 1, twice).otherwise(parts)


def genes_of(regions: DataFrame, genes: DataFrame, key: list[str], cols=SEG, left: bool = True, width: int = BIN, part: int = PART) -> DataFrame:
    """Of each region its genes: key, n_genes and their sorted names with commas; regions without any have 0 and ''.

    A region's list is put together where its genes are, by start and in parts of `part` characters, so a task holds a
    part and one list at most; only where rows share a key lists are shuffled, to join them."""
    at = [f"_q{k}" for k in range(3)]
    rows = regions.select(*key, *(F.col(c).alias(a) for c, a in zip(cols, at, strict=True))).distinct()
    schema = StructType([*rows.select(*key).schema.fields, StructField("_g", ArrayType(StringType()))])

    def listed(x: pd.DataFrame, y: pd.DataFrame, as_text: bool = False) -> Iterator[pd.DataFrame]:
        x, y = x.sort_values(["_s", "_e"], kind="stable"), y.dropna(subset=["gene"]).sort_values("gene")
        names, start, end = y["gene"].to_numpy(object), y["_s"].to_numpy(), y["_e"].to_numpy()
        again, long = y["gene"].duplicated().any(), y["gene"].str.len().to_numpy() + 1
        last, begin, held, lists = None, 0, 0, []
        for k, place in enumerate(zip(x["_s"].tolist(), x["_e"].tolist(), strict=True), 1):
            if place != last:
                hit = np.flatnonzero((start <= place[1]) & (end >= place[0]))
                found, last, size = names[hit].tolist(), place, int(long[hit].sum())
                found = list(dict.fromkeys(found)) if again else found
                found = (len(found), ",".join(found)) if as_text else found
            lists.append(found)
            held += size
            if held >= part or k == len(x):
                columns = dict(zip(("n_genes", "genes"), zip(*lists, strict=True), strict=True)) if as_text else {"_g": lists}
                yield x[key].iloc[begin:k].assign(**columns)
                begin, held, lists = k, 0, []

    def text(x: pd.DataFrame, y: pd.DataFrame) -> Iterator[pd.DataFrame]:
        return listed(x, y, True)

    whole = {*cols} <= {*key} or _once(rows, key)
    if whole:
        schema = StructType([*schema.fields[:-1], StructField("n_genes", LongType()), StructField("genes", StringType())])
    got = at_home(rows, genes.select("gene", *GENE), tuple(at), GENE, text if whole else listed, schema, width, lone=True)
    nowhere = rows.filter(" or ".join(f"{c} is null" for c in at)).select(*key)
    if whole:
        got = got.unionByName(nowhere.withColumns({"n_genes": F.lit(0).cast("long"), "genes": F.lit("")}))
    else:
        got = got.unionByName(nowhere.withColumn("_g", F.array().cast("array<string>"))).groupBy(*key).agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("_g")))).alias("_g"))
        got = got.select(*key, F.size("_g").cast("long").alias("n_genes"), F.array_join("_g", ",").alias("genes"))
    return got if left else got.filter("n_genes > 0")


def most_extreme(score: str) -> Column:
    """The score of largest magnitude; a loss before a gain."""
    return F.coalesce(F.max_by(score, F.struct(F.abs(score), -F.col(score))), F.lit(0)).cast("int")


def _once(df: DataFrame, key: list[str]) -> bool:
    """Whether no key has two rows."""
    return df.groupBy(*key).count().filter("count > 1").isEmpty()


def _best(targets: DataFrame, scored: DataFrame, key: list[str], cols: tuple[str, str, str], rule: Rule, exons: str | None = None, width: int = BIN) -> DataFrame:
    """(key, sample, score) of the best segment of each sample by the rule; see best.best_parts. Rows of targets that
    share a key are one target."""
    if not rule.relaxed:
        targets = targets.withColumns({"_xs": F.transform(exons, lambda x: x["start"]), "_xe": F.transform(exons, lambda x: x["end"])})
    targets = targets.select(*key, *cols, *([] if rule.relaxed else ["_xs", "_xe"]))
    schema = StructType([*targets.select(*key).schema.fields, scored.schema["sample"], StructField("score", IntegerType()), StructField("_share", DoubleType())])
    got = at_home(targets, scored.select("sample", *SEG, F.col("score").cast("int").alias("score")), cols, SEG, best_parts(key, rule), schema, width)
    if _once(targets, key):
        return got.drop("_share")
    value = F.max_by("score", F.struct("_share", -F.col("score"))) if rule.greatest else most_extreme("score")
    return got.groupBy(*key, "sample").agg(value.cast("int").alias("score"))


def region_scores(regions: DataFrame, scored: DataFrame, key: list[str], cols=("r_chrom", "region_start", "region_end"), least: float = 0.0, dense: bool = True) -> DataFrame:
    """(key, sample, score): of each region in each sample the most extreme score of its segments (0 without any; such
    rows only if dense); least > 0 leaves out segments that cover that share of the region or less."""
    given = scored.withColumn("score", F.coalesce("score", F.lit(0)))
    whole = regions.withColumn("_whole", F.array(F.struct(F.col(cols[1]).alias("start"), F.col(cols[2]).alias("end"))))
    got = _best(whole, given, key, cols, Rule(relaxed=least <= 0, gain=least, loss=least), "_whole")
    if not dense:
        return got
    every = for_each_sample(regions.select(*key).distinct(), scored)
    return every.join(got, [*key, "sample"], "left").select(*key, "sample", F.coalesce("score", F.lit(0)).alias("score"))


def gene_scores(genes: DataFrame, scored: DataFrame, gain: float = 0.5, loss: float = 0.5, exons: str = "exons", relaxed: bool = False, greatest: bool = False) -> DataFrame:
    """(gene, sample, score) where a segment overlaps a gene and scores.

    A segment counts if it covers more than `gain` (or `loss`) of the gene's exons; relaxed: if it overlaps at all.
    The most extreme score holds, or (greatest) that of the segment which covers most, a loss before a gain.
    """
    limits = {} if relaxed else {"gain": gain, "loss": loss}
    return _best(genes, scored.filter("score <> 0"), ["gene"], GENE, Rule(relaxed and not greatest, greatest, **limits), exons)


def inside(regions: DataFrame, genes: DataFrame, key: list[str], cols=("r_chrom", "region_start", "region_end")) -> DataFrame:
    """(key, gene): the genes in each region, each once. Pairs are only compared where a key or a gene has several rows."""
    r, g = regions.select(*key, *cols).distinct(), genes.select("gene", *GENE).distinct()
    pairs = overlap_join(r, g, cols, GENE).select(*key, "gene")
    return pairs if _once(r, key) and _once(g, ["gene"]) else pairs.distinct()


def scores_in_regions(regions: DataFrame, genes: DataFrame, scored: DataFrame, key: list[str], cols=("r_chrom", "region_start", "region_end"), relaxed: bool = False, **options) -> DataFrame:
    """(key, gene, sample, score) of the genes in each region. relaxed: a gene counts by the segments that overlap it
    within the region."""
    if not relaxed:
        return inside(regions, genes, key, cols).join(gene_scores(genes, scored, **options), "gene")
    # Genes and segments are dealt to the bins of the regions that they may reach, where pairs arise and are scored: they aren't shuffled.
    r, g = regions.select(*key, *cols).distinct(), genes.select("gene", *GENE).distinct()
    of = scored.filter("score <> 0").select("sample", F.col("score").cast("int").alias("score"), *SEG, F.lit(False).alias("_gene"))
    both = of.unionByName(g.select("gene", *(F.col(c).alias(n) for c, n in zip(GENE, SEG, strict=True)), F.lit(True).alias("_gene")), allowMissingColumns=True)
    schema = StructType([*r.select(*key).schema.fields, g.schema["gene"], scored.schema["sample"], StructField("score", IntegerType()), StructField("_share", DoubleType())])
    got = at_home(r, both, cols, SEG, best_in_regions(key, Rule(relaxed=True)), schema, 2 * BIN).drop("_share")
    return got if _once(r, key) and _once(g, ["gene"]) else got.groupBy(*key, "gene", "sample").agg(most_extreme("score").alias("score"))


def united(df: DataFrame, keys: list[str], cols: tuple[str, str], width: int = BIN) -> DataFrame:
    """(keys, cols): the places that intervals of a key cover, as intervals that don't overlap."""
    start, end = cols
    d = df.select(*keys, start, end).dropna().filter(F.col(start) <= F.col(end))
    before = lambda place, _, given: F.greatest(F.max(end).over(place.rowsBetween(Window.unboundedPreceding, -1)), given["_reach"])
    d = scan.scanned(d, keys, [start, end], {"_top": F.max(end)}, {"_reach": lambda before, _: F.max("_top").over(before)}, {"_before": before}, width)
    d = d.withColumn("_new", F.coalesce(F.col(start) > F.col("_before"), F.lit(True)).cast("long"))
    return scan.prefix(d, keys, [start, end], {"_run": F.col("_new")}, width=width).groupBy(*keys, "_run").agg(F.min(start).alias(start), F.max(end).alias(end)).drop("_run")


def scores_in_any_region(regions: DataFrame, genes: DataFrame, scored: DataFrame, cols=("r_chrom", "region_start", "region_end")) -> DataFrame:
    """(gene, sample, score): the most extreme score of the segments that overlap the gene within some region.

    Where segments of one score lie is cut to where regions lie: such pieces are no more than segments and regions."""
    where, which = united(regions, [cols[0]], cols[1:]), united(scored.filter("score <> 0"), ["sample", "chrom", "score"], SEG[1:])
    cut = overlap_join(which, where, SEG, cols).select("sample", "chrom", "score", F.greatest(cols[1], "seg_start").alias("seg_start"), F.least(cols[2], "seg_end").alias("seg_end"))
    return gene_scores(genes, cut, relaxed=True)


def matrix(scores: DataFrame, row: str, samples: list[str] | None = None) -> DataFrame:
    """A row for each `row`, a column for each sample (those there are, unless given), 0 where there is no score."""
    names = sorted(r.sample for r in scores.select("sample").distinct().collect()) if samples is None else samples
    return scores.groupBy(row).pivot("sample", names).agg(F.first("score")).na.fill(0)


def set_overlaps(sets: DataFrame, genes: DataFrame) -> DataFrame:
    """(set_name, n): how many of the genes each set (set_name, genes array) holds."""
    hit = sets.select("set_name", F.explode(F.array_distinct("genes")).alias("gene")).join(genes.select("gene").distinct(), "gene").groupBy("set_name").agg(F.count("*").alias("_n"))
    return sets.select("set_name").distinct().join(hit, "set_name", "left").select("set_name", F.coalesce("_n", F.lit(0)).alias("n"))


def draw(*parts) -> Column:
    """A number below 2**52 that depends on the parts alone: the first 13 hex digits of the MD5 of their decimal forms, joined by ':'."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", *(p if isinstance(p, Column) else F.lit(p) for p in parts)).cast("binary")), 1, 13), 16, 10).cast("long")


def resampled(genes: DataFrame, replicates: int, seed: int = 1) -> DataFrame:
    """(replicate, gene): as many genes drawn with replacement, each kept once. Genes are numbered by the first three hex
    digits of their MD5, then by name, in bins of the former."""
    spark = genes.sparkSession
    n = genes.count()
    dealt = genes.select("gene", F.conv(F.substring(F.md5(F.col("gene").cast("binary")), 1, 3), 16, 10).cast("long").alias("_h"))
    numbered = scan.prefix(dealt, [], ["_h", "gene"], count="_n", width=1).select("gene", (F.col("_n") - 1).alias("_i"))
    draws = spark.range(n * replicates).select((F.col("id") % replicates).alias("replicate"), (draw(seed, F.col("id")) % max(1, n)).alias("_i"))
    return draws.distinct().join(numbered, "_i").select("replicate", "gene")


def overlap_significance(sets: DataFrame, genes: DataFrame, hits: DataFrame, replicates: int, seed: int = 1) -> DataFrame:
    """(set_name, n, mean_n, p_value): how many of the hit genes each set (set_name, gene) holds, the mean for as many
    genes drawn from all of them, and the share of draws, this one included, that hold as many or more.

    A draw is the drawn numbers below the number of hits; counts by set and draw are all that is kept of them.
    """
    hits, members = hits.select("gene").distinct(), sets.select("set_name", "gene").distinct()
    k, n = hits.count(), genes.count()
    observed = members.join(hits, "gene").groupBy("set_name").agg(F.count("*").alias("n"))
    numbered = scan.prefix(genes.select("gene", F.conv(F.substring(F.md5(F.col("gene").cast("binary")), 1, 3), 16, 10).cast("long").alias("_h")), [], ["_h", "gene"], count="_n", width=1)
    draws = genes.sparkSession.range(k * replicates).select((F.col("id") % replicates).alias("replicate"), (draw(seed, F.col("id")) % max(1, n) + 1).alias("_n")).distinct()
    counts = draws.join(numbered.select("_n", "gene"), "_n").join(members, "gene").groupBy("set_name", "replicate").agg(F.count("*").alias("_k"))
    known = members.select("set_name").distinct().join(observed, "set_name", "left").select("set_name", F.coalesce("n", F.lit(0)).alias("n"))
    drawn = counts.join(known, "set_name").groupBy("set_name").agg(F.sum("_k").alias("_sum"), F.count_if(F.col("_k") >= F.col("n")).alias("_as_many"))
    out = known.join(drawn, "set_name", "left")
    as_many = F.when(F.col("n") == 0, F.lit(replicates)).otherwise(F.coalesce("_as_many", F.lit(0)))
    return out.select("set_name", "n", (F.coalesce("_sum", F.lit(0)) / replicates).alias("mean_n"), ((as_many + 1) / (replicates + 1)).alias("p_value"))


def relocated(regions: DataFrame, lengths: DataFrame, replicates: int, seed: int = 1, other_chromosome: bool = True) -> DataFrame:
    """Regions (region_id, r_chrom, region_start, region_end) at random places of chromosomes (r_chrom, length) of at most some dozens."""
    all_ = lengths.orderBy("r_chrom").collect()
    chroms = F.array(*[F.struct(F.lit(r.r_chrom).alias("c"), F.lit(int(r.length)).cast("long").alias("n")) for r in all_])
    out = regions.withColumn("replicate", F.explode(F.sequence(F.lit(0), F.lit(replicates - 1))))
    u = lambda k: draw(seed, k, F.col("region_id"), F.col("replicate")) / float(1 << 52)
    pick = F.get(chroms, F.floor(u(1) * len(all_)).cast("int")) if other_chromosome else F.get(F.filter(chroms, lambda x: x["c"] == F.col("r_chrom")), F.lit(0))
    long = size(F.col("region_start"), F.col("region_end"))
    out = out.withColumn("_p", pick)
    start = F.floor(u(2) * F.greatest(F.col("_p.n") - long + 2, F.lit(1)))
    return out.select("region_id", "replicate", F.col("_p.c").alias("r_chrom"), start.alias("region_start"), (start + long - 1).alias("region_end"))
