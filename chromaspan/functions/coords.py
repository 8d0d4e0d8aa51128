"""Chromosomes, regions and cytobands as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

NAMES = [*map(str, range(1, 23)), "X", "Y"]


def chrom_id(c: Column, names: list[str] = NAMES) -> Column:
    """1-based number of a chromosome name, with or without chr; null for any other text."""
    known = {n: k for k, n in enumerate(names, 1)} | {str(k): k for k in range(1, len(names) + 1)}
    pairs = [F.lit(x) for n, k in known.items() for p in ("", "chr") for x in (p + n, k)]
    return F.create_map(*pairs)[c]


def chrom_name(c: Column, names: list[str] = NAMES) -> Column:
    return F.get(F.array(*map(F.lit, names)), c - 1)


def common_prefix(a: Column, b: Column) -> Column:
    """The longest common prefix, without a dot at its end if it has more than that."""
    n = F.aggregate(F.sequence(F.lit(1), F.greatest(F.length(a), F.length(b), F.lit(1))), F.lit(0), lambda s, k: F.when((s == k - 1) & (k <= F.least(F.length(a), F.length(b))) & (F.substring(a, k, 1) == F.substring(b, k, 1)), k).otherwise(s))
    p = F.left(a, n)
    return F.when((F.length(p) > 1) & p.endswith("."), F.left(p, F.length(p) - 1)).otherwise(p)


def file_extension(c: Column) -> Column:
    """What follows the last dot; all of it without one, or if the dot is last."""
    e = F.substring_index(c, ".", -1)
    return F.when((e == "") | (F.instr(c, ".") == 0), c).otherwise(e)


def file_stem(c: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(c, r"^.*/", ""), r"\.[^.]*$", "")


def file_path(c: Column) -> Column:
    p = F.regexp_extract(c, r"^(.*/)", 1)
    return F.when(p == "", F.lit("./")).otherwise(p)


#: What a file's extension says it holds.
DATA_TYPES = {"cn": "raw", "seg": "segmented", "cnref": "raw_ref", "segref": "segmented_ref", "cnas": "raw_ascn", "segas": "segmented_ascn", "lrrbaf": "raw_lrrbaf"}

REGION = r"^chr(\d+|X|Y)(?::(\d+)-(\d+))?(?:\((?:probes )?(\d+):(\d+)\))?(?:\|(\w))?"


def parse_region(c: Column) -> Column:
    """Struct of a coordinate like chr3:100-200(probes 5:9)|G: chrom, region_start, region_end, n_markers, state.

    The probe count is first minus last plus one, as given. Text after a match is ignored; null without a match.
    """
    g = lambda k: F.nullif(F.regexp_extract(c, REGION, k), F.lit(""))
    state = F.when(g(6) == "G", 1).when(g(6) == "L", -1).otherwise(0)
    return F.when(
        c.rlike(REGION),
        F.struct(g(1).alias("chrom"), g(2).cast("long").alias("region_start"), g(3).cast("long").alias("region_end"), F.coalesce(g(4).cast("long") - g(5).cast("long") + 1, F.lit(0).cast("long")).alias("n_markers"), state.alias("state")),
    )


def region_string(chrom: Column, start: Column, end: Column, state: Column | None = None) -> Column:
    base = F.concat(F.lit("chr"), chrom.cast("string"), F.lit(":"), start.cast("string"), F.lit("-"), end.cast("string"))
    return base if state is None else F.concat(base, F.when(state > 0, "|G").when(state < 0, "|L").otherwise("|0"))


BAND = r"^(?:chr)?(\d+|X|Y)(?:([pq])(\d+)?(?:\.(\d+))?)?$"


def band_prefix(c: Column) -> Column:
    """Struct of a cytoband like 3p21.1: chrom and the prefix that its bands' names begin with; null for other text."""
    g = lambda k: F.regexp_extract(c, BAND, k)
    return F.when(c.rlike(BAND), F.struct(g(1).alias("chrom"), F.concat(g(2), g(3), F.when(g(4) != "", F.concat(F.lit("."), g(4))).otherwise("")).alias("prefix")))


def size(start: Column, end: Column) -> Column:
    return end - start + 1
