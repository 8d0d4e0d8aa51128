"""Readers and writers of marker, raw, segment and gene-set files, and conversion between them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.coords import DATA_TYPES, chrom_id, chrom_name, parse_region
from ..operators import merge
from ..operators.intervals import running_count

CELLS = 250_000  # cells of a matrix that a task puts together, about
NAMES = 100_000  # samples of a matrix that are broadcast at most
INT, REAL = r"^\d+$", r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$|^-?(nan|inf|infinity)$"


def _number(c: str, kind: str):
    """The number that the whole field is; null for anything else."""
    pattern = REAL if kind == "double" else INT
    return F.when(F.col(f"`{c}`").rlike(pattern) & ~F.col(f"`{c}`").startswith("+"), F.expr(f"try_cast(`{c}` as {kind})"))


def _table(spark: SparkSession, paths, sep: str, columns: list[str] | None, header: bool = True) -> DataFrame:
    reader = spark.read.option("sep", sep).option("header", header).option("quote", "").option("mode", "PERMISSIVE")
    if columns is None:
        return reader.csv(paths)
    return reader.schema(", ".join(f"`{c}` string" for c in columns)).option("enforceSchema", True).csv(paths)


def _known(df: DataFrame) -> DataFrame:
    return df.withColumn("chrom", chrom_id(F.col("chrom"))).filter("chrom is not null")


def read_segments(spark: SparkSession, paths, sep: str = "\t", reference: bool = False, header: bool = True) -> DataFrame:
    """Rows with an unknown chromosome go; a field that is no number is null. reference: positions only, of sample ALL."""
    df = _known(_table(spark, paths, sep, ["sample", "chrom", "s", "e", "n", "v"], header))
    out = df.select("sample", "chrom", _number("s", "long").alias("seg_start"), _number("e", "long").alias("seg_end"), _number("n", "long").alias("n_markers"), _number("v", "double").alias("state"))
    return merge.pooled(out) if reference else out


def read_allele_segments(spark: SparkSession, paths, sep: str = "\t") -> DataFrame:
    df = _known(_table(spark, paths, sep, ["sample", "chrom", "s", "e", "n", "a", "b"]))
    state = F.struct(_number("a", "double").alias("a"), _number("b", "double").alias("b")).alias("state")
    return df.select("sample", "chrom", _number("s", "long").alias("seg_start"), _number("e", "long").alias("seg_end"), _number("n", "long").alias("n_markers"), state)


def read_raw(spark: SparkSession, paths, sep: str = "\t", alleles: bool = False) -> DataFrame:
    """(sample, marker, chrom, pos, value) of matrices with a column for each sample (alleles: a pair of columns)."""
    df = _table(spark, paths, sep, None)
    marker, chrom, pos, *names = df.columns
    df = df.withColumnsRenamed({marker: "marker", chrom: "chrom", pos: "pos"})
    if len(set(names)) < len(names):
        raise ValueError("a sample name is repeated")
    if not names:
        return _known(df).select(F.lit(None).cast("string").alias("sample"), "marker", "chrom", _number("pos", "long").alias("pos"), F.lit(None).cast("double").alias("value"))
    if alleles:
        stems = [a[: max(1, len(p))] if (p := _shared(a, b)) else a for a, b in zip(names[::2], names[1::2], strict=True)]
        values = [F.struct(F.lit(_shared(a, b) or s).alias("sample"), F.struct(_number(a, "double").alias("a"), _number(b, "double").alias("b")).alias("value")) for s, a, b in zip(stems, names[::2], names[1::2], strict=True)]
    else:
        values = [F.struct(F.lit(n).alias("sample"), _number(n, "double").alias("value")) for n in names]
    long = _known(df).select("marker", "chrom", _number("pos", "long").alias("pos"), F.explode(F.array(*values)).alias("x"))
    return long.select("x.sample", "marker", "chrom", "pos", "x.value")


def _shared(a: str, b: str) -> str:
    n = next((k for k, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), min(len(a), len(b)))
    return a[:n].removesuffix(".") if n > 1 else a[:n]


def read_markers(spark: SparkSession, paths, sep: str = "\t", named: bool = False, platform: str = "default") -> DataFrame:
    df = _known(_table(spark, paths, sep, ["marker", "chrom", "p"] if named else ["chrom", "p"]))
    name = F.col("marker") if named else F.concat_ws(":", "chrom", "p")
    return df.select(F.lit(platform).alias("platform"), name.alias("marker"), "chrom", _number("p", "long").alias("pos"))


def line_ordinals(lines: DataFrame) -> DataFrame:
    """lines (file, block, line) with ordinal, a line's place in its file from 0, where block is the begin of the byte range that a task reads.

    A task numbers the lines that it reads; what it takes off is the first number of the range, and what it adds are the
    lines of the file's ranges before. Of these counts there is one for each range.
    """
    d = lines.withColumn("_id", F.monotonically_increasing_id())
    ranges = d.groupBy("file", "block").agg(F.min("_id").alias("_first"), F.count("*").alias("_lines"))
    before = F.coalesce(F.sum("_lines").over(Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ranges = ranges.select(F.col("file").alias("_file"), F.col("block").alias("_block"), (before - F.col("_first")).alias("_shift"))
    out = d.join(ranges, (F.col("file") == F.col("_file")) & (F.col("block") == F.col("_block")))
    return out.withColumn("ordinal", F.col("_id") + F.col("_shift")).drop("_id", "_file", "_block", "_shift")


def read_split_raw(spark: SparkSession, paths, markers: DataFrame, column: int, sep: str = "\t") -> DataFrame:
    """One file for each sample (named by its stem), a header and a line for each marker in order; markers has an ordinal from 0.

    Blank lines don't count. Files are read in byte ranges, so a large one is read by many tasks; a line's place comes
    from counts by range. Files with more values than there are markers raise.
    """
    text = spark.read.text(paths).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"))
    lines = line_ordinals(text.filter("value <> ''").withColumnRenamed("value", "line")).filter("ordinal > 0")
    name = F.regexp_replace(F.element_at(F.split("file", "/"), -1), r"\.[^.]*$", "")
    long = lines.select(F.url_decode(F.replace(name, F.lit("+"), F.lit("%2B"))).alias("sample"), (F.col("ordinal") - 1).alias("ordinal"), F.get(F.split("line", sep), F.lit(column)).alias("v"))
    most = lines.agg(F.max("ordinal")).first()[0]
    if most is not None and most > markers.count():
        raise ValueError("a file has more values than there are markers")
    return long.withColumn("value", _number("v", "double")).join(markers, "ordinal").select("sample", "marker", "chrom", "pos", "value")


def read_cytobands(spark: SparkSession, paths) -> DataFrame:
    df = _table(spark, paths, "\t", ["c", "s", "e", "band", "stain"], header=False)
    return df.select(F.regexp_replace("c", "^chr", "").alias("chrom"), F.expr("try_cast(s as long)").alias("band_start"), F.expr("try_cast(e as long)").alias("band_end"), "band", "stain")


def read_gene_sets(spark: SparkSession, paths) -> DataFrame:
    """(set_name, description, genes) of lines of unequal length."""
    f = F.split("value", "\t")
    return spark.read.text(paths).filter("value <> ''").select(F.get(f, F.lit(0)).alias("set_name"), F.get(f, F.lit(1)).alias("description"), F.filter(F.slice(f, F.lit(3), F.greatest(F.size(f) - 2, F.lit(0))), lambda x: x != "").alias("genes"))


# The columns of the public gene tables, in the files' order.
REF_GENE = "bin name chrom strand txStart txEnd cdsStart cdsEnd exonCount exonStarts exonEnds score name2 cdsStartStat cdsEndStat exonFrames"
KNOWN_GENE = "name chrom strand txStart txEnd cdsStart cdsEnd exonCount exonStarts exonEnds proteinID alignID"
KG_XREF = "kgID mRNA spID spDisplayID geneSymbol refseq protAcc description"


def read_genes(spark: SparkSession, paths, symbols=None) -> DataFrame:
    """(gene, transcript, g_chrom, strand, tx_start, tx_end, cds_start, cds_end, exons) of refGene tables without a header
    or, given the paths of kgXref tables, which name the genes, of knownGene tables. Positions are as in the files; rows
    of unknown chromosomes go, and so do transcripts without a name."""
    df = _table(spark, paths, "\t", (REF_GENE if symbols is None else KNOWN_GENE).split(), header=False)
    if symbols is not None:
        names = _table(spark, symbols, "\t", KG_XREF.split(), header=False).groupBy(F.col("kgID").alias("name")).agg(F.min("geneSymbol").alias("name2"))
        df = df.join(names, "name")
    starts, ends = (F.filter(F.split(c, ","), lambda x: x != "") for c in ("exonStarts", "exonEnds"))
    exons = F.zip_with(starts, ends, lambda s, e: F.struct(s.try_cast("long").alias("start"), e.try_cast("long").alias("end")))
    places = [_number(c, "long").alias(a) for c, a in (("txStart", "tx_start"), ("txEnd", "tx_end"), ("cdsStart", "cds_start"), ("cdsEnd", "cds_end"))]
    return _known(df).select(F.col("name2").alias("gene"), F.col("name").alias("transcript"), F.col("chrom").alias("g_chrom"), "strand", *places, exons.alias("exons"))


def read_lesions(spark: SparkSession, path: str, first_sample: int = 12) -> DataFrame:
    """(region, sample, state): lesion tables whose first column tells amplifications from deletions."""
    df = _table(spark, path, "\t", None)
    cols = [c for c in df.columns if not c.startswith("_c")]
    state = F.when(F.contains(F.col(cols[0]), F.lit("Amplification")), 1).when(F.contains(F.col(cols[0]), F.lit("Deletion")), -1).otherwise(0)
    values = F.array(*[F.struct(F.lit(c).alias("sample"), F.expr(f"try_cast(`{c}` as double)").alias("v")) for c in cols[first_sample - 1 :]])
    return df.select(F.trim(F.col(cols[2])).alias("region"), state.alias("sign"), F.explode(values).alias("x")).select("region", "x.sample", (F.col("sign") * F.when(F.col("x.v") > 0, 1).otherwise(0)).alias("state")).dropDuplicates(["region", "sample"])


def plain_number(c: str):
    """Six significant digits, without zeros at the end."""
    t = F.format_string("%.6g", F.col(c).cast("double"))
    return F.when(t.contains("e"), F.regexp_replace(t, r"\.?0*e", "e")).when(t.contains("."), F.regexp_replace(t, r"\.?0+$", "")).otherwise(t)


def _csv(df: DataFrame, path: str) -> None:
    df.write.option("sep", "\t").option("header", True).option("quote", "").mode("overwrite").csv(path)


def write_segments(df: DataFrame, path: str, full: bool = False) -> None:
    """States have six significant digits, or, if full, as many as they need to be read back the same."""
    number = (lambda c: F.col(c).cast("string")) if full else plain_number
    parts = {"stateA": "state.a", "stateB": "state.b"} if dict(df.dtypes)["state"].startswith("struct") else {"state": "state"}
    states = [number(c).alias(n) if len(parts) == 1 or full else F.col(c).alias(n) for n, c in parts.items()]
    _csv(df.orderBy("sample", "chrom", "seg_start", "seg_end").select("sample", F.col("chrom").alias("chromosome"), F.col("seg_start").alias("start"), F.col("seg_end").alias("end"), F.col("n_markers").alias("count"), *states), path)


# The header of peak tables; lines end before its last three columns.
PEAKS = "index chromosome region_start region_end peak_start peak_end enlarged_peak_start enlarged_peak_end n_genes_in_region genes_in_region n_genes_in_peak genes_in_peak n_genes_on_chip genes_on_chip".split()


def write_peaks(peaks: DataFrame, path: str, items: str = ",") -> None:
    """Numbered lines of peaks (chrom, region_start, region_end, peak_start, peak_end, wide_start, wide_end, and the arrays
    region_genes and wide_genes). They are numbered in one task: peaks are a study's few results."""
    at = Window.orderBy("chrom", "region_start", "region_end", "peak_start", "peak_end")
    n = peaks.withColumn("n", F.row_number().over(at))
    genes = [x for c in ("region_genes", "wide_genes") for x in (F.size(c), F.array_join(c, items))]
    line = F.concat_ws("\t", "n", "chrom", "region_start", "region_end", "peak_start", "peak_end", "wide_start", "wide_end", *genes)
    n.select("n", line.alias("\t".join([*PEAKS, "top 3"]))).orderBy("n").drop("n").write.options(sep="\u0001", header=True, quote="", ignoreTrailingWhiteSpace=False).mode("overwrite").csv(path)


def sample_names(df: DataFrame, most: int = 1_000_000) -> list[str]:
    """The names of all samples, sorted; more than `most` raise, as a header is one line."""
    return _counted(df, None, most)[0]


def _counted(df: DataFrame, samples: list[str] | None = None, most: int = 1_000_000) -> tuple[list[str], int]:
    """The samples, those there are unless given (see sample_names), and the number of rows that have one."""
    rows = df.filter("sample is not null")
    if samples is not None:
        return samples, rows.count()
    found = rows.groupBy("sample").count().limit(most + 1).collect()
    if len(found) > most:
        raise ValueError(f"more than {most} samples have no place in a header")
    return sorted(r.sample for r in found), sum(r["count"] for r in found)


def raw_matrix(raw: DataFrame, samples: list[str] | None = None) -> DataFrame:
    """A row for each marker, a column for each sample (a pair of columns for allele values): for some hundreds of samples; write_raw takes any number."""
    samples = sample_names(raw) if samples is None else samples
    wide = raw.groupBy("marker", "chrom", "pos").pivot("sample", samples).agg(F.first("value"))
    if dict(raw.dtypes)["value"].startswith("struct"):
        return wide.select("marker", "chrom", "pos", *(F.col(f"`{s}`")[x].alias(f"{s}.{x.upper()}") for s in samples for x in "ab"))
    return wide


def matrix_lines(cells: DataFrame, key: list[str], samples: list[str], values: list[Column], blank: str = "", n: int | None = None) -> DataFrame:
    """(key, line), in order of key: for each key a line of the samples' values (texts; of a sample one or more, side by side), parted by tabs.

    Only cells that are there become rows; blanks are laid out between them when a line is put together, so a row costs
    what it holds and no column is a plan's column, however many samples there are. Of several values for a cell the least stays.
    Cells are dealt once, by ranges of key, to tasks that follow their number n (counted, if not given): of about CELLS each.
    """
    spark = cells.sparkSession
    places = spark.createDataFrame([(n, k) for k, n in enumerate(samples)], "_name string, _k int")
    places = F.broadcast(places) if len(samples) <= NAMES else places  # else cells would be shuffled by sample, of which there may be few
    empty = "\t".join([blank] * len(values))
    text = F.concat_ws("\t", *(F.coalesce(v.cast("string"), F.lit(blank)) for v in values))
    tasks = max(spark.sparkContext.defaultParallelism, -(-(cells.count() if n is None else n) // CELLS))
    found = cells.join(places, F.col("sample") == F.col("_name")).select(*key, "_k", text.alias("_t")).repartitionByRange(tasks, *key)
    lines = found.groupBy(*key).agg(F.array_sort(F.collect_list(F.struct("_k", "_t"))).alias("_x"))
    lines = lines.withColumn("_x", F.filter("_x", lambda x, i: ~x["_k"].eqNullSafe(F.get("_x", i - 1)["_k"])))
    gap = lambda n: F.repeat(F.lit(empty + "\t"), n)
    laid = F.transform("_x", lambda x, i: F.concat(gap(x["_k"] - F.coalesce(F.get("_x", i - 1)["_k"], F.lit(-1)) - 1), x["_t"]))
    after = F.repeat(F.lit("\t" + empty), F.lit(len(samples) - 1) - F.get("_x", F.size("_x") - 1)["_k"])
    return lines.orderBy(*key).select(*key, F.concat(F.array_join(laid, "\t"), after).alias("line"))


def _write_lines(lines: DataFrame, header: str, path: str) -> None:
    """Lines of text (line), each file with a header."""
    lines.select(F.col("line").alias(header)).write.options(sep="\u0001", header=True, quote="", ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False).mode("overwrite").csv(path)


def write_raw(raw: DataFrame, path: str, samples: list[str] | None = None) -> None:
    """A line for each marker by place, a column for each sample (a pair for allele values); samples default to those there are."""
    samples, n = _counted(raw, samples)
    alleles = dict(raw.dtypes)["value"].startswith("struct")
    names = [f"{s}.{x}" for s in samples for x in "AB"] if alleles else samples
    lines = matrix_lines(raw, ["chrom", "pos", "marker"], samples, [F.col("value.a"), F.col("value.b")] if alleles else [F.col("value")], n=n)
    lines = lines.select(F.concat_ws("\t", *(F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("marker", "chrom", "pos")), "line").alias("line"))
    _write_lines(lines, "\t".join(["marker", "chromosome", "position", *names]), path)


def write_markers(markers: DataFrame, path: str, named: bool = True) -> None:
    rows = markers.orderBy("chrom", "pos", "marker").select("marker", chrom_name(F.col("chrom")).alias("chromosome"), F.col("pos").alias("position"))
    _csv(rows if named else rows.drop("marker"), path)


def write_gene_sets(sets: DataFrame, path: str) -> None:
    sets.select(F.concat_ws("\t", "set_name", "description", F.array_join("genes", "\t"))).write.mode("overwrite").text(path)


def kind_of(path: str) -> str:
    """The kind of data that a file's extension names."""
    kind = DATA_TYPES.get(path.rstrip("/").rpartition(".")[2])
    if kind is None or kind == "raw_lrrbaf":
        raise ValueError(f"unknown extension of {path!r}; known are {', '.join(sorted(set(DATA_TYPES) - {'lrrbaf'}))}")
    return kind


def read_any(spark: SparkSession, path: str) -> tuple[str, DataFrame]:
    """The kind of data that the file's extension names, and its rows."""
    kind = kind_of(path)
    read = {"raw": read_raw, "raw_ref": read_raw, "segmented": read_segments, "segmented_ascn": read_allele_segments}
    if kind == "raw_ascn":
        return kind, read_raw(spark, path, alleles=True)
    return kind, read_segments(spark, path, reference=True) if kind == "segmented_ref" else read[kind](spark, path)


def convert(kind: str, df: DataFrame, to: str, markers: DataFrame | None = None) -> DataFrame:
    """Rows of one kind as another; segments become raw values at the given markers. Total values can't become those of alleles."""
    if to.endswith("ascn") and not kind.endswith("ascn"):
        raise ValueError(f"{kind} can't become {to}")
    raw, seg = {"raw", "raw_ref", "raw_ascn"}, {"segmented", "segmented_ref", "segmented_ascn"}
    if kind in raw and to in seg:
        df = merge.runs(df)
    elif kind in seg and to in raw:
        if markers is None:
            raise ValueError("segments become raw values only at given markers")
        df = merge.to_raw(df, markers)
    elif not (kind in raw and to in raw or kind in seg and to in seg):
        raise ValueError(f"{kind} can't become {to}")
    return merge.pooled(df) if to == "segmented_ref" else df


def ordinal(markers: DataFrame) -> DataFrame:
    """Markers numbered from 0 by place, counted in bins along the chromosome."""
    return running_count(markers, ["chrom"], "pos", ["marker"], F.lit(1)).withColumn("ordinal", F.col("_n") - 1).drop("_n")


def read_regions(spark: SparkSession, paths, sep: str = "\t", header: bool = False) -> DataFrame:
    """Regions by the coordinate in a line's first field, like chr3:100-200|G, with the line's other fields in rest."""
    lines = _lines(spark, paths, header)
    place = parse_region(F.substring_index("value", sep, 1))
    rest = F.when(F.contains("value", F.lit(sep)), F.expr(f"substr(value, instr(value, '{sep}') + 1)"))
    return lines.withColumn("_p", place).filter("_p is not null").select("_p.*", rest.alias("rest"))


def read_region_table(spark: SparkSession, paths, sep: str = "\t") -> DataFrame:
    """(chrom, region_start, region_end) of lines chrN, start, end; each region once, numbered chromosomes only."""
    df = _table(spark, paths, sep, ["c", "s", "e"], header=False)
    chrom = F.expr("try_cast(regexp_extract(c, 'chr([0-9]+)$', 1) as int)")
    return df.select(chrom.alias("chrom"), _number("s", "long").alias("region_start"), _number("e", "long").alias("region_end")).filter("chrom is not null").distinct()


def _lines(spark: SparkSession, paths, header: bool) -> DataFrame:
    """Lines of text, without each file's first one if that is a header."""
    reader = spark.read.schema("value string").option("sep", "\u0001").option("quote", "").option("header", header).option("enforceSchema", True)
    return reader.csv(paths).filter("value is not null and trim(value) <> ''")


def write_matrix(scores: DataFrame, row: str, path: str, samples: list[str] | None = None, value: str = "score") -> None:
    """A line for each `row` of scores (row, sample, value), a column for each sample, 0 where there is none; the header's first cell is blank."""
    samples, n = _counted(scores, samples)
    lines = matrix_lines(scores, [row], samples, [F.col(value)], "0", n)
    _write_lines(lines.select(F.concat_ws("\t", F.col(row).cast("string"), "line").alias("line")), "\t".join([" ", *samples]), path)


def write_gene_lists(listed: DataFrame, region: str, path: str) -> None:
    """Lines of a region, its number of genes and their names with commas (region, n_genes, genes)."""
    _csv(listed.orderBy(region).select(F.col(region).alias("region"), F.col("n_genes").alias("n"), "genes"), path)
