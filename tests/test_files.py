"""Files in byte ranges, wide matrices and the commands' names, against plain readings."""

import random

import pytest
from pyspark.sql import functions as F

from chromaspan import commands
from chromaspan.sources import files

RAW = "sample string, marker string, chrom int, pos long, value double"
SEG = "sample string, chrom int, seg_start long, seg_end long, n_markers long, state double"


def test_split_files_are_read_in_byte_ranges(spark, tmp_path):
    """The same values as by reading each file line by line, in ranges of some hundred bytes; blank lines don't count."""
    r, want, n = random.Random(1), {}, 700
    for name in ("a b+c", "ü", "short"):
        values = [r.choice(["0.5", "-1.25", "x", "3e2"]) for _ in range(n if name != "short" else 3)]
        lines = ["id\tvalue", *(f"{k}\t{v}" for k, v in enumerate(values))]
        for _ in range(40):
            lines.insert(r.randrange(1, len(lines)), "")
        (tmp_path / f"{name}.txt").write_text("\n".join(lines) + ("\n" if name == "short" else ""))
        want[name] = [None if v == "x" else float(v) for v in values]
    markers = spark.createDataFrame([(k, f"m{k}", 1, k * 10) for k in range(n)], "ordinal long, marker string, chrom int, pos long")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "300")
        paths = [str(tmp_path / f"{name}.txt") for name in want]
        assert spark.read.text(paths).rdd.getNumPartitions() > 20
        got = {}
        for x in files.read_split_raw(spark, paths, markers, 1).collect():
            got.setdefault(x.sample, {})[x.pos] = x.value
        assert {k: [v[p] for p in sorted(v)] for k, v in got.items()} == want
        with pytest.raises(ValueError, match="more values"):
            files.read_split_raw(spark, paths, markers.limit(n - 1), 1)
        assert files.read_split_raw(spark, paths[2:], markers, 1).count() == 3
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_matrices_of_many_samples(spark, tmp_path):
    """Few cells, a column for each of thousands of samples: blanks before, between and behind them."""
    names = [f"s{k:05d}" for k in range(20_000)]
    cells = [(names[k], f"m{m}", 1, m, k + m / 10) for m, ks in ((1, (0, 3, 4, 19_999)), (2, (7,)), (3, (19_998,)), (4, (0,))) for k in ks]
    raw = spark.createDataFrame([*cells, (None, "m1", 1, 1, 5.0), ("s00007", "m2", 1, 2, 0.1)], RAW)
    path = str(tmp_path / "wide.cn")
    files.write_raw(raw, path, names)
    lines = [x.value.split("\t") for x in spark.read.text(path).collect()]
    header = next(x for x in lines if x[0] == "marker")
    assert header[3:] == names
    got = {(names[k - 3], x[0]): float(v) for x in lines if x[0] != "marker" for k, v in enumerate(x) if k > 2 and v}
    assert got == {(s, m): v for s, m, _, _, v in cells} | {("s00007", "m2"): 0.1} and all(len(x) == len(names) + 3 for x in lines)


def test_matrices_find_their_samples(spark, tmp_path):
    rows = [("B", "m2", 2, 5, 1.5), ("A", "m1", 1, 3, None), ("C d", "m1", 1, 3, -2.0), ("A", "m2", 2, 5, 0.25)]
    path = str(tmp_path / "x.cn")
    files.write_raw(spark.createDataFrame(rows, RAW).coalesce(1), path)
    got = files.read_raw(spark, path).collect()
    assert {(x.sample, x.marker): x.value for x in got} == {(s, m): {(a, b): v for a, b, _, _, v in rows}.get((s, m)) for s in ("A", "B", "C d") for m in ("m1", "m2")}
    pairs = spark.createDataFrame(rows, RAW).withColumn("value", F.struct(F.col("value").alias("a"), (F.col("value") + 1).alias("b")))
    files.write_raw(pairs, str(tmp_path / "x.cnas"))
    back = {(x.sample, x.marker): x.value for x in files.read_raw(spark, str(tmp_path / "x.cnas"), alleles=True).collect()}
    assert tuple(back["B", "m2"]) == (1.5, 2.5) and tuple(back["A", "m1"]) == (None, None) and tuple(back["B", "m1"]) == (None, None)
    scores = spark.createDataFrame([("g2", "B", 3), ("g1", "A", -1)], "gene string, sample string, score int")
    files.write_matrix(scores, "gene", str(tmp_path / "m"))
    assert sorted(x.value for x in spark.read.text(str(tmp_path / "m")).distinct().collect()) == sorted([" \tA\tB", "g1\t-1\t0", "g2\t0\t3"])
    with pytest.raises(ValueError, match="more than 1"):
        files.sample_names(scores, 1)


def test_commands_name_their_outputs(spark, tmp_path):
    assert [commands.default_output(c, f) for c, f in (("filter", "d.x/a.b.seg"), ("sort", "d.x/markers"), ("segment", "a.cn"), ("clean", "a.seg/"))] == ["d.x/a.b.filtered.seg", "d.x/markers.sorted", "a.seg", "a.cleaned.seg"]
    rows = [("A", "m1", 1, 3, 0.5), ("A", "m2", 1, 5, 0.5), ("A", "m3", 1, 9, 2.0)]
    path = str(tmp_path / "x.cn")
    files.write_raw(spark.createDataFrame(rows, RAW), path)
    commands.run(spark, ["convert", path, "--to", "seg"])
    assert sorted((x.seg_start, x.seg_end, x.n_markers, x.state) for x in files.read_segments(spark, str(tmp_path / "x.seg")).collect()) == [(3, 5, 2, 0.5), (9, 9, 1, 2.0)]
    files.write_markers(spark.createDataFrame(rows, RAW).select("marker", "chrom", "pos"), str(tmp_path / "markers.txt"))
    commands.run(spark, ["convert", str(tmp_path / "x.seg"), str(tmp_path / "y.cn"), "--markers", str(tmp_path / "markers.txt")])
    assert {(x.marker, x.value) for x in files.read_raw(spark, str(tmp_path / "y.cn")).collect()} == {(m, v) for _, m, _, _, v in rows}
    with pytest.raises(ValueError, match="only at given markers"):
        commands.run(spark, ["convert", str(tmp_path / "x.seg"), "--to", "cn"])
    with pytest.raises(SystemExit):
        commands.run(spark, ["convert", path])


def test_raw_values_are_filtered_by_markers(spark, tmp_path):
    rows = [("A", "m1", 1, 3, 0.5), ("A", "m2", 1, 5, 0.5), ("B", "m3", 1, 9, 2.0)]
    files.write_raw(spark.createDataFrame(rows, RAW), str(tmp_path / "x.cn"))
    files.write_raw(spark.createDataFrame([("N", "m2", 1, 5, 0.0)], RAW), str(tmp_path / "n.txt"))
    commands.run(spark, ["filter", str(tmp_path / "x.cn"), "--reference", str(tmp_path / "n.txt")])
    got = files.read_raw(spark, str(tmp_path / "x.filtered.cn")).filter("value is not null").collect()
    assert {(x.sample, x.marker) for x in got} == {("A", "m1"), ("B", "m3")}
    with pytest.raises(ValueError, match="needs --reference"):
        commands.run(spark, ["filter", str(tmp_path / "x.cn")])


def test_matrix_cells_are_dealt_once_to_tasks_that_follow_their_number(spark, monkeypatch):
    monkeypatch.setattr(files, "CELLS", 10)
    cells = spark.createDataFrame([(s, f"m{k:02}", v) for k in range(40) for s in "AC" for v in (2.5, 1.5)] + [("B", "m07", 9.0)], "sample string, marker string, value double")
    lines = files.matrix_lines(cells, ["marker"], ["A", "B", "C"], [F.col("value")])
    assert lines.rdd.getNumPartitions() >= 16
    got = [(x.marker, x.line) for x in lines.collect()]
    assert got == [(f"m{k:02}", "1.5\t9.0\t1.5" if k == 7 else "1.5\t\t1.5") for k in range(40)]
    plan = lines._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    assert "hashpartitioning" not in plan
    assert plan.count("Exchange rangepartitioning") == 1
