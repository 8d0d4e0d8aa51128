"""The pipeline's stages and the whole, row by row, against plain Python on odd rows."""

from collections import Counter

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from chromaspan.llm import quality, toxicity

from .conftest import SF
from .test_texts import brute_lines, brute_prints, check_packing

STAGES = dict(corpus_pipeline.STAGES)


@pytest.fixture(scope="module")
def mixed(spark, odd):
    """Odd rows, some repeated, beside whole rows of documents, with columns that clash with the operators' own."""
    some = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").orderBy("doc_id").collect()]
    texts = [t for _, t in some]
    rows = [*odd, *some, (None, texts[3]), (None, texts[3]), (None, None), *[(9, t) for t in texts[:20]], *[(8, texts[5])] * 5, (10**9, texts[0]), (10**9, None)]
    full = [(i, t, "en", f"src{k % 3}", None if t is None else len(t), k) for k, (i, t) in enumerate(rows)]
    df = spark.createDataFrame(full, "doc_id long, text string, lang string, source string, n_chars long, n long")
    names = "score kept predicted held_out carried row place fp lost row_hash hash n_lines kept_id component_id `a.b`".split()
    return df.withColumns({x.strip("`"): F.col("n").cast("string") for x in names})


def rows_of(df):
    return sorted(df.collect(), key=lambda r: r.n)


def alike(got, want):
    """The same rows, each as it was."""
    assert [tuple(r) for r in rows_of(got)] == [tuple(r) for r in want]


@pytest.mark.parametrize(("stage", "operator", "decision"), [("toxicity", toxicity, lambda r: r.predicted == 0), ("quality", quality, lambda r: r.kept)])
def test_filters(spark, mixed, stage, operator, decision):
    got = STAGES[stage](spark, mixed, SF)
    assert got.columns == mixed.columns
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    plain = mixed.select("doc_id", "text", "lang", "source", "n_chars", "n")
    verdict = {r.n: decision(r) for r in operator.score(plain, labels, keep=["n"]).collect()}
    assert len(verdict) == mixed.count() and len(set(verdict.values())) == 2
    alike(got, [r for r in rows_of(mixed) if verdict[r.n]])


def test_drop_lines(spark, mixed):
    """Every row stays one row; only the text and its length change."""
    got, rows = STAGES["line_dedup"](spark, mixed, SF), rows_of(mixed)
    assert got.columns == mixed.columns
    want = brute_lines([(r.doc_id, r.text or "") for r in rows])
    assert sum(x[3] for x in want) > 10
    for g, r, w in zip(rows_of(got), rows, want, strict=True):
        assert g.asDict() == r.asDict() | {"text": w[1], "n_chars": len(w[1])}
    assert "n_chars" not in STAGES["line_dedup"](spark, mixed.drop("n_chars"), SF).columns


def test_drop_near_duplicates(spark, mixed):
    got, rows = rows_of(STAGES["simhash_near_dedup"](spark, mixed, SF)), rows_of(mixed)
    # Groups by row number, as ids repeat.
    group = [c for _, _, c in brute_prints([(k, r.text or "") for k, r in enumerate(rows)])]
    best = {}
    for r, g in zip(rows, group, strict=True):
        best.setdefault(g, []).append(r)
    at = {r.n: g for r, g in zip(rows, group, strict=True)}
    assert Counter(at[r.n] for r in got) == Counter(best.keys())  # one of each
    for r in got:
        assert tuple(r) == tuple(rows[r.n])
        ids = [x.doc_id for x in best[at[r.n]] if x.doc_id is not None]
        assert r.doc_id == (min(ids) if ids else None)


def test_pack(spark, mixed):
    rows = mixed.dropDuplicates(["doc_id", "text"])
    check_packing(STAGES["packing"](spark, rows, SF).collect(), [(r.doc_id, r.text or "") for r in rows.collect()])


def test_copies_stay_as_many_at_most(spark):
    df = spark.createDataFrame([(1, f"a line that is long enough to count\nown {k % 3}", "en", "s", 3) for k in range(30)], "doc_id long, text string, lang string, source string, n_chars long")
    assert STAGES["line_dedup"](spark, df, SF).count() == 30
    assert STAGES["toxicity"](spark, df, SF).count() == 30
    assert STAGES["simhash_near_dedup"](spark, df, SF).count() <= 3


def test_empty(spark, mixed):
    df = mixed.limit(0)
    for name, stage in corpus_pipeline.STAGES:
        df = stage(spark, df, SF)
        assert df.collect() == [] and (name == "packing" or df.columns == mixed.columns)


def test_run(spark, mixed, tmp_path):
    docs = mixed.select("doc_id", "text", "lang", "source", "n_chars", "n")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    clean = {r.n for r in toxicity.score(docs, labels, keep=["n"]).filter("predicted = 0").collect()}
    rows = [r for r in rows_of(docs) if r.n in clean]
    good = {r.n for r in quality.score(docs.filter(F.col("n").isin([r.n for r in rows])), labels, keep=["n"]).filter("kept").collect()}
    rows = [r for r in rows if r.n in good]
    lines = [(i, t) for i, t, _, _ in brute_lines([(r.doc_id, r.text or "") for r in rows])]
    group = [c for _, _, c in brute_prints([(k, t) for k, (_, t) in enumerate(lines)])]
    kept = {}
    for (i, t), g in zip(lines, group, strict=True):
        order = (i is None, i or 0)
        if g not in kept or order < kept[g][0]:
            kept[g] = (order, i, t)
    # Of rows with the same smallest id any one may stay, so the documents' ids are compared, and tokens where ids don't tie.
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert Counter(r.doc_id for r in got if r.start == 0) == Counter(i for _, i, _ in kept.values())
    sure = [(i, t) for _, i, t in kept.values() if sum(1 for a, _ in lines if a == i) == 1]
    ids = {i for i, _ in sure}
    rest = [r for r in got if r.doc_id in ids]
    assert len(sure) > 50 and Counter(r.doc_id for r in rest if r.start == 0) == Counter(ids)
    for i, t in sure[:40]:
        from tokenizers import Tokenizer

        n = len(Tokenizer.from_file(corpus_pipeline.public_tokenizers.path("byte_bpe_50k.json")).encode(t, add_special_tokens=False).ids) + 1
        assert sum(r.length for r in rest if r.doc_id == i) == n
