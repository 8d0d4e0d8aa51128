"""Toxicity, quality and vector operators: held-out accuracy, brute force, and odd rows."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from chromaspan.llm import nndescent, quality, toxicity
from chromaspan.llm.queries import op5_toxicity, op6_embedding_near_dedup, op7_quality, op8_nearest_neighbours

from .conftest import SF

BIG = "/root/testdata/sf0.1"


def accuracy(rows, labels, column):
    want = {r.doc_id: r[column] for r in labels.collect()}
    held = [r for r in rows if r.held_out and r.doc_id in want]
    return np.mean([r.predicted == want[r.doc_id] for r in held]), len(held)


def test_toxicity_held_out(spark):
    rows = op5_toxicity(spark, BIG).collect()
    got, n = accuracy(rows, spark.read.parquet(f"{BIG}/labels.parquet"), "toxic")
    assert n > 500 and got > 0.97
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in rows)


def test_toxicity_tolerates_gaps(spark):
    docs, labels = (spark.read.parquet(f"{BIG}/{t}.parquet") for t in ("documents", "labels"))
    machines, _ = toxicity.train(docs, labels)
    asked = ["an idiiot here", "an i.d.i.o.t here", "an i d i o t here", "an id-iot here", "a mor0on here", "IDIOT"]
    z = toxicity.Margins(machines).of(asked)
    assert all(x[0] > 0.5 for x in z), z  # each holds a window on the strong side; one alone may not make a text toxic
    assert toxicity.Margins(machines).of(["an erion here and thention"])[0][0] <= 0
    few = toxicity.Margins(machines, cache_words=3)
    long = " ".join(["garden", "x" * 5000, "an.idiot" * 100, "q" * 300] + [f"w{k}ord" for k in range(300_000)])
    assert few.of([*asked, "", long]) == toxicity.Margins(machines).of([*asked, "", long]) and max(map(len, few.seen)) < 256


def test_toxicity_windows():
    m = toxicity.Margins([(np.random.default_rng(2).standard_normal(toxicity.DIMS), 0.0)] * 2)
    words = ["Word", "word,", "(Ab-cd)", "a1b2c3", "x" * 60, "I", "ab", "_abc_", "ÀÉ½xyz.", "12", "...", "-abcd-"]
    m._judge(words)
    for w in words:
        own = toxicity.windows(w)
        z = m.kernel.project(own, m.machines)[0].max() if own else -1
        assert (z > 0) == (w in m.hot) and (z <= 0 or abs(m.hot[w][0] - z) < 1e-9)


def test_toxicity_learns_a_repeated_row_once(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    many = docs.unionByName(docs.join(labels.limit(3), "doc_id").select(docs.columns).crossJoin(spark.range(400)).drop("id"))
    a, b = toxicity.train(docs, labels), toxicity.train(many, labels)
    assert all(np.allclose(x[0], y[0]) and x[1] == y[1] for x, y in zip(a[0], b[0], strict=True)) and np.allclose(a[1], b[1])


def test_kernel_is_a_kernel():
    k = toxicity.Kernel()
    words = ["idiot", "idiiot", "garden", "abc", "lowei"]
    g = k.gram(words, words)
    assert np.allclose(g, g.T) and np.linalg.eigvalsh(g).min() > -1e-9
    assert g[0, 1] > 0.3 > g[0, 2]


def test_kernel_against_enumerated_subsequences():
    from itertools import combinations

    def occurrences(word, letters=4, span=6, decay=0.5):
        s = f"^{word}"
        return [("".join(s[i] for i in c), decay ** (c[-1] - c[0] + 1 - letters)) for c in combinations(range(len(s)), letters) if c[-1] - c[0] < span]

    def kernel(a, b):
        a, b = occurrences(a), occurrences(b)
        norm = np.sqrt(sum(w * w for _, w in a) * sum(w * w for _, w in b))
        return sum(x * y for f, x in a for g, y in b if f == g) / norm if norm else 0.0

    words = ["idiot", "idiiot", "xidiotx", "garden", "abc", "banana", "bananas", "idot", "ab"]
    assert np.allclose(toxicity.Kernel().gram(words, words), [[kernel(a, b) for b in words] for a in words], atol=1e-6)


@pytest.mark.parametrize("which", ["oddities", "nothing"])
def test_toxicity_and_quality_odd_rows(spark, which, request):
    df = request.getfixturevalue(which)
    for labels in ([], [(4, 1, 0), (5, 0, 1), (None, 1, 1), (6, None, None), (4, 1, 0)], [(k, 1, 0) for k in range(1, 9)]):
        t = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
        for f in (toxicity.score, quality.score):
            rows = f(df, t, keep=["words", "n", "text"]).collect()
            assert sorted((str(r.doc_id), str(r.text), r.n) for r in rows) == sorted((str(r.doc_id), str(r.text), r.n) for r in df.collect())
            assert sorted(str(r.doc_id) for r in rows) == sorted(str(r.doc_id) for r in df.collect())
            assert all(0 <= r.score <= 1 and r.predicted in (0, 1) for r in rows)


def test_quality_held_out(spark):
    rows = op7_quality(spark, BIG).collect()
    got, n = accuracy(rows, spark.read.parquet(f"{BIG}/labels.parquet"), "quality")
    assert n > 500 and got > 0.97


def test_quality_views_are_apart():
    """The metadata view doesn't change with the text, nor the text view with the record."""
    import pyarrow as pa

    def views(text, lang, source, n):
        b = pa.record_batch([[text], [lang], [source], [n]], names=["text", "lang", "source", "n_chars"])
        text, meta = quality._features(b, quality.Grams())
        return text.x.tolist(), text.grams[0].tolist(), meta.x.tolist()

    a, b, c = views(b"some words here\nand here", "en", "src1", 9), views(b"OTHER!!", "en", "src1", 9), views(b"some words here\nand here", "de", None, None)
    assert a[2] == b[2] != c[2] and a[:2] == c[:2] and a[0] != b[0] and a[1] != b[1]
    few, words = quality.Grams(cache_words=2), [b"a", b"b", b"c" * 300, b"a", b"d"]
    assert few.of(words)[0].tolist() == quality.Grams().of(words)[0].tolist() and few.of(words)[1:] == (4, 0) and all(len(w) < 256 for w in few.known)
    assert len(few.of(words)[0]) == 8  # 4 words, 4 pairs


def test_quality_learns_a_repeated_row_once(spark):
    """1,000 copies of a labelled row and of an unlabelled one change no score."""
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    free = F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(5)) != 0
    one = docs.filter(free).join(labels, "doc_id", "left_semi").limit(1).unionByName(docs.filter(free).join(labels, "doc_id", "left_anti").limit(1))
    a = {r.doc_id: r.score for r in quality.score(docs, labels).collect()}
    b = quality.score(docs.unionByName(one.crossJoin(spark.range(1000)).drop("id")), labels).collect()
    assert len(b) == docs.count() + 2000 and all(abs(a[r.doc_id] - r.score) < 1e-6 for r in b)


def test_quality_without_a_model_keeps_all(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for labels in ([], [(k, 0, 0) for k in range(50)], [(k, 1, 0) for k in range(50)]):
        rows = quality.score(docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"), keep=["text", "lang"]).collect()
        assert len(rows) == docs.count() and all(r.kept and r.score == 1 for r in rows)
    assert {(r.doc_id, r.text, r.lang) for r in rows} == {(r.doc_id, r.text, r.lang) for r in docs.collect()}


def test_co_training_uses_the_other_view():
    """A view that can't learn from its few labels learns from the rows that the other one is sure of."""
    rng = np.random.default_rng(5)

    def rows(n, y):
        text = quality.Rows(np.zeros((n, quality.SHAPE)), [np.unique(rng.integers(0, 50, 30) + 100 * int(t)).astype(np.uint16) for t in y])
        return [text, quality.Rows(np.stack([np.where(rng.random(n) < 0.5, 3.0, 7.0 + 2 * y), np.zeros(n), rng.random(n)], 1))]

    y = np.array([0.0, 1.0] * 12)
    seed = rows(24, y)
    seed[1].x[:, 0] = 3.0  # nothing to learn for the metadata view
    pool_y = (rng.random(500) < 0.5).astype(float)
    pool, left = rows(500, pool_y), np.ones(500, bool)

    def sure(views, limit):
        out = []
        for k, v in enumerate(views):
            z = v.logit(pool[k])
            for label, s in ((1, z), (0, -z)):
                at = np.flatnonzero((s >= limit) & left)[:100]
                left[at] = False
                out.append((k, label, [p.pick(at) for p in pool]))
        return out

    views, w = quality.co_train(seed, y, sure, sure=0.9)
    ask = rows(2, np.array([0.0, 1.0]))[1]
    ask.x[:, 0] = [7.0, 9.0]
    z = views[1].margin(ask)
    assert z[0] < -0.5 and z[1] > 0.5 and len(w) == 3


def test_minimise():
    a = np.diag([1.0, 10.0, 100.0])
    assert np.allclose(quality.minimise(lambda w: (float(w @ a @ w / 2 - w.sum()), a @ w - 1), np.zeros(3)), [1, 0.1, 0.01], atol=1e-2)


def test_quality_without_metadata(spark):
    docs = spark.read.parquet(f"{BIG}/documents.parquet").select("doc_id", "text")
    got, _ = accuracy(quality.score(docs, labels := spark.read.parquet(f"{BIG}/labels.parquet")).collect(), labels, "quality")
    assert got > 0.95


def vectors(spark, rng, n=900, dims=12):
    x = rng.standard_normal((n, dims))
    x[100:400] = x[100] + 0.05 * rng.standard_normal((300, dims))  # a large group of near copies
    x[400:430] = x[7]  # exact copies
    for k in range(430, 520, 2):
        x[k + 1] = x[k] + 0.3 * rng.standard_normal(dims)
    for k in range(520, 560):  # a chain: neighbours link, ends don't
        a = (k - 520) * 0.3
        x[k] = 0
        x[k, 0], x[k, 1] = np.cos(a), np.sin(a)
    x *= rng.uniform(0.5, 2, (n, 1))
    rows = [(k, [float(y) for y in x[k]]) for k in range(n)]
    bad = [(n, None), (n + 1, []), (n + 2, [0.0] * dims), (n + 3, [float("nan")] * dims), (n + 4, [float("inf"), *[1.0] * (dims - 1)]), (n + 5, [None, *[1.0] * (dims - 1)]), (None, rows[0][1])]
    df = spark.createDataFrame(rows + bad, "vec_id long, embedding array<double>").withColumns({"id": F.lit(0), "v": F.lit("x"), "component_id": F.lit(3)})
    return x, df


def brute_links(x, least=0.9):
    u = x / np.linalg.norm(x, axis=1)[:, None]
    link = u @ u.T >= least
    np.fill_diagonal(link, False)
    comp = np.arange(len(x))
    while True:
        new = np.minimum(comp, np.where(link, comp, len(x)).min(1))
        if (new == comp).all():
            return link.sum(1), comp
        comp = new


def test_near_duplicate_vectors(spark):
    x, df = vectors(spark, np.random.default_rng(6))
    n, comp = brute_links(x)
    got = {r.vec_id: r for r in nndescent.near_duplicates(df).collect()}
    assert len(got) == df.count()
    for k in range(len(x)):
        assert (got[k].n_links, got[k].component_id, got[k].kept) == (n[k], comp[k], comp[k] == k), k
    for k in range(len(x), len(x) + 6):
        assert (got[k].n_links, got[k].component_id, got[k].kept) == (0, k, True)
    assert got[None].n_links == 0
    assert nndescent.near_duplicates(df.limit(0)).collect() == []
    again = nndescent.near_duplicates(df.unionByName(df)).collect()
    assert len(again) == 2 * df.count() and all((r.n_links, r.component_id) == (got[r.vec_id].n_links, got[r.vec_id].component_id) for r in again)


def test_near_duplicates_of_touching_groups(spark):
    """Groups larger than a list, linked by one pair at their edges: the nearer members fill both ends' lists."""
    rng, rows = np.random.default_rng(8), []
    for _ in range(20):
        q = np.linalg.qr(rng.standard_normal((24, 24)))[0]
        at = lambda degrees: np.cos(np.radians(degrees)) * q[0] + np.sin(np.radians(degrees)) * q[1]  # noqa: E731, B023
        for middle, edge in ((0, 12), (48, 36), (96, 84)):
            rows += [*(at(middle) + 0.01 * rng.standard_normal((40, 24))), at(edge)]
        rows.append(at(60))
    x = np.array(rows)
    n, comp = brute_links(x)
    df = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "vec_id long, embedding array<double>")
    got = {r.vec_id: r for r in nndescent.near_duplicates(df).collect()}
    assert [(got[k].n_links, got[k].component_id, got[k].kept) for k in range(len(x))] == [(n[k], comp[k], comp[k] == k) for k in range(len(x))]


def test_near_duplicate_query(spark):
    rows = spark.read.parquet(f"{SF}/embeddings.parquet").orderBy("vec_id").collect()
    ids, x = np.array([r.vec_id for r in rows]), np.array([r.embedding for r in rows], float)
    n, comp = brute_links(x)
    got = sorted(op6_embedding_near_dedup(spark, SF).collect(), key=lambda r: r.vec_id)
    assert [(r.vec_id, r.n_links, r.component_id) for r in got] == [(i, a, ids[b]) for i, a, b in zip(ids, n, comp, strict=True)]


def recall(got, ids, x, every, k=20):
    by = {}
    for r in got:
        by.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    hits = total = 0
    for q in np.flatnonzero(ids % every == 0):
        s = x @ x[q]
        order = [j for j in np.lexsort((ids, -s)) if j != q][:k]
        mine = sorted(by[ids[q]])
        assert [m[0] for m in mine] == list(range(1, min(k, len(ids) - 1) + 1))
        assert all(abs(m[2] - s[np.flatnonzero(ids == m[1])[0]]) < 1e-9 for m in mine)
        assert [m[1:] for m in mine] == sorted((m[1:] for m in mine), key=lambda m: (-m[1], m[0]))
        hits += len({m[1] for m in mine} & set(ids[order]))
        total += len(order)
    assert len(by) == (ids % every == 0).sum()
    return hits / total


def test_search_query(spark):
    rows = spark.read.parquet(f"{BIG}/embeddings.parquet").orderBy("vec_id").collect()
    got = op8_nearest_neighbours(spark, BIG).collect()
    assert recall(got, np.array([r.vec_id for r in rows]), np.array([r.embedding for r in rows], float), 20) > 0.9


def test_search_odd_rows(spark):
    x, df = vectors(spark, np.random.default_rng(9))
    got = nndescent.search(df, lambda i: i % 10 == 0).collect()
    assert recall(got, np.arange(len(x)), x, 10) > 0.9
    few = df.filter("vec_id < 8")
    assert recall(nndescent.search(few, lambda i: i % 2 == 0).collect(), np.arange(8), x[:8], 2) == 1
    assert nndescent.search(df.limit(0), lambda i: i % 2 == 0).collect() == []
    assert len(nndescent.search(few.unionByName(few), lambda i: i % 2 == 0).collect()) == 28


def test_hot_keys_are_split_and_met(spark):
    rows = spark.createDataFrame([(1 if k < 500 else k, k) for k in range(700)], "node long, id long")
    got = nndescent.split_hot(rows, rows, "node", 100).groupBy("node", "part").count().collect()
    assert max(r["count"] for r in got) < 200 and len([r for r in got if r.node == 1]) == 5 and sum(r["count"] for r in got) == 700
    right = rows.groupBy("node").count().withColumn("x", F.col("node") * 2)
    for hot in (1, 100, 10_000):
        assert sorted(map(tuple, nndescent.join_hot(rows, right, "node", "count", hot).select("node", "id", "x").collect())) == sorted((r.node, r.id, 2 * r.node) for r in rows.collect())


def test_search_among_equal_vectors(spark):
    """A query in a group of equal vectors gets the smallest ids of the group."""
    rng = np.random.default_rng(4)
    x = rng.standard_normal((4500, 12))
    group = np.sort(rng.permutation(4500)[:3000])
    x[group] = np.round(x[group[0]] * 4) + 8
    df = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "vec_id long, embedding array<double>")
    got = {}
    for r in nndescent.search(df, lambda i: i % 50 == 0, rounds=1, trees=2).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id))
    asked = [q for q in group if q % 50 == 0]
    assert len(got) == 90 and len(asked) > 40
    for q in asked:
        assert [i for _, i in sorted(got[q])] == [i for i in group if i != q][:20]


def test_audit_sees_lost_links(spark):
    """Pairs far from everything else, and settings that lose most of them: the audit doesn't ask the graph whom to look at,
    so other graphs follow until all links are there."""
    r = np.random.default_rng(1)
    x = r.standard_normal((1500, 64))
    x /= np.linalg.norm(x, axis=1)[:, None]
    for i in range(0, 240, 2):
        y = r.standard_normal(64)
        y -= (y @ x[i]) * x[i]
        c = r.uniform(0.901, 0.95)
        x[i + 1] = c * x[i] + np.sqrt(1 - c * c) * y / np.linalg.norm(y)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>").repartition(4)
    x /= np.linalg.norm(x, axis=1)[:, None]
    want = ((x @ x.T >= 0.9).sum(1) - 1).tolist()
    got = {q.vec_id: q.n_links for q in nndescent.near_duplicates(df, degree=2, rounds=0, trees=1).collect()}
    assert [got[i] for i in range(1500)] == want and sum(want) == 240


def test_trees_follow_the_depth():
    """By simulation at depth 7: all but about a hundredth of pairs at the threshold share a leaf; deeper trees are more."""
    n = [nndescent.trees_for(n, 0.9) for n in (100, 20_000, 10**6, 10**8)]
    assert n[0] == 8 and n == sorted(n) and n[1] == 12 and 80 < n[3] < 90
    r = np.random.default_rng(2)
    x = r.standard_normal((500, 64))
    x /= np.linalg.norm(x, axis=1)[:, None]
    y = r.standard_normal((500, 64))
    y -= (y * x).sum(1)[:, None] * x
    y = 0.9 * x + np.sqrt(0.19) * y / np.linalg.norm(y, axis=1)[:, None]
    met = np.zeros(500, bool)
    for _ in range(n[1]):
        p = r.standard_normal((64, 7))
        met |= ((x @ p > 0) == (y @ p > 0)).all(1)
    assert 0.96 < met.mean() < 1


def test_quality_views_lay_out_a_part_of_their_design_at_a_time():
    import tracemalloc

    r = np.random.default_rng(0)
    grams = [r.integers(0, 2 * quality.GRAMS, n).astype(np.uint16) for n in (0, 1, 300_000, *[5_000] * 300)]
    x, y = r.normal(size=(len(grams), quality.SHAPE)), np.arange(len(grams)) % 2.0
    rows, v = quality.Rows(x, grams), quality.View(0, quality.SHAPE)
    v.cuts(rows)
    tracemalloc.start()
    v.fit(rows, y)
    got = v.margin(rows)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 30_000_000  # the whole design has some 45 MB, and as much again in each step
    who, what, value = v.design(rows)
    assert np.array_equal(got, np.bincount(who, v.w[what] * value, len(x)))
