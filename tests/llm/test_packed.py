"""Runs of words, vector codes and token files against brute force, SQL and exact round trips."""

import heapq
import math
import random
import zlib

import duckdb
import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from chromaspan.llm import runs, token_files, vector_codes
from chromaspan.llm.common import scratch
from chromaspan.llm.queries import ORACLE_SQL, QUERIES

from .conftest import SF, rows_of
from .test_texts import same, texts

WORD = public_tokenizers.path("word_bpe_49k.json")


def by_sql(name, **tables):
    con = duckdb.connect()
    for table, path in tables.items():
        con.sql(f"CREATE VIEW {table} AS SELECT * FROM '{path}'")
    rel = con.sql(ORACLE_SQL[name])
    return rel.columns, rel.fetchall()


def same_as_sql(spark, name, sf_dir, **tables):
    got = QUERIES[name](spark, sf_dir)
    columns, want = by_sql(name, **tables)
    same(got.select(*columns).collect(), want)
    return want


def plain_runs(w, least=6, times=4):
    """Stretches of equal words q apart for every q; of those with equal ends the shortest q counts."""
    found = {}
    for q in range(1, len(w) // times + 1):
        i = 0
        while i < len(w) - q:
            start = i
            while i < len(w) - q and w[i] == w[i + q]:
                i += 1
            if i - start + q >= max(least, times * q):
                found.setdefault((start, i - start + q), q)
            i += 1
    return sorted(((s, n, q) for (s, n), q in found.items()), key=lambda r: (r[0], r[2]))


def test_runs_equal_brute_force():
    r = random.Random(5)
    for _ in range(1500):
        k, n = r.choice([1, 2, 3, 5]), r.randrange(0, 60)
        w = [r.randrange(k) for _ in range(n)]
        if n > 4 and r.random() < 0.6:
            a, p = r.randrange(n - 1), 1 + r.randrange(6)
            w = w[:a] + [w[min(a + i % p, n - 1)] for i in range(n - a)] + [r.randrange(k) for _ in range(r.randrange(5))]
        for least, times in ((6, 4), (2, 2), (4, 3)):
            assert runs.runs_of(w, least, times) == plain_runs(w, least, times), w
        assert runs.word_runs([b"%d" % x for x in w]) == plain_runs(w), w
        after, common = runs.lyndon_edges(w)
        for i, j in enumerate(after):
            assert j == next((j for j in range(i + 1, len(w)) if w[j:] < w[i:]), len(w))
            assert j == len(w) or w[i : i + common[i]] == w[j : j + common[i]] and (j + common[i] == len(w) or w[i + common[i]] != w[j + common[i]])


def test_run_comparisons_stay_linear():
    r, n = random.Random(1), 20_000
    fib, other = [0], [0, 1]
    while len(other) < n:
        fib, other = other, other + fib
    words = {
        "random": [r.randrange(2) for _ in range(n)], "many letters": [r.randrange(50) for _ in range(n)], "equal": [1] * n, "fibonacci": other[:n], "thue-morse": [bin(i).count("1") & 1 for i in range(n)],
        "periodic": [r.randrange(3) for _ in range(1000)] * 20, "blocks": ([0] * 140 + [1]) * 140, "ruler": [(i & -i).bit_length() for i in range(1, n)],
    }
    for name, w in words.items():
        for order in (w, [-x for x in w]):
            seen = [0]
            runs.lyndon_edges(order, seen)
            assert seen[0] < 2.5 * len(order), (name, seen)


def test_collapse_and_choice(spark):
    text = "x y " + "a b " * 5 + "c " * 7 + "z"
    got = {r.doc_id: r for r in runs.collapse(rows_of(spark, [(1, text), (2, None), (3, "q w e")])).collect()}
    assert got[1].text == "x y a b c z" and [tuple(r) for r in got[1].runs] == [(2, 10, 2), (12, 7, 1)]
    assert (got[2].text, got[2].runs, got[3].text) == ("", [], "q w e")
    assert runs.most_periodic([(9, 8, 2), (3, 4, 1), (3, 8, 2), (0, 7, 2)]) == (3, 4, 1) and runs.most_periodic([]) is None


def test_runs_query(spark):
    want = same_as_sql(spark, "op11_periodic_runs", SF, documents=f"{SF}/documents.parquet")
    assert sum(r[1] > 0 for r in want) > 50


@pytest.mark.parametrize("which", ["oddities", "nothing"])
def test_runs_on_odd_rows(spark, which, request, tmp_path):
    docs = request.getfixturevalue(which)
    r = random.Random(8)
    extra = [(20 + k, " ".join(r.choice("ab") for _ in range(300))) for k in range(300)] + [(None, "a " * 9), (7, "b " * 9), (400, "t " * 100_000)]
    docs = docs.unionByName(rows_of(spark, extra)) if which == "oddities" else docs
    docs.select("doc_id", "text", "lang", F.lit(1).alias("start")).coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    if which == "nothing":
        assert QUERIES["op11_periodic_runs"](spark, str(tmp_path)).collect() == []
        return
    got = QUERIES["op11_periodic_runs"](spark, str(tmp_path)).filter("doc_id is null or doc_id <> 400")  # SQL pairs its words
    columns, want = by_sql("op11_periodic_runs", documents=f"{tmp_path}/documents.parquet/*.parquet' WHERE doc_id IS DISTINCT FROM 400 AND '1' = '1")
    same(got.select(*columns).collect(), want)
    (one,) = QUERIES["op11_periodic_runs"](spark, str(tmp_path)).filter("doc_id = 400").collect()
    assert (one.n_runs, one.start, one.length, one.period, one.exponent_milli) == (1, 0, 100_000, 1, 100_000_000)


def test_near_duplicates_query(spark, tmp_path):
    """The test tables' vectors have no links at sf0.01; so planted ones: near and exact copies, a chain, odd rows."""
    r = np.random.default_rng(6)
    v = r.normal(size=(60, 16))
    rows = [(i, x.tolist()) for i, x in enumerate(v)]
    rows += [(100 + k, (v[k % 9] + r.normal(size=16) * 0.15).tolist()) for k in range(50)] + [(200 + k, v[2].tolist()) for k in range(5)]
    for k in range(12):  # each links with its neighbours only
        a = 0.4 * k
        rows.append((300 + k, [math.cos(a), math.sin(a)] + [0.0] * 14))
    rows += [(400, None), (401, [0.0] * 16), (402, [float("nan")] * 16), (403, [1.0] * 15 + [None]), (5, v[5].tolist())]
    spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("label", F.lit(1)).coalesce(1).write.parquet(f"{tmp_path}/embeddings.parquet")
    want = same_as_sql(spark, "op6_embedding_near_dedup", str(tmp_path), embeddings=f"{tmp_path}/embeddings.parquet/*.parquet")
    assert sum(x[1] > 0 for x in want) > 60 and {x[2] for x in want if 300 <= x[0] < 312} == {300}


def test_vector_codes_query(spark):
    same_as_sql(spark, "op12_vector_codes", SF, embeddings=f"{SF}/embeddings.parquet")


def test_vector_codes_on_odd_rows(spark, tmp_path):
    r = np.random.default_rng(4)
    v = [(i, [float(x) for x in r.choice([-1.5, -0.25, 0, 0.004, 0.5, 3], 32)], int(i) % 3 or None) for i in range(300)]
    v += [(7, v[7][1], 1), (7, v[8][1], 1), (None, v[9][1], 2), (301, None, 1), (302, [0.5] * 31 + [None], 1), (303, [0.5] * 31 + [float("nan")], 1), (304, [float("inf")] * 32, None), (-5, [0.0] * 32, None)]
    df = spark.createDataFrame(v, "vec_id long, embedding array<double>, label int").withColumns({"code": F.lit("x"), "v": F.lit(1), "of": F.lit(2)})
    df.coalesce(1).write.parquet(f"{tmp_path}/embeddings.parquet")
    want = same_as_sql(spark, "op12_vector_codes", str(tmp_path), embeddings=f"{tmp_path}/embeddings.parquet/*.parquet")
    assert len(want) == 304
    few = vector_codes.compress(df.filter("vec_id between 10 and 12")).collect()
    assert {(x.code, x.error) for x in few} == {(f"{k:02x}" * 16, 0) for k in range(3)} or all(x.error == 0 for x in few)
    assert vector_codes.compress(df.filter("vec_id > 300")).collect() == [] and vector_codes.compress(df.limit(0)).collect() == []
    odd = df.select("vec_id", F.when(F.col("vec_id") == 3, F.array(F.lit(1.0))).otherwise(F.col("embedding")).alias("embedding"), "label")
    assert vector_codes.compress(odd).count() == 303
    with pytest.raises(Exception, match="equal parts"):
        vector_codes.compress(df, parts=5)
    with pytest.raises(Exception, match="beyond"):
        vector_codes.compress(df.filter("vec_id < 9").withColumn("embedding", F.transform("embedding", lambda x: x * 1e12))).collect()


def test_bounds_change_no_code():
    """The bounds' assignment against a full one, with many ties, over several rounds; and they save most scans once little moves."""
    r = np.random.default_rng(11)
    for spread, rounds in ((3, 4), (400, 6)):
        values = r.integers(-spread, spread, (3000, 16))
        books = values[:20].reshape(20, 4, 4).transpose(1, 0, 2).copy()
        earlier, known, scans = None, (None, None, None), []
        for _ in range(rounds):
            code, upper, lower, n = vector_codes.Assignment(books, earlier).assign(values, *known)
            scans.append(n.mean() / 4)
            for p in range(4):
                x = values.reshape(-1, 4, 4)[:, p]
                assert (code[:, p] == ((x[:, None] - books[p][None]) ** 2).sum(axis=2).argmin(axis=1)).all()
            known, earlier, books = (code, upper.astype(float), lower.astype(float)), books, books.copy()
            for p in range(4):
                for e in range(20):
                    if (code[:, p] == e).any():
                        own = values.reshape(-1, 4, 4)[code[:, p] == e, p]
                        books[p, e] = own.sum(axis=0) // len(own)
        assert scans[0] == 1 > scans[1] > scans[-1], scans


def huffman_bits(counts):
    heap, total = [int(c) for c in counts if c], 0
    heapq.heapify(heap)
    while len(heap) > 1:
        both = heapq.heappop(heap) + heapq.heappop(heap)
        total += both
        heapq.heappush(heap, both)
    return total


def least_bits(counts, limit):
    """The fewest bits of any code with lengths up to limit: all monotone choices of lengths that a prefix code can have."""
    counts = sorted((c for c in counts if c), reverse=True)

    def best(k, room, low):
        if k == len(counts):
            return 0
        return min((counts[k] * n + best(k + 1, room - 2.0**-n, n) for n in range(low, limit + 1) if 2.0**-n <= room), default=float("inf"))

    return best(0, 1.0, 1)


def test_code_lengths():
    r = np.random.default_rng(2)
    for n in (2, 3, 7, 60, 2000):
        counts = (r.pareto(0.7, n) * 10).astype(np.int64)
        counts[:2] += 1
        bits = token_files.code_lengths(counts, 24).astype(int)
        assert (bits * counts).sum() == huffman_bits(counts) and sum(2.0**-b for b in bits if b) == 1 and ((bits > 0) == (counts > 0)).all()
        tight = token_files.code_lengths(counts, 11).astype(int)
        assert tight.max() <= 11 and sum(2.0**-b for b in tight if b) <= 1
    for _ in range(60):
        counts = (r.pareto(0.4, r.integers(2, 8)) * 3).astype(np.int64) + 1
        for limit in (3, 4, 5):
            assert (token_files.code_lengths(counts, limit).astype(int) * counts).sum() == least_bits(counts.tolist(), limit)
    assert token_files.code_lengths(np.array([0, 5]), 4).tolist() == [0, 1] and token_files.code_lengths(np.zeros(0, np.int64), 4).tolist() == []
    with pytest.raises(ValueError, match="no code"):
        token_files.code_lengths(np.ones(9, np.int64), 3)


def test_codec_round_trip():
    r = np.random.default_rng(3)
    counts = (r.pareto(0.8, 49_408) * 5).astype(np.int64)
    codes = token_files.Codes(token_files.code_lengths(counts, 20).tobytes())
    ids = r.choice(49_408, size=70_000, p=counts / counts.sum()).astype("<u4")
    for n in (0, 1, 255, 256, 257, 70_000):
        payload, checkpoints = codes.encode(ids[:n])
        assert (codes.decode(payload, checkpoints, n) == ids[:n]).all() and len(checkpoints) == -(-n // 256)
        assert len(payload) == -(-int(codes.lengths[ids[:n]].astype(int).sum()) // 8)
    part, _ = codes.encode(ids[:1000])
    assert (codes.decode(part, checkpoints[1:2], 100) == ids[256:356]).all()  # a stretch by itself
    with pytest.raises(ValueError, match="no code"):
        codes.encode(np.flatnonzero(counts == 0)[:1])


def plain_tokens(docs):
    t = Tokenizer.from_file(WORD)
    rows, start = [], 0
    own = [(i, [*t.encode(x, add_special_tokens=False).ids, 1]) for i, x in texts(docs)]
    for i, ids in sorted(own, key=lambda x: (x[0] is not None, x[0] or 0)):
        rows.append((i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    return rows


def test_token_files_query(spark, docs):
    same(QUERIES["op13_token_files"](spark, SF).collect(), plain_tokens(docs))


def test_token_files_on_odd_rows(spark, oddities, nothing):
    for k, settings in enumerate(({}, {"block_ids": 7, "part_ids": 300})):
        path = scratch(spark, f"odd{k}")
        token_files.write(oddities, WORD, path, **settings)
        got = token_files.read(spark, path).collect()
        want = plain_tokens(oddities)
        same([(r.doc_id, r.n_tokens, zlib.crc32(np.array(r.ids, "<u4").tobytes())) for r in got], [(i, n, c) for i, _, n, c in want])
        same([(r.doc_id, r.start) for r in got], [(i, s) for i, s, _, _ in want])
    path = scratch(spark, "nothing")
    token_files.write(nothing, WORD, path)
    assert token_files.read(spark, path).collect() == []


def test_token_files_order_of_a_repeated_id(spark):
    """Rows of one doc_id come in an order of their own ids, whatever tasks hold them."""
    rows = [(5, f"text {k % 40}") for k in range(400)] + [(k, "x") for k in range(10)]
    got = [sorted(map(tuple, token_files.round_trip(rows_of(spark, rows).repartition(n, F.rand()), WORD).collect())) for n in (1, 7)]
    assert got[0] == got[1] and len(got[0]) == 410


def test_damaged_block_raises(spark, oddities):
    path = scratch(spark, "damaged")
    token_files.write(oddities, WORD, path)
    blocks = spark.read.parquet(f"{path}/blocks").withColumn("crc", F.col("crc") + 1).collect()
    spark.createDataFrame(blocks, token_files.BLOCKS).write.mode("overwrite").parquet(f"{path}-2/blocks")
    for t in ("parts", "codes"):
        spark.read.parquet(f"{path}/{t}").write.parquet(f"{path}-2/{t}")
    with pytest.raises(Exception, match="damaged"):
        token_files.read(spark, f"{path}-2").count()


def test_words_are_put_together():
    texts = [" ".join(f"word{k} shared" for k in range(i, i + 30)).encode() for i in range(0, 300, 10)]
    odd = "It's HE'LL x'sy ''s '' don't $$$'re,a1b22 É Éa ÄÖÜß naïve×÷ œuvre İstanbul ΣΑΣ e\u0301 <|endoftext|>x y<|startoftext|> 汉字abc \x1ca a\x1cb \x7f \u00a0a ½ ª º Ⅷ " + "x" * 400 + " " + "$a" * 300
    texts += [odd.encode(), *(w.encode() for w in odd.split(" ")), b"\xff\xfe a"]
    r = random.Random(6)
    texts += ["".join(r.choice("aZ'sdm1 é$-ÿ.Ø<|") for _ in range(200)).encode() for _ in range(200)]
    a, b, t = token_files.Words(WORD), token_files.Words(WORD, cache_words=20), Tokenizer.from_file(WORD)
    want = [np.array(t.encode(x.decode("utf-8", "replace"), add_special_tokens=False).ids, "<u2").tobytes() for x in texts]

    def ids(words, texts):
        flat, n = words.ids(pa.array(texts, pa.binary()).cast(pa.string(), safe=False) if not any(b"\xff" in x for x in texts) else pa.Array.from_buffers(pa.string(), len(texts), pa.array(texts, pa.binary()).buffers()))
        return [x.astype("<u2").tobytes() for x in np.split(flat, np.cumsum(n)[:-1])]

    assert ids(a, texts) == want and [x for t in texts for x in ids(b, [t])] == want == ids(a, texts)
    assert len(b.known) < 300 and not any(len(w) >= 256 for w in [*a.known, *a.pieces])
    with pytest.raises(ValueError, match="white space"):
        token_files.Words(public_tokenizers.path("byte_bpe_50k.json"))


def test_cuts_look_up_powers_of_two_only_where_there_are_points(monkeypatch):
    """Cuts are those of looking at every point before each, and documents without long stretches get no extra points."""
    import random

    import numpy as np

    from chromaspan.llm import packing

    r = random.Random(4)
    for reach in (3, 20, 60):
        at = np.cumsum([r.randrange(1, reach) for _ in range(60)]).tolist()
        cost = [r.choice([0.0, 4.0, 24.0]) for _ in at]
        points, best = [0, *at], [0.0]
        for j in range(1, len(points)):
            long = {i: points[j] - points[i] for i in range(j) if points[j] - points[i] <= 64}
            best.append(cost[j - 1] + 7.0 + min(best[i] + (0 if n & (n - 1) == 0 else 64 - n) for i, n in long.items()))
        ends = packing.best_cuts(at, cost, 64, 7.0)
        spent = sum(cost[at.index(b)] + 7.0 + (0 if (b - a) & (b - a - 1) == 0 else 64 - b + a) for a, b in zip([0, *ends], ends, strict=False))
        assert spent == best[-1]
    closes = np.array([False, True])
    monkeypatch.setattr(np, "argsort", None)
    p, c = packing.cut_points(np.array([0, 1, 0, 0, 1, 0]), closes, 4.0, 24.0, 64)
    assert p.tolist() == [2, 5, 6] and c.tolist() == [4.0, 4.0, 0.0]
