"""Token counts, BPE, packing, line and SimHash deduplication against brute force."""

import hashlib
import struct
import zlib
from collections import defaultdict

import duckdb
import public_tokenizers
import pytest
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from chromaspan.llm import bpe, line_dedup, lm_score, packing, simhash, token_count
from chromaspan.llm.common import connected_components
from chromaspan.llm.queries import ORACLE_SQL, op3_line_dedup, op4_bpe, op9_packing, op10_simhash_near_dedup

from .conftest import SF

WORD, BYTE = public_tokenizers.path("word_bpe_49k.json"), public_tokenizers.path("byte_bpe_50k.json")


def texts(df):
    return [(r.doc_id, r.text or "") for r in df.select("doc_id", "text").collect()]


def key(x):
    return tuple((v is not None, v) for v in x)


def same(a, b):
    assert sorted(map(tuple, a), key=key) == sorted(map(tuple, b), key=key)


@pytest.mark.parametrize("which", ["docs", "oddities", "nothing"])
def test_token_counts(which, request):
    df = request.getfixturevalue(which)
    t = Tokenizer.from_file(WORD)
    want = [(i, len(x.encode()), n := len(t.encode(x, add_special_tokens=False).ids), n > 2048) for i, x in texts(df)]
    same(token_count.count_tokens(df, WORD).collect(), want)
    same(token_count.count_tokens(df, WORD, frequent=5, cache_words=10).collect(), want)


def test_frequent_words(docs, nothing):
    from collections import Counter

    seen = Counter(w for _, x in texts(docs) for w in x.encode().split())
    least = seen.most_common(200)[-1][1]
    got = token_count.frequent_words(docs.repartition(5), 200)
    assert len(got) == 200 and {w for w, n in seen.items() if n > 2 * least} <= set(got)
    assert token_count.frequent_words(docs, 10**6, groups=(2,)) and set(token_count.frequent_words(docs, 10**6)) == set(seen)
    assert token_count.frequent_words(nothing, 10) == []


@pytest.mark.parametrize("which", ["docs", "oddities", "nothing"])
def test_bpe(which, request):
    df = request.getfixturevalue(which)
    t = Tokenizer.from_file(BYTE)
    want = []
    for i, x in texts(df):
        ids = t.encode(x, add_special_tokens=False).ids
        want.append((i, ids, t.decode(ids, skip_special_tokens=False)))
    same([(r.doc_id, r.ids, r.decoded) for r in bpe.encode(df, BYTE).collect()], want)


def test_bpe_query(spark):
    t = Tokenizer.from_file(BYTE)
    want = []
    for i, x in texts(spark.read.parquet(f"{SF}/documents.parquet")):
        ids = t.encode(x, add_special_tokens=False).ids
        want.append((i, len(ids), hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest(), hashlib.sha256(x.encode()).hexdigest()))
    same(op4_bpe(spark, SF).collect(), want)


def check_packing(rows, source, window=2048):
    t = Tokenizer.from_file(BYTE)
    pieces, sequences = defaultdict(list), defaultdict(list)
    for r in rows:
        pieces[r.doc_id, r.doc_tokens].append(r)
        sequences[r.sequence_id].append(r)
    for i, x in source:
        ids = [*t.encode(x, add_special_tokens=False).ids, 1]
        own = pieces[i, len(ids)]
        assert own, i
        got = defaultdict(int)
        for r in own:
            assert zlib.crc32(struct.pack(f"<{r.length}I", *ids[r.start : r.start + r.length])) == r.ids_crc32
            got[r.start] = r.length
        at = 0
        while at < len(ids):
            at += got[at]
        assert at == len(ids)
    for s in sequences.values():
        at = 0
        for r in sorted(s, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= window
    used = {k: sum(r.length for r in s) for k, s in sequences.items()}
    assert sum(used.values()) == sum(len(t.encode(x, add_special_tokens=False).ids) + 1 for _, x in source)
    return len(used) / -(-sum(used.values()) // window)


def test_packing_query(spark, docs):
    assert check_packing(op9_packing(spark, SF).collect(), texts(docs)) < 1.05  # sequences, of as few as there could be


def test_packing_of_one_repeated_id(spark):
    """Rows of one doc_id are dealt by their texts as well."""
    df = spark.createDataFrame([(7, f"some words of text number {k}. " * 40) for k in range(2000)], "doc_id long, text string")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    rows = packing.pack(df, BYTE).select("*", F.spark_partition_id().alias("task")).collect()
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len({r.task for r in rows}) == int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert len({r.sequence_id for r in rows}) < 1.1 * sum(r.length for r in rows) / 2048


def test_packing_order_and_odd_rows(spark, oddities, nothing):
    rows = packing.pack(oddities.coalesce(1), BYTE, window=64, stride=16, block_tokens=500).collect()
    check_packing(rows, texts(oddities), 64)
    assert all(len(r.ids) == r.length for r in rows)
    order = sorted(rows, key=lambda r: (r.sequence_id, r.offset))
    assert [r.doc_id for r in order] == sorted((r.doc_id for r in order), key=lambda x: (x is not None, x))
    assert packing.pack(nothing, BYTE).collect() == []


def test_best_cuts():
    import random
    from functools import cache

    r = random.Random(5)
    for _ in range(60):
        window, at = 16, [0]
        while len(at) < 20:
            at.append(at[-1] + r.randrange(1, 12))
        cost, each = [r.randrange(6) for _ in at[1:]], r.randrange(9)

        @cache
        def least(j):
            return 0 if j == 0 else cost[j - 1] + each + min(least(i) + (0 if (n := at[j] - at[i]) & (n - 1) == 0 else window - n) for i in range(j) if at[j] - at[i] <= window)

        ends = packing.best_cuts(at[1:], cost, window, each)
        total = sum(each + cost[at.index(e) - 1] + (0 if (n := e - b) & (n - 1) == 0 else window - n) for b, e in zip([0, *ends], ends, strict=False))
        assert total == least(len(at) - 1) and max(e - b for b, e in zip([0, *ends], ends, strict=False)) <= window


def brute_lines(rows):
    blank = " \t\n\x0b\x0c\r"
    fold = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    holds = defaultdict(list)
    for i, x in rows:
        for k in {line.strip(blank).translate(fold) for line in x.split("\n")}:
            holds[k].append(-(1 << 63) if i is None else i)
    out = []
    for i, x in rows:
        kept = [line for line in x.split("\n") if not (len(k := line.strip(blank).translate(fold)) >= 20 and len(holds[k]) >= 3 and max(holds[k]) != (-(1 << 63) if i is None else i))]
        out.append((i, "\n".join(kept), x.count("\n") + 1, x.count("\n") + 1 - len(kept)))
    return out


@pytest.mark.parametrize("which", ["docs", "oddities", "nothing"])
def test_line_dedup(which, request):
    df = request.getfixturevalue(which)
    same(line_dedup.dedup_lines(df).collect(), brute_lines(texts(df)))
    same(line_dedup.dedup_lines(df, batch_docs=3, fanout=3).collect(), brute_lines(texts(df)))


def test_line_dedup_query(spark):
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    got = op3_line_dedup(spark, SF)
    same(got.select("doc_id", "n_lines", "n_dropped", "kept_sha256").collect(), con.sql(ORACLE_SQL["op3_line_dedup"]).fetchall())


def test_line_runs(spark):
    """Runs after every batch: what is new, what repeats, levels, and that a batch reads them without a shuffle or sort."""
    runs = line_dedup.LineRuns(spark, fanout=2)
    held, new_in = {}, {}
    for k in range(7):
        batch = [(x, 0, k * 10 + x + d) for x in range(k, k + 4) for d in range(2)]
        lines = spark.createDataFrame(batch, "h1 long, h2 int, doc_id long")
        if k:
            assert {r.h1: (r.known, r.had) for r in runs.met(lines).collect()} == {x: (int(x in new_in), new_in.get(x, 0)) for x in range(k, k + 4)}
        runs.add(lines)
        for x in range(k, k + 4):
            new_in.setdefault(x, 2)
        for x, _, d in batch:
            n, m = held.get(x, (0, 0))
            held[x] = (n + 1, max(m, d))
        assert len(runs.runs()) == (k + 1).bit_count()  # the binary digits of the number of batches
        for least in (1, 3, 4, 7):
            assert {r.h1: (r.n_docs, r.max_doc) for r in runs.repeated(least).collect()} == {x: v for x, v in held.items() if v[0] >= least}
        rows = runs._all(runs.runs()).filter("known = 0").collect()
        assert sorted(r.h1 for r in rows) == sorted(held)
    with runs._sorted():
        plan = runs.met(lines)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("SortMergeJoin") == 3 and plan.count("Exchange") == 1 and plan.count("Bucketed: true") == 3
    runs.close()


def test_line_dedup_by_the_joins(spark, monkeypatch):
    """Without the joins' outcome, repeats of different batches aren't found."""
    rows = [(i, f"a line that many documents repeat {i % 7}\nx{i}") for i in range(40)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    same(line_dedup.dedup_lines(df, batch_docs=2).collect(), brute_lines(rows))
    met = line_dedup.LineRuns.met
    monkeypatch.setattr(line_dedup.LineRuns, "met", lambda self, lines: met(self, lines).withColumns({"known": F.lit(0), "had": F.lit(0).cast("long")}))
    assert sum(r.n_dropped for r in line_dedup.dedup_lines(df, batch_docs=2).collect()) < sum(r[3] for r in brute_lines(rows))


def test_line_dedup_repeated_and_kept(spark):
    """Rows that repeat an id, or all of a row, each stay one row, with their own columns."""
    rows = [(1, "the line that comes again and again\none"), (1, "the line that comes again and again\ntwo"), (2, "the line that comes again and again\nx"), (2, "the line that comes again and again\nx"), (None, "the line that comes again and again\nnull"), (None, None)]
    df = spark.createDataFrame([(*r, k, "x") for k, r in enumerate(rows)], "doc_id long, text string, lost int, row_hash string")
    got = line_dedup.dedup_lines(df, batch_docs=1, keep=["lost", "row_hash", "text"]).collect()
    assert sorted((r.lost, r.doc_id, r.text, r.n_dropped) for r in got) == [(k, *r[:2], r[3]) for k, r in enumerate(brute_lines([(i, t or "") for i, t in rows]))]
    con = duckdb.connect()
    con.sql("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?)", rows[:4])
    want = [(i, n, d, hashlib.sha256(t.encode()).hexdigest()) for i, t, n, d in brute_lines(rows[:4])]
    same(con.sql(ORACLE_SQL["op3_line_dedup"]).fetchall(), want)


def brute_prints(rows):
    out = []
    for i, x in rows:
        w = x.encode().lower().split()
        h = [xxhash.xxh64_intdigest(b" ".join(w[k : k + 4]), seed=42) for k in range(max(1, len(w) - 3))] if w else []
        out.append((i, sum(1 << b for b in range(64) if h and 2 * sum(x >> b & 1 for x in h) > len(h))))
    up = list(range(len(out)))

    def root(k):
        while up[k] != k:
            k = up[k]
        return k

    for a in range(len(out)):
        for b in range(a):
            if (out[a][1] ^ out[b][1]).bit_count() <= 4:
                up[root(a)] = root(b)
    least = {}
    for k, (i, _) in enumerate(out):
        if i is not None:
            least[root(k)] = min(i, least.get(root(k), i))
    return [(i, f"{h:016x}", least.get(root(k))) for k, (i, h) in enumerate(out)]


@pytest.mark.parametrize("which", ["docs", "oddities", "nothing"])
def test_simhash(which, request):
    df = request.getfixturevalue(which)
    same(simhash.near_duplicates(df).collect(), brute_prints(texts(df)))


def test_simhash_of_split_shards(spark):
    """Shards beyond the chunk are cut in parts, with the same components; one task may hold many shards in a row."""
    import numpy as np

    rng = np.random.default_rng(3)
    centre = rng.integers(0, 1 << 63, 4, dtype=np.uint64)
    flips = np.uint64(1) << rng.integers(0, 64, (4, 300, 3), dtype=np.uint64)
    fp = np.unique(np.concatenate([centre[:, None] ^ flips[..., 0] ^ flips[..., 1] ^ flips[..., 2], rng.integers(0, 1 << 63, (4, 300), dtype=np.uint64)]).ravel()).view(np.int64)
    df = spark.createDataFrame([(int(x),) for x in fp], "fp long")
    want = {r.id: r.component_id for r in connected_components(simhash.links(df)).collect()}
    assert len(want) > 500
    for chunk in (20, 150):
        assert {r.id: r.component_id for r in connected_components(simhash.links(df, chunk=chunk)).collect()} == want


def test_simhash_query(spark, docs):
    same(op10_simhash_near_dedup(spark, SF).collect(), brute_prints(texts(docs)))


def test_bk_forest():
    import numpy as np

    rng = np.random.default_rng(2)
    base = rng.integers(0, 1 << 63, 40, dtype=np.uint64)
    fp = np.unique(np.concatenate([base] + [base ^ (np.uint64(1) << rng.integers(0, 64, 40, dtype=np.uint64)) ^ (np.uint64(1) << rng.integers(0, 64, 40, dtype=np.uint64)) for _ in range(12)]))
    fp = fp[rng.permutation(len(fp))]
    shard = np.sort(rng.integers(0, 4, len(fp)))
    got = simhash.BKForest(shard, fp, 3).components(block=17)
    near = (np.bitwise_count(fp[:, None] ^ fp) <= 3) & (shard[:, None] == shard)
    want = np.arange(len(fp))
    for _ in range(len(fp)):
        nxt = np.array([want[near[i]].min() for i in range(len(fp))])
        if (nxt == want).all():
            break
        want = nxt
    assert (got == want).all()


def test_components(spark):
    import random

    r = random.Random(8)
    hubs = [(1000, 1000 + k) for k in range(1, 250)] + [(2500, 2000 + k) for k in range(250)] + [(2500, 1003)]  # at the smallest and at the largest id
    pairs = hubs + [(k, k + 1) for k in range(40)] + [(100, 100 + k) for k in range(1, 30)] + [(r.randrange(200, 300), r.randrange(200, 300)) for _ in range(60)] + [(7, 7)]
    least = {x: x for p in pairs for x in p}
    for _ in range(60):
        for a, b in pairs:
            least[a] = least[b] = min(least[a], least[b])
    got = {x.id: x.component_id for x in connected_components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    assert {k: got.get(k, k) for k in least} == least


def test_components_spare_the_driver(spark, monkeypatch):
    """Stars take no round, as nothing is left to link; without hubs no round asks for a broadcast."""
    from chromaspan.llm import common

    plans = []
    stored = common.stored
    monkeypatch.setattr(common, "stored", lambda df, name: plans.append(df._jdf.queryExecution().logical().toString()) or stored(df, name))
    stars = [(10, 10 + k) for k in range(1, 200)] + [(500, 500 + k) for k in range(1, 5)]
    got = {x.id: x.component_id for x in connected_components(spark.createDataFrame(stars, "a long, b long")).collect()}
    assert got == {x: p[0] for p in stars for x in p}
    assert len(plans) == 1
    chain = [(k, k + 1) for k in range(20)]
    assert {x.id: x.component_id for x in connected_components(spark.createDataFrame(chain, "a long, b long")).collect()} == dict.fromkeys(range(21), 0)
    assert len(plans) > 2
    assert not any("broadcast" in p for p in plans)
    assert connected_components(spark.createDataFrame([(3, 3)], "a long, b long")).count() == 0


@pytest.mark.parametrize("which", ["docs", "oddities", "nothing"])
def test_lm(which, request):
    import math
    from collections import Counter

    df = request.getfixturevalue(which)
    rows = texts(df)
    held = [i is not None and zlib.crc32(str(i).encode()) % 5 == 1 for i, _ in rows]
    split = [[*x.encode().lower().split(), b""] for _, x in rows]
    c = Counter(w for s, h in zip(split, held, strict=True) if not h for w in s)
    n, v = sum(c.values()), len(c)
    base = [sum(math.log10((c[w] + 0.5) / (n + 0.5 * (v + 1))) for w in s) for s in split]
    for kw in ({}, {"table_words": 400, "own_types": 20, "suffix_types": 10, "classes": 6, "sweeps": 3}):
        got = sorted(lm_score.score(df, **kw).collect(), key=lambda r: (r.doc_id is not None, r.doc_id, r.n_tokens))
        want = sorted(zip(rows, held, split, base, strict=True), key=lambda r: (r[0][0] is not None, r[0][0], len(r[2])))
        assert [(r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens) for r in got] == [(i, h, len(s), sum(c[w] > 0 for w in s), n) for (i, _), h, s, _ in want]
        assert all(abs(r.base_score - b) < 1e-6 * abs(b) + 1e-9 for r, (*_, b) in zip(got, want, strict=True))
        if which == "docs":
            assert sum(r.score for r in got if r.held_out) > sum(r.base_score for r in got if r.held_out)


@pytest.mark.parametrize("which", ["docs", "oddities"])
def test_lm_score_by_brute_force(spark, which, request):
    """Scores by the definition, from counts of the texts themselves; only which word has which class is taken from the model."""
    import math
    from collections import Counter

    df = request.getfixturevalue(which)
    kw = dict(table_words=300, own_types=60, suffix_types=12, classes=7, prior=5.0, sweeps=2)
    words = lm_score._words(df, 1)
    counts = lm_score.word_counts(words)
    m = lm_score.fit(words, counts, **kw)
    table, suffix = {w: i + 1 for i, w in enumerate(m.table)}, {s: len(m.table) + 1 + i for i, s in enumerate(m.suffixes)}
    code = lambda w: 0 if not w else table.get(w) or suffix.get(w[-3:], len(m.of) - 1)
    split = [(i, i is not None and zlib.crc32(str(i).encode()) % 5 == 1, [*x.encode().lower().split(), b""]) for i, x in texts(df)]
    c = Counter(w for _, held, s in split if not held for w in s)
    size, vocab, big, left = Counter(), Counter(), Counter(), Counter()
    for w, n in c.items():
        size[code(w)] += n
        vocab[code(w)] += 1
    for _, held, s in split:
        for a, b in zip([b"", *s], s, strict=False):
            if not held:
                big[m.of[code(a)], m.of[code(b)]] += 1
                left[m.of[code(a)]] += 1
    k, in_class, types = max(m.of) + 1, Counter(), Counter(m.of.tolist())
    for t, n in size.items():
        in_class[m.of[t]] += n
    total = sum(c.values())

    def log_p(a, b):
        t = code(b)
        g, h = m.of[code(a)], m.of[t]
        p_class = (in_class[h] + 0.5) / (total + 0.5 * k)
        within = 1 if t <= len(m.table) else (c[b] + 0.5) / (size[t] + 0.5 * (vocab[t] + 1))
        return math.log10((big[g, h] + 5 * p_class) / (left[g] + 5) * (size[t] + 0.5) / (in_class[h] + 0.5 * types[h]) * within)

    want = sorted(((i is not None, i, len(s), sum(log_p(a, b) for a, b in zip([b"", *s], s, strict=False))) for i, _, s in split), key=lambda x: x[:3])
    got = sorted(((r.doc_id is not None, r.doc_id, r.n_tokens, r.score, r.perplexity) for r in lm_score.score(df, **kw).collect()), key=lambda x: x[:3])
    assert [x[:3] for x in got] == [x[:3] for x in want]
    assert all(abs(g[3] - w[3]) < 1e-6 * abs(w[3]) + 1e-9 and abs(math.log10(g[4]) + g[3] / g[2]) < 1e-6 for g, w in zip(got, want, strict=True))


def test_exchange_gains_are_differences_of_likelihood():
    import numpy as np

    rng = np.random.default_rng(3)
    n, cls = rng.poisson(2.0, (12, 12)).astype(float), np.arange(12) % 4
    one = np.eye(4)[cls]
    big = one.T @ n @ one
    for w in range(12):
        rest = one.copy()
        rest[w] = 0
        out, into, own = n[w] @ rest, n[:, w] @ rest, n[w, w]
        base = lm_score.without(big, cls[w], out, into, own)
        for c, g in enumerate(lm_score.gains(base, out, into, own)):
            new = rest.copy()
            new[w, c] = 1
            assert abs(g - (lm_score.likelihood(new.T @ n @ new) - lm_score.likelihood(base))) < 1e-6


def test_words_beyond_the_first_are_exchanged(spark):
    """Words that never meet the first block's exchange join the class of their contexts."""
    import random

    r = random.Random(4)
    kinds = [[f"{k}word{i}zz" for i in range(40)] for k in "abc"]
    text = lambda: " ".join(r.choice(kinds[k % 3]) for k in range(60))
    df = spark.createDataFrame([(i, text()) for i in range(400)], "doc_id long, text string")
    rows = lm_score._words(df, 1)
    m = lm_score.fit(rows, lm_score.word_counts(rows), table_words=1000, own_types=30, suffix_types=5, classes=6, prior=5.0, sweeps=2)
    of = {w.decode(): m.of[i + 1] for i, w in enumerate(m.table)}
    assert len(of) == 120
    for kind in kinds:
        assert len({of[w] for w in kind}) <= 2
    assert not {of[w] for w in kinds[0]} & {of[w] for w in kinds[1]}


def test_exchange_beats_start():
    import numpy as np

    rng = np.random.default_rng(4)
    true = np.arange(30) % 3
    p = np.array([[0.1, 0.8, 0.1], [0.1, 0.1, 0.8], [0.8, 0.1, 0.1]])
    n = rng.poisson(p[true][:, true] * 30)
    got = lm_score.exchange(n, 3)
    assert all(len(set(got[true == k])) == 1 for k in range(3)) and len(set(got)) == 3


def test_failed_line_dedup_leaves_nothing(spark, oddities, monkeypatch):
    """No table in the catalog and no changed setting after a failure in the midst."""
    name = "spark.sql.legacy.bucketedTableScan.outputOrdering"
    before, tables = spark.conf.get(name), {t.name for t in spark.catalog.listTables()}
    made = []

    def fails(self, lines):
        made.append(1)
        if len(made) > 2:
            raise RuntimeError("as if an executor had gone for good")
        return add(self, lines)

    add = line_dedup.LineRuns.add
    monkeypatch.setattr(line_dedup.LineRuns, "add", fails)
    with pytest.raises(RuntimeError, match="for good"):
        line_dedup.dedup_lines(oddities, batch_docs=2)
    assert len(made) == 3 and spark.conf.get(name) == before and {t.name for t in spark.catalog.listTables()} == tables
