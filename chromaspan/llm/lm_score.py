"""Language-model scores by Brown classes."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, slices, stored
from .nndescent import whole_groups

END = b""  # no word is empty


def _h(x: np.ndarray) -> np.ndarray:
    return x * np.log(np.maximum(x, 1))


def likelihood(big: np.ndarray) -> float:
    """What of the corpus's log likelihood depends on the classes, from the bigram counts of classes."""
    return float(_h(big).sum() - _h(big.sum(0)).sum() - _h(big.sum(1)).sum())


def without(big: np.ndarray, a: int, out: np.ndarray, into: np.ndarray, own: float) -> np.ndarray:
    """The class bigrams without a word of class a; out and into are its pairs with each class (itself left out), own those with itself."""
    base = big.copy()
    base[a] -= out
    base[:, a] -= into
    base[a, a] -= own
    return base


def gains(base: np.ndarray, out: np.ndarray, into: np.ndarray, own: float) -> np.ndarray:
    """Of each class what the likelihood gains if the word that base lacks joins it."""
    j, i = np.flatnonzero(out), np.flatnonzero(into)
    g = (_h(base[:, j] + out[j]) - _h(base[:, j])).sum(1) + (_h(base[i] + into[i, None]) - _h(base[i])).sum(0)
    d, row, col = np.diag(base), base.sum(1) + into, base.sum(0) + out  # wherever it goes, the others' totals are back
    lost = _h(row).sum() - _h(base.sum(1)).sum() + _h(col).sum() - _h(base.sum(0)).sum()
    g += _h(d + out + into + own) - _h(d + out) - _h(d + into) + _h(d)  # where its row and column cross
    return g - (_h(row + out.sum() + own) - _h(row) + _h(col + into.sum() + own) - _h(col)) - lost


def exchange(n: np.ndarray, classes: int, sweeps: int = 8) -> np.ndarray:
    """The class of each of T types by the exchange algorithm, from their bigram counts n (T x T).

    Types start in classes by frequency; then each in turn goes to the class where the likelihood of the class bigrams
    is largest, until a sweep moves none.
    """
    t = len(n)
    n = n.astype(np.float64)
    order = np.argsort(-(n.sum(0) + n.sum(1)), kind="stable")
    cls = np.empty(t, np.int64)
    cls[order] = np.arange(t) % classes
    one = np.eye(classes)[cls]
    big = one.T @ n @ one
    for _ in range(sweeps):
        moved = 0
        for w in order:
            a = cls[w]
            one[w] = 0
            out, into, own = n[w] @ one, n[:, w] @ one, n[w, w]
            base = without(big, a, out, into, own)
            gain = gains(base, out, into, own)
            c = int(np.argmax(gain))
            c = a if gain[a] >= gain[c] - 1e-9 else c
            base[c] += out
            base[:, c] += into
            base[c, c] += own
            big, cls[w] = base, c
            one[w, c] = 1
            moved += c != a
        if not moved:
            break
    return cls


class Known(dict):
    """Codes by word; what is missing is looked up by its last three bytes, and kept if it is short."""

    def __init__(self, table: dict[bytes, int], suffix: dict[bytes, int], rest: int):
        super().__init__(table)
        self.suffix, self.rest = suffix, rest

    def __missing__(self, word: bytes) -> int:
        code = self.suffix.get(word[-3:], self.rest)
        if len(word) < 256:
            self[word] = code
        return code


class Types:
    """Codes of words: a table word has its own; any other shares one with the words of its type, by its last bytes."""

    def __init__(self, table: list[bytes], suffixes: list[bytes]):
        self.table = {w: i for i, w in enumerate(table)}
        self.suffix = {s: len(table) + i for i, s in enumerate(suffixes)}
        self.rest = len(table) + len(suffixes)
        self.known = Known(self.table, self.suffix, self.rest)

    def codes(self, texts: list[list[bytes]], cache_words: int = 400_000) -> list[np.ndarray]:
        """An array of codes for each text."""
        if len(self.known) > cache_words + len(self.table):
            self.known = Known(self.table, self.suffix, self.rest)
        get = self.known.__getitem__
        return [np.fromiter(map(get, t), np.int64, len(t)) for t in texts]


def _words(docs: DataFrame, held: int) -> DataFrame:
    crc = F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(5)), F.lit(-1))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"), (crc == held).alias("held_out"))


def word_counts(rows: DataFrame, most: int = 300_000) -> DataFrame:
    """(word, c) of all training tokens; the end token is the empty word."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()

        def out() -> pa.RecordBatch:
            b = pa.record_batch([pa.array(list(seen), pa.binary()), pa.array(list(seen.values()), pa.int64())], names=["word", "n"])
            seen.clear()
            return b

        for b in batches:
            texts = [t or b"" for t in b.column("text").to_pylist()]
            seen[END] += len(texts)
            for i, j in slices(texts):
                seen.update(chain.from_iterable(t.lower().split() for t in texts[i:j]))
                if len(seen) > most:
                    yield out()
        yield out()

    return rows.filter("not held_out").select("text").mapInArrow(run, "word binary, n long").groupBy("word").agg(F.sum("n").alias("c"))


def frequent(words: DataFrame, most: int) -> list[tuple[bytes, int]]:
    """At most `most` of the most frequent words of under 256 bytes with their counts: those in the upper steps of a logarithmic scale of
    counts that hold no more. The scale has few steps at any size, and no task sends more than is kept."""
    step = F.floor(F.log2("c") * 32).cast("long")
    fits, least = 0, None
    for s, n in sorted(map(tuple, words.groupBy(step.alias("s")).count().collect()), reverse=True):
        fits += n
        if fits > most:
            break
        least = s
    kept = [] if least is None else words.filter((step >= least) & (F.length("word") < 256)).collect()
    return sorted(((bytes(r.word), r.c) for r in kept), key=lambda x: (-x[1], x[0]))


def _summed(keys: list[np.ndarray], counts: list[np.ndarray]) -> pa.RecordBatch:
    """Distinct pairs with the sums of their counts; the lists are emptied."""
    key, n = np.concatenate([*keys, np.zeros(0, np.int64)]), np.concatenate([*counts, np.zeros(0, np.int64)])
    keys.clear()
    counts.clear()
    order = np.argsort(key)
    key, n = key[order], n[order]
    start = np.flatnonzero(np.diff(key, prepend=-1))
    return pa.record_batch([pa.array(key[start]), pa.array(np.add.reduceat(n, start) if len(start) else n)], names=["pair", "n"])


def bigrams(rows: DataFrame, table: list[bytes], suffixes: list[bytes], most: int = 4_000_000) -> DataFrame:
    """(pair, n) of all pairs of codes in the training texts, the end before and after each: pair is the first code times
    the number of codes plus the second; the codes are those of Types plus 1, the end is 0. A task sums its own pairs,
    so a pair is shuffled once a task (or once every `most` pairs)."""
    spark = rows.sparkSession
    given, size = spark.sparkContext.broadcast((table, suffixes)), 2 + len(table) + len(suffixes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types, end = Types(*given.value), np.zeros(1, np.int64)
        keys: list[np.ndarray] = []
        counts: list[np.ndarray] = []
        for b in batches:
            texts = [x or b"" for x in b.column("text").to_pylist()]
            for i, j in slices(texts):
                stream = np.concatenate([end, *chain.from_iterable((c + 1, end) for c in types.codes([x.lower().split() for x in texts[i:j]]))])
                at, n = np.unique(stream[:-1] * size + stream[1:], return_counts=True)
                keys.append(at)
                counts.append(n)
                if sum(map(len, keys)) > most:
                    yield _summed(keys, counts)
        yield _summed(keys, counts)

    pairs = rows.filter("not held_out").select("text").mapInArrow(run, "pair long, n long").repartition("pair").groupBy("pair").agg(F.sum("n").alias("n"))
    return stored(pairs, "bigrams")


def class_matrix(pairs: DataFrame, of: np.ndarray) -> np.ndarray:
    """The bigram counts of classes (of: each code's class): each task sums its pairs, so the driver gets numbers of class pairs alone."""
    k, size = int(of.max()) + 1, len(of)
    given = pairs.sparkSession.sparkContext.broadcast(of)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros(k * k, np.int64)
        for b in batches:
            x, y = np.divmod(b.column("pair").to_numpy(), size)
            np.add.at(n, given.value[x] * k + given.value[y], b.column("n").to_numpy())
        at = np.flatnonzero(n)
        yield pa.record_batch([pa.array(at), pa.array(n[at])], names=["pair", "n"])

    t = pairs.mapInArrow(run, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(k * k, np.int64)
    out[t.column("pair").to_numpy()] = t.column("n").to_numpy()
    return out.reshape(k, k)


def reassigned(pairs: DataFrame, of: np.ndarray, big: np.ndarray, first: int, last: int) -> np.ndarray:
    """The codes' classes after an exchange step for every code in [first, last): its pairs with each class meet in a
    shuffle by code, and it goes where the likelihood gains most."""
    k, spark = len(big), pairs.sparkSession
    given = spark.sparkContext.broadcast((of, big.astype(np.float64)))

    def contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Of a code: pairs to class c (c), from class c (k + c), with itself (2 k); summed once every 2,000,000."""
        of, wide, size = given.value[0], 2 * k + 1, len(given.value[0])
        keys: list[np.ndarray] = []
        counts: list[np.ndarray] = []

        def out() -> pa.RecordBatch:
            b = _summed(keys, counts)
            p = b.column("pair").to_numpy()
            return pa.record_batch([pa.array((p // wide).astype(np.int32)), pa.array((p % wide).astype(np.int32)), b.column("n")], names=["code", "c", "n"])

        held = 0
        for b in batches:
            (x, y), n = np.divmod(b.column("pair").to_numpy(), size), b.column("n").to_numpy()
            for who, c in ((x, np.where(x == y, 2 * k, of[y])), (y, np.where(x == y, -1, k + of[x]))):
                some = (who >= first) & (who < last) & (c >= 0)
                keys.append(who[some] * wide + c[some])
                counts.append(n[some])
                held += len(keys[-1])
            if held > 2_000_000:
                yield out()
                held = 0
        yield out()

    def move(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of, big = given.value
        for t in whole_groups(batches, ["code"]):
            code, c, n = (t.column(x).to_numpy() for x in ("code", "c", "n"))
            start = np.append(np.unique(code, return_index=True)[1], len(code))
            best = []
            for i, j in zip(start, start[1:], strict=False):
                v = np.bincount(c[i:j], n[i:j], 2 * k + 1)
                out, into, own, a = v[:k], v[k : 2 * k], v[2 * k], of[code[i]]
                gain = gains(without(big, a, out, into, own), out, into, own)
                best.append(int(np.argmax(gain)) if gain.max() > gain[a] + 1e-9 else int(a))
            yield pa.record_batch([pa.array(code[start[:-1]]), pa.array(best, pa.int32())], names=["code", "cls"])

    met = pairs.mapInArrow(contexts, "code int, c int, n long").groupBy("code", "c").agg(F.sum("n").alias("n"))
    t = met.repartition("code").sortWithinPartitions("code").mapInArrow(move, "code int, cls int").toArrow()  # the table's words at most
    out = of.copy()
    out[t.column("code").to_numpy()] = t.column("cls").to_numpy()
    return out


@dataclass
class Model:
    """A class bigram model. Codes: 0 the end, then the table's words, then the types that all other words share."""

    table: list[bytes]
    suffixes: list[bytes]
    of: np.ndarray  # the class of each code
    emit: np.ndarray  # log10 p(word | class), for shared types without their words' log10 (c + 0.5)
    base: np.ndarray  # the same for the unigram baseline
    go: np.ndarray  # log10 p(class | class before)
    ends: int  # training tokens that are the end
    total: int  # training tokens


def fit(rows: DataFrame, counts: DataFrame, table_words: int, own_types: int, suffix_types: int, classes: int, prior: float, sweeps: int) -> Model:
    """The model of the training rows; see score."""
    spark = rows.sparkSession
    total, distinct = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first()
    ends = counts.filter(F.col("word") == F.lit(END)).agg(F.coalesce(F.sum("c"), F.lit(0))).first()[0]
    words = counts.filter(F.col("word") != F.lit(END))
    top = frequent(words, table_words)
    table = [w for w, _ in top]
    own = table[:own_types]
    # table_words short words at most
    tail = words.join(F.broadcast(spark.createDataFrame([(w,) for w in table], "word binary")), "word", "left_anti") if table else words
    tail = tail.groupBy(F.substring("word", -3, 3).alias("suffix")).agg(F.sum("c").alias("c"), F.count("*").alias("v"))
    shared = [(bytes(r.suffix), r.c, r.v) for r in tail.orderBy(F.desc("c"), "suffix").limit(suffix_types).collect()]
    suffixes = [s for s, _, _ in shared]
    size = np.array([ends, *(c for _, c in top), *(c for _, c, _ in shared), 0], np.float64)
    vocab = np.array([1] * (1 + len(top)) + [v for _, _, v in shared] + [0], np.float64)
    size[-1], vocab[-1] = max(0, total - size.sum()), max(0, distinct - vocab.sum())

    pairs = bigrams(rows, table, suffixes)
    # First the exchange among the most frequent words and, as types, the endings of the others; then every word by itself.
    few = Types(own, suffixes)
    kind = np.concatenate([[0], *(c + 1 for c in few.codes([table])), np.arange(1 + len(own), 2 + len(own) + len(suffixes))]).astype(np.int64)
    n = class_matrix(pairs, kind)
    t = int(kind.max()) + 1
    cls = np.unique(exchange(n, min(classes, t)), return_inverse=True)[1]
    of, one = cls[kind], np.eye(cls.max() + 1, dtype=np.int64)[cls]
    big = one.T @ n @ one
    for _ in range(sweeps):
        new = reassigned(pairs, of, big, 1 + len(own), 1 + len(table))
        after = class_matrix(pairs, new)
        if len(after) < len(big) or likelihood(after) <= likelihood(big):
            break
        of, big = new, after

    k = len(big)
    in_class, types = np.bincount(of, size, k), np.bincount(of, minlength=k)
    p_class = (in_class + 0.5) / (in_class.sum() + 0.5 * k)
    go = np.log10((big + prior * p_class) / (big.sum(1, keepdims=True) + prior))
    emit = np.log10((size + 0.5) / (in_class[of] + 0.5 * types[of]))
    alone = 1 + len(table)
    emit[alone:] -= np.log10(size[alone:] + 0.5 * (vocab[alone:] + 1))
    base = np.full(len(size), -np.log10(total + 0.5 * (distinct + 1)))
    base[:alone] += np.log10(size[:alone] + 0.5)
    return Model(table, suffixes, of, emit, base, go, ends, int(total))


def score(
    docs: DataFrame, table_words: int = 65_536, own_types: int = 1024, suffix_types: int = 255, classes: int = 128, prior: float = 5.0, sweeps: int = 1, held: int = 1
) -> DataFrame:
    """The log10 probability of every whole text of docs (doc_id, text) by a class bigram model of the training rows.

    Returns doc_id, held_out, n_tokens, n_known, train_tokens, base_score (unigrams, add 0.5), score and perplexity
    (of score, per token). Rows whose crc32(doc_id) mod 5 is `held` are held out; a null doc_id is trained on and stays
    null. A null, empty or blank text has the end token only; a very long one is scored whole. Repeated rows count and
    are scored each; an empty table gives no rows; without training rows every base probability is 1. Other columns
    are ignored.

    The model: words are counted over all training rows, and so are the pairs of them, in a table that grows with the
    corpus. The table_words most frequent words (a bounded broadcast) have classes of their own choice: the own_types
    first by exchange among themselves, where all others stand for types by their last three bytes; then each of the
    others by an exchange step with its own pairs. Words beyond the table have the class of their type, which is
    clustered like a word (suffix_types of them, and one for the rest).
    p(word | before) = p(class | class before) p(type | class) p(word | type); p(word | type) and p(type | class)
    add 0.5 a word or type and for one unseen, p(class | class before) is smoothed to p(class) with weight `prior`.

    The table's words are scored where they stand; the rest meet their counts in a join, once a document and word. The
    driver gets matrices of (own_types + suffix_types + 2) squared at most, and the table's words with their classes.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    rows = _words(docs, held)
    counts = stored(word_counts(rows), "words")
    fitted = fit(rows, counts, table_words, own_types, suffix_types, classes, prior, sweeps)
    model = spark.sparkContext.broadcast(fitted)

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model.value
        of, emit, base, go = m.of, m.emit, m.base, m.go
        types, known, key = Types(m.table, m.suffixes), 1 + len(m.table), TaskContext.get().partitionId() << 40
        for b in batches:
            texts = [x or b"" for x in b.column("text").to_pylist()]
            for i, j in slices(texts):
                split, out = [x.lower().split() for x in texts[i:j]], []
                for words, code in zip(split, types.codes(split), strict=True):
                    s = np.concatenate([code + 1, [0]])
                    q = of[s]
                    rare = Counter(words[x] for x in np.flatnonzero(s >= known))
                    value = go[np.concatenate([of[:1], q[:-1]]), q].sum() + emit[s].sum()
                    out.append((len(s), len(s) - sum(rare.values()) - (not m.ends), float(base[s].sum()), float(value), list(rare), list(rare.values())))
                cols = [pa.array(x, k) for x, k in zip(zip(*out, strict=True), (pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.list_(pa.binary()), pa.list_(pa.int32())), strict=True)]
                ids = pa.array(np.arange(key, key + len(out)))
                key += len(out)
                yield pa.record_batch([ids, b.column("doc_id").slice(i, j - i), b.column("held_out").slice(i, j - i), *cols], names=["row", "doc_id", "held_out", "n", "known", "base", "model", "words", "times"])

    parts = stored(rows.mapInArrow(scored, "row long, doc_id long, held_out boolean, n long, known long, base double, model double, words array<binary>, times array<int>"), "scores")
    rare = parts.select("row", F.explode(F.arrays_zip("words", "times")).alias("x")).select("row", F.col("x.words").alias("word"), F.col("x.times").alias("times"))
    met = rare.join(counts, "word", "left").select("row", "times", F.coalesce("c", F.lit(0)).alias("c"))
    more = met.groupBy("row").agg(F.sum(F.col("times") * F.log10(F.col("c") + 0.5)).alias("log_c"), F.sum(F.when(F.col("c") > 0, F.col("times")).otherwise(0)).alias("seen"))
    log_c, seen = F.coalesce("log_c", F.lit(0.0)), F.coalesce("seen", F.lit(0))
    both = parts.drop("words", "times").join(more, "row", "left")
    return both.select(
        "doc_id", "held_out", F.col("n").alias("n_tokens"), (F.col("known") + seen).cast("long").alias("n_known"), F.lit(fitted.total).cast("long").alias("train_tokens"),
        (F.col("base") + log_c).alias("base_score"), (F.col("model") + log_c).alias("score"), F.pow(F.lit(10.0), -(F.col("model") + log_c) / F.col("n")).alias("perplexity"),
    )
