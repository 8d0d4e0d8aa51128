"""Toxicity by a support vector machine over a subsequence string kernel."""

from __future__ import annotations

import math
import re
from collections.abc import Iterator, Sequence
from heapq import nlargest
from itertools import chain, combinations
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import bounded_batches, slices, stored

SPELLED = re.compile(r"(?<!\S)(?:\S[ \t]+){3,}\S(?!\S)")
DIMS = 1 << 18
WRONG = 0.0  # a negative window above this margin is on the wrong side
NONE = -1.0  # the margin of a text without words: an ordinary word
MARKS = ".,;:!?\"'()[]-"  # what a word mostly has at its ends beside letters
LONGEST = 24  # letters of a window; a longer word gives several that overlap by half


class Kernel:
    """The gap-weighted subsequence kernel of strings, through its feature map.

    A feature is a subsequence of `letters` letters within `span` places; each occurrence counts decay to the power of
    the letters it skips. Inserted letters and gaps so cost a factor, not the match. A string's features are divided by
    the root of its squared occurrence weights, so that length doesn't count.
    """

    def __init__(self, letters: int = 4, span: int = 6, decay: float = 0.5):
        self.shapes = [((0, *c), decay ** (c[-1] + 1 - letters)) for c in combinations(range(1, span), letters - 1)]

    def occurrences(self, words: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray, float]]:
        """Of each shape: the words and the features that occur in them, and the weight."""
        width = max(map(len, words)) + 2
        text = np.array([f"^{w}".ljust(width + 8, "\0") for w in words])
        codes = text.view(np.uint32).reshape(len(words), -1).astype(np.uint64)
        for offsets, weight in self.shapes:
            parts = [codes[:, o : o + width] for o in offsets]
            h = np.zeros_like(parts[0])
            for p in parts:
                h = (h * np.uint64(1_000_003) + p) * np.uint64(0x9E3779B97F4A7C15)
                h ^= h >> np.uint64(29)
            who, where = np.nonzero(parts[-1])
            yield who, (h[who, where] & np.uint64(DIMS - 1)).astype(np.int64), weight

    def features(self, words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Rows, features and normalised weights of the sparse feature matrix."""
        parts = list(self.occurrences(words))
        who, what, w = np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts]), np.concatenate([np.full(len(p[0]), p[2]) for p in parts])
        norm = np.sqrt(np.bincount(who, w * w, len(words)))
        return who, what, w / np.maximum(norm, 1e-12)[who]

    def project(self, words: list[str], machines: list[tuple[np.ndarray, float]]) -> list[np.ndarray]:
        """The words' margins by each machine: a vector in feature space and a bias."""
        who, what, w = self.features(words)
        return [np.bincount(who, onto[what] * w, len(words)) + bias for onto, bias in machines]

    def gram(self, words: list[str], landmarks: list[str]) -> np.ndarray:
        """Kernel values of words with landmarks."""
        who, what, w = self.features(landmarks)
        used, index = np.unique(what, return_inverse=True)
        dense = np.zeros((len(used), len(landmarks)))
        np.add.at(dense, (index, who), w)
        place = np.full(DIMS, -1)
        place[used] = np.arange(len(used))
        out = np.zeros((len(words), len(landmarks)))
        for i in range(0, len(words), 200):
            r, f, v = self.features(words[i : i + 200])
            k = place[f] >= 0
            np.add.at(out, r[k] + i, dense[place[f[k]]] * v[k, None])
        return out


def windows(token: str) -> list[str]:
    """The strings that a token is judged by: its letters, and the runs of letters in it if it has several."""
    token = token.lower()
    letters = token if token.isalpha() else "".join(c for c in token if c.isalpha())
    found = [letters] if len(letters) > 2 else []
    if letters != token:
        parts = [p for p in re.findall(r"[^\W\d_]+", token) if len(p) > 2]
        found += [p for p in parts if p != letters]
    return list(chain.from_iterable([w] if len(w) <= LONGEST else [w[i : i + LONGEST] for i in range(0, len(w) - LONGEST // 2, LONGEST // 2)] for w in found))


def tokens(text: str) -> list[str]:
    """The words of a text, and each run of single letters spelled out with blanks as one."""
    return text.split() + ["".join(x.split()) for x in SPELLED.findall(text)]


def svm(x: np.ndarray, y: np.ndarray, weight: np.ndarray, epochs: int = 60) -> tuple[np.ndarray, float]:
    """A linear support vector machine by dual coordinate descent; the bias is a constant feature."""
    x = np.hstack([x, np.ones((len(x), 1))])
    q, alpha, w, rng = (x * x).sum(1), np.zeros(len(x)), np.zeros(x.shape[1]), np.random.default_rng(7)
    for _ in range(epochs):
        most = 0.0
        for i in rng.permutation(len(x)):
            g = y[i] * (x[i] @ w) - 1
            new = min(max(alpha[i] - g / q[i], 0.0), weight[i])
            if new != alpha[i]:
                w += (new - alpha[i]) * y[i] * x[i]
                most = max(most, abs(new - alpha[i]))
                alpha[i] = new
        if most < 1e-3:
            break
    return w[:-1], float(w[-1])


def logistic(z: np.ndarray, y: np.ndarray, steps: int = 200) -> np.ndarray:
    """Weights of the columns of z (or of z alone) and of 1 in the log odds of y, by Newton steps with a light penalty."""
    d = np.hstack([z.reshape(len(z), -1), np.ones((len(z), 1))])
    w, least = np.zeros(d.shape[1]), np.diag([1e-2] * (d.shape[1] - 1) + [1e-6])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(d @ w, -30, 30)))
        move = np.linalg.solve(d.T @ (d * (p * (1 - p) + 1e-6)[:, None]) + least, d.T @ (p - y) + least @ w)
        w -= move * min(1.0, 5 / max(1e-9, np.abs(move).max()))
        if np.abs(move).max() < 1e-6:
            break
    return w


def _held(doc_id: str = "doc_id"):
    return F.coalesce(F.pmod(F.crc32(F.col(doc_id).cast("string")), F.lit(5)), F.lit(-1)) == 0


class Margins:
    """The machines' margins of tokens, each token judged once; only positive margins are kept, for no other counts."""

    def __init__(self, machines: list[tuple[np.ndarray, float]], cache_words: int = 400_000):
        self.kernel, self.machines, self.cache_words = Kernel(), machines, cache_words
        self.seen: set[str] = set()
        self.hot: dict[str, tuple[float, float]] = {}

    def _judge(self, words: list[str]) -> None:
        """Adds to `hot` the words that have a window on the positive side of either machine."""
        parts = []
        for low in "\n".join(words).lower().split("\n"):  # words hold no white space
            core = low.strip(MARKS)
            parts.append([core] if core.isalpha() and 2 < len(core) <= LONGEST else windows(low))
        flat, hit = sorted({*chain.from_iterable(parts)}, key=len), {}  # like lengths together: less padding
        for k in range(0, len(flat), 4000):
            some = flat[k : k + 4000]
            strong, weak = self.kernel.project(some, self.machines)
            hit |= {some[i]: (float(strong[i]), float(weak[i])) for i in np.flatnonzero((strong > 0) | (weak > 0))}
        for w, own in zip(words, parts, strict=True):
            found = [hit[x] for x in own if x in hit]
            if found:
                self.hot[w] = (max(x for x, _ in found), max(x for _, x in found))

    def of(self, texts: list[str]) -> list[list[float]]:
        """Of each text the largest strong margin of its tokens, and the second and third largest weak ones of different tokens."""
        out = []
        for i, j in slices(texts, 1_000_000):
            split = [set(tokens(t)) for t in texts[i:j]]
            missing = set().union(*split).difference(self.seen)
            if len(self.seen) + len(missing) > self.cache_words:
                self.seen, self.hot = set(), {}
                missing = set().union(*split)
            if missing:
                self._judge(list(missing))
            self.seen |= missing
            for t in split:
                found = [self.hot[w] for w in self.hot.keys() & t]
                out.append([max((x for x, _ in found), default=NONE), *nlargest(3, chain((x for _, x in found), (NONE,) * 3))[1:]])
            for w in missing:
                if len(w) >= 256:  # the cache is bounded in bytes, too
                    self.seen.discard(w)
                    self.hot.pop(w, None)
        return out


def _margins(rows: DataFrame, model, schema: T.StructType, keep: list[str]) -> DataFrame:
    """z, beside the columns to keep: see Margins.of; each from 0 to 1.5. A token has the largest margins of its windows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        margins = Margins(model.value)
        for b in batches:
            z = np.clip(margins.of([t or "" for t in b.column("text").to_pylist()]), 0, 1.5)
            yield pa.record_batch([*(b.column(c) for c in keep), pa.array(z.tolist(), pa.list_(pa.float64()))], names=[*keep, "z"])

    return rows.select(*dict.fromkeys([*keep, "text"])).mapInArrow(run, T.StructType([*schema.fields, T.StructField("z", T.ArrayType(T.DoubleType()))]))


def varied(word: str) -> list[str]:
    """A word with one letter put in, at each inner place."""
    letters = "xeaqio"
    return [word[:i] + letters[(i + len(word)) % len(letters)] + word[i:] for i in range(1, len(word))] if len(word) > 4 else []


def fit(kernel: Kernel, bad: list[str], good: list[str], landmarks: int) -> tuple[np.ndarray, float]:
    """The separating vector in feature space and its bias: Nystrom features of the windows by landmarks of both kinds."""
    of_bad = min(len(bad), landmarks // 2)
    marks = list(dict.fromkeys(bad[:of_bad] + good[-(landmarks - of_bad) :]))
    value, vector = np.linalg.eigh(kernel.gram(marks, marks))
    root = vector[:, value > 1e-8] / np.sqrt(value[value > 1e-8])
    more = list(dict.fromkeys(v for w in bad[:100] for v in varied(w)))
    every, y = [*bad, *more, *good], np.array([1.0] * (len(bad) + len(more)) + [-1.0] * len(good))
    w, bias = svm(kernel.gram(every, marks) @ root, y, np.array([30.0] * len(bad) + [1.0] * len(more) + [10.0] * len(good)))
    who, what, v = kernel.features(marks)
    onto = np.zeros(DIMS)
    np.add.at(onto, what, (root @ w)[who] * v)
    return onto, bias


def train(docs: DataFrame, labels: DataFrame, max_docs: int = 8000, landmarks: int = 384, working: int = 3000):
    """(machines, weights), from at most max_docs labelled documents that aren't held out.

    A sentence of a document labelled 0 is negative, with each of its windows. One of a document labelled 1 is positive
    if it has a window that such documents hold far more often, in so many of them and after so many different words
    that chance is ruled out (neither copies of a document nor its repetitions add to both); the window stands for it.
    The strong machine takes windows that (almost) only toxic documents hold as positive, the weak one all that they
    hold unduly often or that begin like one. Each separates all of these from the negative windows by their kernel
    values with the landmarks (Nystrom). It starts with `working` negative windows, frequent ones and others; whatever
    window of the sample then lies on the wrong side joins them, `working` / 2 at a time, the worst first, until none
    does that isn't among them. A document's odds are logistic in its margins (see Margins): one strong window, or
    several weak ones, are toxic.
    """
    spark = docs.sparkSession
    given = labels.filter("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    given = given.filter(~_held()).orderBy(F.xxhash64("doc_id")).limit(max_docs).selectExpr("doc_id label_id", "int(toxic = 1) toxic")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    # max_docs ids of 12 bytes; of rows that repeat one, the smallest text stands for all.
    rows = rows.join(F.broadcast(given), F.col("doc_id") == F.col("label_id")).groupBy("label_id").agg(F.max("toxic").alias("toxic"), F.min("text").alias("text"))
    rows = stored(rows.select("toxic", "text"), "labelled")

    def words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for y, t in zip(b.column("toxic").to_pylist(), b.column("text").to_pylist(), strict=True):
                split, met = ["", *(t or "").split()], set()
                for i in range(0, max(1, len(split) - 1), 20_000):  # of a very long text a part at a time
                    part = split[i : i + 20_001]
                    own = {(w, crc32(p.encode("utf-8", "replace"))) for p, x in set(zip(part, part[1:], strict=False)) for w in windows(x)}
                    own = [*own, *{(f"{w[:k]}*", c) for w, c in own for k in range(4, min(7, len(w)))}]
                    first = {w: k for k, (w, _) in enumerate(own)}
                    once = pa.array([int(first[w] == k and w not in met) for k, (w, _) in enumerate(own)], pa.int32())
                    met.update(first)
                    yield pa.record_batch([pa.array([w for w, _ in own], pa.string()), pa.array([c for _, c in own], pa.int64()), pa.array([y] * len(own), pa.int32()), once], names=["word", "after", "y", "once"])

    met = rows.mapInArrow(words, "word string, after long, y int, once int").groupBy("word", "after")
    met = met.agg(F.max("y").alias("y"), F.min("y").alias("least"), F.sum(F.col("once") * F.col("y")).alias("docs"))
    both = stored(met.groupBy("word").agg(F.least(F.sum("y"), F.sum("docs")).alias("pos"), F.sum(F.lit(1) - F.col("least")).alias("neg")), "windows")
    seen = both.filter("not endswith(word, '*')")
    n, toxic = rows.agg(F.count("*"), F.coalesce(F.sum("toxic"), F.lit(0))).first()
    if not toxic or toxic == n:
        return [], np.array([0.0] * 3 + [9.0 if toxic else -8.0])
    share = toxic / n
    need = (math.log10(both.count() + 1) + 1) / -math.log10(share)
    total = F.col("pos") + F.col("neg")
    fair = seen.filter((F.col("pos") <= 1.5 * share * total) | ((F.col("pos") <= 0.2 * total) & (total > 4)))
    start = [r.word for r in fair.orderBy(F.desc(total), "word").limit(working // 2).collect()]
    start += [r.word for r in fair.orderBy(F.xxhash64("word")).limit(working // 2).collect()]
    kernel, machines = Kernel(), []
    for purity in (0.98, max(0.4, min(0.9, 3 * share))):
        top = both.filter((F.col("pos") >= need) & (F.col("pos") >= purity * total))
        found = top.filter("not endswith(word, '*')").select("word", "pos")
        if machines:
            stems = top.filter("endswith(word, '*')").select(F.expr("trim(TRAILING '*' FROM word)").alias("stem"))
            begun = seen.filter(F.col("pos") >= purity * total).select("word", "pos", F.explode(F.expr("transform(sequence(4, 6), k -> left(word, k))")).alias("stem")).join(stems, "stem", "left_semi")
            found = found.unionByName(begun.select("word", "pos")).distinct()
        bad = [r.word for r in found.orderBy(F.desc("pos"), "word").collect()]  # evidence from the bounded sample alone
        good = [w for w in dict.fromkeys(start) if w not in set(bad)]
        if not bad or not good:
            machines.append((np.zeros(DIMS), NONE))
            continue
        while True:
            machine = fit(kernel, bad, good, landmarks)
            model, have = spark.sparkContext.broadcast(machine), spark.sparkContext.broadcast({*bad, *good})

            def wrong(batches: Iterator[pa.RecordBatch], model=model, have=have) -> Iterator[pa.RecordBatch]:
                own = Kernel()
                for b in batches:
                    words = [w for w in b.column("word").to_pylist() if w not in have.value]
                    z = own.project(words, [model.value])[0] if words else np.zeros(0)
                    yield pa.record_batch([pa.array(words, pa.string()), pa.array(z)], names=["word", "z"]).filter(pa.array(z > WRONG))

            worst = [r.word for r in fair.select("word").mapInArrow(wrong, "word string, z double").orderBy(F.desc("z"), "word").limit(working // 2).collect()]
            if not worst:
                break
            good += worst[::-1]
        machines.append(machine)
    z = _margins(rows.selectExpr("cast(toxic as long) toxic", "text"), spark.sparkContext.broadcast(machines), T.StructType().add("toxic", "long"), ["toxic"]).toArrow()
    return machines, logistic(np.array(z.column("z").to_pylist()), z.column("toxic").to_numpy().astype(float))


def score(docs: DataFrame, labels: DataFrame, max_docs: int = 8000, keep: Sequence[str] = ()) -> DataFrame:
    """doc_id, held_out, score (0 to 1) and predicted of every whole text of docs (doc_id, text), and its columns to keep.

    Learns from at most max_docs labelled documents whose crc32(doc_id) mod 5 is not 0 (a stated bound on the sample);
    only texts are inputs. A null, empty or blank text has the lowest margin; a very long one is judged whole, word by
    word; a null doc_id is scored and stays null; repeated rows are scored each; without labels of both kinds the score
    is constant; an empty table gives no rows. Null labels are left out, of repeated ones the larger holds, other
    columns are ignored. Words of fewer than 3 letters are never judged by themselves, and a word split by blanks is
    put together only if split in single letters: "id iot" is judged by its pieces.
    """
    bounded_batches(docs.sparkSession)
    machines, w = train(docs, labels, max_docs)
    keep = ["doc_id", "held_out", *(c for c in keep if c not in ("doc_id", "held_out"))]
    rows = docs.withColumns({"doc_id": F.col("doc_id").cast("long"), "text": F.col("text").cast("string"), "held_out": _held()}).select(*dict.fromkeys([*keep, "text"]))
    if not machines:
        p = F.lit(1 / (1 + math.exp(-w[-1])))
        return rows.select(*keep, p.alias("score"), (p >= 0.5).cast("int").alias("predicted"))
    z = _margins(rows, docs.sparkSession.sparkContext.broadcast(machines), T.StructType([rows.schema[c] for c in keep]), keep)
    odds = sum((F.col("z")[k] * float(x) for k, x in enumerate(w[:-1])), F.lit(float(w[-1])))
    return z.select(*keep, (1 / (1 + F.exp(-odds))).alias("score")).withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
