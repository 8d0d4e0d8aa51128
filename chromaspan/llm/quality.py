"""Document quality by co-training of a text-content view and a page-metadata view."""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import bounded_batches, stored
from .toxicity import logistic

BINS, BUCKETS = 8, 32
SHAPE, NAMES, META = 16, 2, 3  # numbers of a text's shape; names and columns of the record
GRAMS = 1 << 14  # buckets of hashed words, and of hashed pairs of words
ROW = "y double, hash long, shape binary, grams binary, meta binary"


def shape(text: bytes, words: list[bytes], distinct: int, same: int) -> list[float]:
    """What a text looks like: shares of kinds of characters, of repeated words, and word lengths."""
    n = max(1, len(text))
    h = np.bincount(np.frombuffer(text, np.uint8), minlength=256)
    upper, lower, digit, blank = h[65:91].sum(), h[97:123].sum(), h[48:58].sum(), h[[32, 9, 10, 11, 12, 13]].sum()
    m = max(1, len(words))
    size = np.fromiter(map(len, words), np.int64, len(words))
    marks = h[[33, 36, 37, 38, 42, 35]].sum()
    return [
        upper / max(1, upper + lower), lower / n, digit / n, blank / n, h[128:].sum() / n, h[33] / m, marks / m, h[124] / m, (h[46] + h[44]) / m, (h[60] + h[62] + h[123] + h[125]) / m,
        distinct / m, same / m, float(size.mean()) if len(words) else 0.0, float(size.std()) if len(words) else 0.0, float((size <= 3).mean()) if len(words) else 0.0, float(np.log1p(len(words))),
    ]


class Grams:
    """The hashed words and pairs of words that a text holds: ascending numbers below 2 * GRAMS; the number of
    different words, and of words that repeat the one before."""

    def __init__(self, cache_words: int = 400_000):
        self.known: dict[bytes, int] = {}
        self.cache_words = cache_words

    def of(self, words: list[bytes]) -> tuple[np.ndarray, int, int]:
        own = set(words)
        missing = own.difference(self.known)
        if len(self.known) + len(missing) > self.cache_words:
            self.known, missing = {}, own
        self.known.update((w, zlib.crc32(w)) for w in missing)
        h = np.fromiter(map(self.known.__getitem__, words), np.uint32, len(words))
        for w in missing:
            if len(w) >= 256:  # the cache is bounded in bytes, too
                del self.known[w]
        pair = (h[:-1] * np.uint32(0x9E3779B1)) ^ h[1:]
        pair ^= pair >> np.uint32(15)
        found = np.concatenate([h % GRAMS, pair % GRAMS + np.uint32(GRAMS)]).astype(np.uint16)
        return np.unique(found), len(own), int((h[1:] == h[:-1]).sum())


def meta_view(lang: str | None, source: str | None, n_chars: int | None) -> list[float]:
    """What the page's record says, without its text: language and source (hashed) and the stated length (null: -1)."""
    name = lambda x: -1.0 if x is None else float(zlib.crc32(str(x).encode()) % BUCKETS)
    return [name(lang), name(source), -1.0 if n_chars is None else float(np.log1p(max(0, n_chars)))]


@dataclass
class Rows:
    """Rows of one view: numbers (the first of them hashed names) and, for texts, the grams of each."""

    x: np.ndarray
    grams: list[np.ndarray] | None = None

    def __add__(self, other: Rows) -> Rows:
        return Rows(np.concatenate([self.x, other.x]), None if self.grams is None else self.grams + other.grams)

    def pick(self, at: np.ndarray) -> Rows:
        return Rows(self.x[at], None if self.grams is None else [self.grams[i] for i in at])


def minimise(f: Callable, w: np.ndarray, steps: int = 60, memory: int = 8) -> np.ndarray:
    """The minimum of a smooth convex f, which returns its value and gradient, by limited-memory BFGS."""
    value, g = f(w)
    past: list[tuple[np.ndarray, np.ndarray, float]] = []
    for _ in range(steps):
        d, alphas = -g, []
        for s, y, r in reversed(past):
            alphas.append(a := r * (s @ d))
            d = d - a * y
        if past:
            s, y, r = past[-1]
            d = d / (r * (y @ y))
        for (s, y, r), a in zip(past, reversed(alphas), strict=True):
            d = d + s * (a - r * (y @ d))
        step, slope = 1.0 if past else min(1.0, 1 / max(1e-12, np.abs(g).sum())), g @ d
        while True:
            new, ng = f(w + step * d)
            if new <= value + 1e-4 * step * slope or step < 1e-8:
                break
            step /= 2
        s, y = step * d, ng - g
        done = value - new < 1e-6 * max(1.0, abs(value))
        w, value, g = w + s, new, ng
        if done:
            break
        if s @ y > 1e-12:
            past = [*past, (s, y, 1 / (s @ y))][-memory:]
    return w


class View:
    """A logistic model over binned numbers, hashed names and, for texts, hashed words and pairs of words."""

    def __init__(self, names: int, numbers: int):
        self.names, self.numbers, self.w, self.scale = names, numbers, None, (1.0, 0.0)

    def cuts(self, rows: Rows) -> None:
        self.edges = [np.unique(np.quantile(c, np.arange(1, BINS) / BINS)) for c in rows.x[:, self.names :].T]
        self.width = self.names * (BUCKETS + 1) + self.numbers * BINS + 1

    def design(self, rows: Rows) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The sparse design matrix: of each element its row, column and value."""
        x, n = rows.x, len(rows.x)
        cols = [k * (BUCKETS + 1) + 1 + x[:, k].astype(np.int64) for k in range(self.names)]
        at = self.names * (BUCKETS + 1)
        cols += [at + k * BINS + np.searchsorted(e, c, side="right") for k, (e, c) in enumerate(zip(self.edges, x[:, self.names :].T, strict=True))]
        cols.append(np.full(n, self.width - 1))
        who, what, v = np.tile(np.arange(n), len(cols)), np.concatenate(cols), np.ones(n * len(cols))
        if rows.grams is not None:
            size = np.array([len(g) for g in rows.grams], np.int64)
            who = np.concatenate([who, np.repeat(np.arange(n), size)])
            what = np.concatenate([what, *(g.astype(np.int64) + self.width for g in rows.grams)])
            v = np.concatenate([v, np.repeat(2 / np.sqrt(np.maximum(size, 1)), size)])
        return who, what, v

    def blocks(self, rows: Rows, most: int = 200_000) -> Iterator[tuple[slice, tuple[np.ndarray, np.ndarray, np.ndarray]]]:
        """Stretches of rows of about `most` elements each, and their design matrices: no more of it is laid out at once."""
        size = np.full(len(rows.x), rows.x.shape[1] + 1) + (0 if rows.grams is None else np.array([len(g) for g in rows.grams], np.int64))
        of = (np.cumsum(size) - size) // most
        cut = [0, *(np.flatnonzero(np.diff(of)) + 1).tolist(), len(rows.x)]
        for u, v in zip(cut, cut[1:], strict=False):
            yield slice(u, v), self.design(Rows(rows.x[u:v], None if rows.grams is None else rows.grams[u:v]))

    def fit(self, rows: Rows, y: np.ndarray) -> None:
        size = self.width + (0 if rows.grams is None else 2 * GRAMS)

        def loss(w: np.ndarray) -> tuple[float, np.ndarray]:
            z, slope = np.zeros(len(y)), np.zeros(size)
            for at, (who, what, v) in self.blocks(rows):
                z[at] = np.bincount(who, w[what] * v, at.stop - at.start)
                p = 1 / (1 + np.exp(-np.clip(z[at], -30, 30)))
                np.add.at(slope, what, v * (p - y[at])[who])
            return float(np.logaddexp(0, z).sum() - z @ y + w @ w / 2), slope + w

        self.w = minimise(loss, np.zeros(size) if self.w is None else self.w)

    def margin(self, rows: Rows) -> np.ndarray:
        return np.concatenate([np.zeros(0), *(np.bincount(who, self.w[what] * v, at.stop - at.start) for at, (who, what, v) in self.blocks(rows))])

    def calibrate(self, rows: Rows, y: np.ndarray) -> None:
        self.scale = logistic(self.margin(rows), y)

    def logit(self, rows: Rows) -> np.ndarray:
        return np.clip(self.margin(rows) * self.scale[0] + self.scale[1], -12, 12)


def co_train(seed: list[Rows], y: np.ndarray, sure_rows: Callable, rounds: int = 3, sure: float = 0.98) -> tuple[list[View], np.ndarray]:
    """Two views, text and metadata, and weights of their logits and of 1.

    A fourth of each kind of labelled rows calibrates (all do, if a kind has too few); the views learn from the rest
    and, round by round, from rows without labels of which the other view is `sure`. sure_rows(views, limit) returns
    these: for each view and label (1, 0) the rows of both views, at most so many, each row once over all rounds.
    """
    hold = np.zeros(len(y), bool)
    for label in (0, 1):
        hold[np.flatnonzero(y == label)[3::4]] = True
    fits, tests = (np.flatnonzero(~hold), np.flatnonzero(hold)) if len(set(y[hold])) == 2 else (np.arange(len(y)),) * 2
    views = [View(0, SHAPE), View(NAMES, META - NAMES)]
    learn = [(r.pick(fits), y[fits]) for r in seed]
    for v, r in zip(views, seed, strict=True):
        v.cuts(r)
    for turn in range(rounds + 1):
        for v, (r, t), s in zip(views, learn, seed, strict=True):
            v.fit(r, t)
            v.calibrate(s.pick(tests), y[tests])
        if turn == rounds:
            break
        found = sure_rows(views, float(np.log(sure / (1 - sure))))
        for k, label, rows in found:
            r, t = learn[1 - k]
            learn[1 - k] = (r + rows[1 - k], np.append(t, np.full(len(rows[0].x), float(label))))
        if not any(len(rows[0].x) for *_, rows in found):
            break
    # Together: logistic regression over the calibrated logits, with a penalty towards the text's alone.
    d = np.stack([*(v.logit(r.pick(tests)) for v, r in zip(views, seed, strict=True)), np.ones(len(tests))], 1)
    start = np.array([1.0, 0.0, 0.0])

    def loss(w: np.ndarray) -> tuple[float, np.ndarray]:
        z = d @ w
        p = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
        return float(np.logaddexp(0, z).sum() - z @ y[tests] + 0.05 * ((w - start) ** 2).sum()), d.T @ (p - y[tests]) + 0.1 * (w - start)

    return views, minimise(loss, start)


def _held():
    return F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(5)), F.lit(-1)) == 0


def _record(docs: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """The columns used, those of the metadata that docs lacks null; and those to keep."""
    get = lambda c, t: (F.col(c) if c in docs.columns else F.lit(None)).cast(t).alias(c)
    used = {"doc_id": "long", "text": "binary", "lang": "string", "source": "string", "n_chars": "long"}
    return docs.select(*(get(c, t) for c, t in used.items()), *(c for c in keep if c not in used))


def _features(b: pa.RecordBatch, grams: Grams) -> list[Rows]:
    """The text view's and the metadata view's rows."""
    looks, words = [], []
    for t in b.column("text").to_pylist():
        w = (t or b"").lower().split()
        found, distinct, same = grams.of(w)
        looks.append(shape(t or b"", w, distinct, same))
        words.append(found)
    meta = [meta_view(*x) for x in zip(*(b.column(c).to_pylist() for c in ("lang", "source", "n_chars")), strict=True)]
    return [Rows(np.array(looks).reshape(-1, SHAPE), words), Rows(np.array(meta).reshape(-1, META))]


def _packed(rows: list[Rows], y: pa.Array, h: pa.Array) -> pa.RecordBatch:
    text, meta = rows
    cols = [[x.tobytes() for x in part] for part in (text.x, text.grams, meta.x)]
    return pa.record_batch([y, h, *(pa.array(c, pa.binary()) for c in cols)], names=["y", "hash", "shape", "grams", "meta"])


def _unpacked(t: pa.Table | pa.RecordBatch) -> list[Rows]:
    of = lambda c, n: np.frombuffer(b"".join(t.column(c).to_pylist()), np.float64).reshape(-1, n)
    return [Rows(of("shape", SHAPE), [np.frombuffer(x, np.uint16) for x in t.column("grams").to_pylist()]), Rows(of("meta", META))]


def train(rows: DataFrame, labels: DataFrame, max_docs: int, per_round: int) -> tuple[list[View], np.ndarray] | None:
    """The co-trained views and their weights; None without labels of both kinds. rows: as _record returns them."""
    spark = rows.sparkSession
    given = labels.filter("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.min("quality").alias("quality")).filter(~_held())
    given = given.orderBy(F.xxhash64("doc_id")).limit(max_docs).selectExpr("doc_id label_id", "double(quality > 0) y")
    open_ = rows.filter(~_held()).join(F.broadcast(stored(given, "wanted")), F.col("doc_id") == F.col("label_id"), "left")  # max_docs ids

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grams = Grams()
        for b in batches:
            yield _packed(_features(b, grams), b.column("y"), b.column("hash"))

    hashed = open_.withColumn("hash", F.xxhash64("doc_id", "text")).select("text", "lang", "source", "n_chars", "y", "hash", "label_id")
    first = F.min(F.struct("hash", "text", "lang", "source", "n_chars", "y")).alias("r")  # of rows that repeat a labelled id, one
    known = hashed.filter("label_id is not null").groupBy("label_id").agg(first).select("r.*").mapInArrow(features, ROW).toArrow()  # max_docs rows
    known = known.sort_by("hash")
    y = known.column("y").to_numpy()
    if len(set(y)) < 2:
        return None
    pool = stored(hashed.filter("label_id is null").mapInArrow(features, ROW), "pool")
    taken: set[int] = set()

    def sure_rows(views: list[View], limit: float) -> list[tuple]:
        model = spark.sparkContext.broadcast((views, taken))

        def surest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            """A task's per_round surest rows of each kind: all that may be among the per_round of all tasks."""
            views, out = model.value[0], {}
            for b in batches:
                rows, h = _unpacked(b), b.column("hash").to_numpy()
                for k, (v, r) in enumerate(zip(views, rows, strict=True)):
                    z = v.logit(r) if len(h) else np.zeros(0)
                    for label, s in ((1, z), (0, -z)):
                        best = out.setdefault((k, label), {})
                        for i in np.flatnonzero(s >= limit)[np.argsort(-s[s >= limit], kind="stable")]:
                            if len(best) >= 2 * per_round:
                                best = out[k, label] = dict(sorted(best.items(), key=lambda x: (-x[1][0], x[0]))[:per_round])
                                if s[i] < min(x[0] for x in best.values()):
                                    break
                            if int(h[i]) not in model.value[1]:
                                best[int(h[i])] = (float(s[i]), b.slice(i, 1))
            for (k, label), best in out.items():
                for h, (z, row) in sorted(best.items(), key=lambda x: (-x[1][0], x[0]))[:per_round]:
                    extra = [pa.array([2 * k + label], pa.int32()), pa.array([z])]
                    yield pa.record_batch([*extra, *row.columns], names=["kind", "z", *row.schema.names])

        best = stored(pool.mapInArrow(surest, f"kind int, z double, {ROW}"), "sure")
        out = []
        for k in (0, 1):
            for label in (1, 0):
                some = best.filter(F.col("kind") == 2 * k + label).dropDuplicates(["hash"]).orderBy(F.desc("z"), "hash").limit(per_round).toArrow()
                some = some.filter(pa.array([h not in taken for h in some.column("hash").to_pylist()], pa.bool_()))  # another kind's
                taken.update(some.column("hash").to_pylist())
                out.append((k, label, _unpacked(some)))
        return out

    return co_train(_unpacked(known), y, sure_rows)


def score(docs: DataFrame, labels: DataFrame, max_docs: int = 8000, per_round: int = 300, threshold: float = 0.5, keep: Sequence[str] = ()) -> DataFrame:
    """doc_id, held_out, score (that quality is 1), predicted and kept of every row of docs (doc_id, text, lang, source, n_chars), and its columns to keep.

    Learns from at most max_docs labelled rows whose crc32(doc_id) mod 5 is not 0 (a stated bound on the sample). The
    text view sees the text alone (hashed words and pairs of words, and its shape), the metadata view the record alone
    (lang, source, n_chars). In each round every other row that isn't held out is looked at, whatever its labels, and
    the per_round rows that a view is surest of, of either kind, teach the other view. All documents are scored over
    their whole texts, each by one task.

    A null text is empty, null or missing metadata has a bin of its own, a null doc_id is scored and stays null;
    repeated rows are scored each, but learnt from once: of rows that repeat a labelled id one is taken, of unlabelled
    rows with the same id and text too. An empty table gives no rows. Without labels of both kinds no model can be
    fitted: all rows score 1 and are kept.
    """
    bounded_batches(docs.sparkSession)
    made = ["doc_id", "held_out", "score", "predicted", "kept"]
    keep = [c for c in keep if c not in made]
    rows = _record(docs, keep)
    fitted = train(_record(docs), labels, max_docs, per_round)
    rows = rows.withColumn("held_out", _held()).withColumn("text", F.col("text").cast("binary"))
    types = {**{f.name: f for f in rows.schema.fields}, **({"text": T.StructField("text", T.StringType())} if "text" in keep else {})}
    schema = T.StructType([types[c] for c in ("doc_id", "held_out", *keep)]).add("score", "double")
    if fitted is None:
        scored = rows.withColumn("text", F.col("text").cast("string")).select("doc_id", "held_out", *keep, F.lit(1.0).alias("score"))
    else:
        model = docs.sparkSession.sparkContext.broadcast(fitted)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            (views, w), grams = model.value, Grams()
            for b in batches:
                z = sum(c * v.logit(r) for c, v, r in zip(w, views, _features(b, grams), strict=False)) + w[2]
                cols = [b.column(c).cast(pa.string()) if c == "text" else b.column(c) for c in ("doc_id", "held_out", *keep)]
                yield pa.record_batch([*cols, pa.array(1 / (1 + np.exp(-np.clip(z, -30, 30))))], names=schema.names)

        scored = rows.mapInArrow(run, schema)
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int")).withColumn("kept", F.col("score") >= threshold)
