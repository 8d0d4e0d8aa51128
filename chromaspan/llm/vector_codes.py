"""Vectors as codes of their parts: product quantisation with Hamerly's bounds, in whole numbers."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, remove, scratch, stored

#: values: whole components (32 bits); code: an entry for each part (8 bits); upper, lower: bounds for each part (32-bit floats); scans: parts that were scanned in full.
STATE = "vec_id long, label int, values binary, code binary, upper binary, lower binary, error long, scans int"


def _bounds(upper: np.ndarray, lower: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """32-bit floats that are surely no less than upper and no more than lower."""
    return np.nextafter(upper.astype(np.float32), np.float32(np.inf)), np.maximum(np.nextafter(lower.astype(np.float32), np.float32(-np.inf)), 0)


def scan(x: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The nearest entry of a book for each row of x (ties to the lower index), its squared distance, and the second-least one."""
    d = np.zeros((len(x), len(book)), np.int64)
    for k in range(x.shape[1]):
        d += (x[:, k, None] - book[None, :, k]) ** 2
    best = d.argmin(axis=1)
    own = np.take_along_axis(d, best[:, None], 1)[:, 0]
    if len(book) == 1:
        return best, own, np.full(len(x), np.iinfo(np.int64).max)
    np.put_along_axis(d, best[:, None], np.iinfo(np.int64).max, 1)
    return best, own, d.min(axis=1)


class Assignment:
    """One round's assignment of parts to the entries of their books (parts, entries, components), by bounds that
    outlive the change from the books of the round before.

    An entry that moved by s is at most s further away and at least s closer. So the upper bound of a part's own entry
    grows by what that moved, the lower bound of all others sinks by what the furthest of them moved, and half the way
    from its own entry to the next one is a lower bound, too. A part whose upper bound is strictly below, perhaps after
    it was measured, has no other entry as near; all others are scanned in full, so ties go to the lower index.
    """

    def __init__(self, books: np.ndarray, earlier: np.ndarray | None):
        self.books = books
        parts, entries, _ = books.shape
        moved = np.zeros((parts, entries)) if earlier is None else np.sqrt(((books - earlier).astype(float) ** 2).sum(axis=2))
        self.moved = moved * (1 + 1e-9)
        furthest = self.moved.argmax(axis=1)
        rest = self.moved.copy()
        rest[np.arange(parts), furthest] = 0
        #: The most that an entry other than e moved: that of the furthest, but for itself the next one's.
        self.others = np.repeat(self.moved.max(axis=1)[:, None], entries, 1)
        self.others[np.arange(parts), furthest] = rest.max(axis=1)
        self.half = np.full((parts, entries), np.inf)
        if entries > 1:
            for p in range(parts):
                gaps = np.sqrt(((books[p][:, None] - books[p][None]).astype(float) ** 2).sum(axis=2))
                np.fill_diagonal(gaps, np.inf)
                self.half[p] = gaps.min(axis=1) / 2 * (1 - 1e-9)

    def assign(self, values: np.ndarray, code: np.ndarray | None, upper: np.ndarray | None, lower: np.ndarray | None):
        """code, upper, lower, squared distances (known where asked for) and the number of parts scanned, by vector."""
        n, (parts, _, width) = len(values), self.books.shape
        x = values.reshape(n, parts, width)
        out = np.zeros((n, parts), np.uint8) if code is None else code.copy()
        up, low, scans = np.zeros((n, parts)), np.zeros((n, parts)), np.zeros(n, np.int32)
        for p in range(parts):
            ask = np.arange(n)
            if code is not None:
                own = code[:, p]
                up[:, p] = upper[:, p] + self.moved[p][own]
                low[:, p] = np.maximum(lower[:, p] - self.others[p][own], self.half[p][own])
                ask = np.flatnonzero(up[:, p] >= low[:, p])
                up[ask, p] = np.sqrt(((x[ask, p] - self.books[p][own[ask]]) ** 2).sum(axis=1)) * (1 + 1e-9)
                ask = ask[up[ask, p] >= low[ask, p]]
            for at in range(0, len(ask), 4096):
                rows = ask[at : at + 4096]
                best, first, second = scan(x[rows, p], self.books[p])
                out[rows, p], up[rows, p], low[rows, p] = best, np.sqrt(first) * (1 + 1e-9), np.sqrt(second) * (1 - 1e-9)
                scans[rows] += 1
        return out, *_bounds(up, low), scans

    def errors(self, values: np.ndarray, code: np.ndarray) -> np.ndarray:
        """Squared distances to the entries, summed over parts."""
        x, (parts, _, width) = values.reshape(len(values), *self.books.shape[::2]), self.books.shape
        return ((x - self.books[np.arange(parts), code.astype(np.int64)].reshape(len(values), parts, width)) ** 2).sum(axis=(1, 2))


def _matrix(column: pa.Array, kind: str, n: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), kind).reshape(n, -1)


def _rows(a: np.ndarray) -> pa.Array:
    return pa.array([r.tobytes() for r in a], pa.binary())


def _assigned(state: DataFrame, books: np.ndarray, earlier: np.ndarray | None, with_error: bool) -> DataFrame:
    """state after a round; in the first one (earlier: none) every part is scanned."""
    shared = state.sparkSession.sparkContext.broadcast((books, earlier))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        books, earlier = shared.value
        rounds = Assignment(books, earlier)
        for b in batches:
            n = b.num_rows
            if not n:
                continue
            values = _matrix(b.column("values"), "<i4", n).astype(np.int64)
            known = (None, None, None) if earlier is None else (_matrix(b.column("code"), "u1", n), _matrix(b.column("upper"), "<f4", n).astype(float), _matrix(b.column("lower"), "<f4", n).astype(float))
            code, upper, lower, scans = rounds.assign(values, *known)
            error = pa.array(rounds.errors(values, code), pa.int64()) if with_error else pa.nulls(n, pa.int64())
            yield pa.record_batch([b.column("vec_id"), b.column("label"), b.column("values"), _rows(code), _rows(upper), _rows(lower), error, pa.array(scans)], names=["vec_id", "label", "values", "code", "upper", "lower", "error", "scans"])

    return state.mapInArrow(run, STATE)


def _moved(state: DataFrame, books: np.ndarray) -> np.ndarray:
    """The books with each entry at the floor of its parts' mean; unused ones stay. A task hands on a sum for each component of the books, and so does the whole of them to the driver."""
    parts, entries, width = books.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, count = np.zeros((parts * entries, width), np.int64), np.zeros(parts * entries, np.int64)
        for b in batches:
            n = b.num_rows
            if n:
                cell = (_matrix(b.column("code"), "u1", n).astype(np.int64) + np.arange(parts) * entries).ravel()
                np.add.at(total, cell, _matrix(b.column("values"), "<i4", n).astype(np.int64).reshape(-1, width))
                count += np.bincount(cell, minlength=parts * entries)
        used = np.flatnonzero(count)
        cells = np.repeat(used, width)
        yield pa.record_batch([pa.array(cells, pa.int32()), pa.array(np.tile(np.arange(width), len(used)), pa.int32()), pa.array(total[used].ravel()), pa.array(np.repeat(count[used], width))], names=["cell", "component", "total", "n"])

    sums = state.select("code", "values").mapInArrow(run, "cell int, component int, total long, n long").groupBy("cell", "component").agg(F.sum("total").alias("total"), F.sum("n").alias("n"))
    out = books.reshape(parts * entries, width).copy()
    for r in sums.collect():
        out[r.cell, r.component] = r.total // r.n
    return out.reshape(books.shape)


def kept_vectors(vectors: DataFrame) -> tuple[DataFrame, int]:
    """(vec_id, label, v): rows whose vector holds finite numbers only, and how many it holds.

    Of vectors of several lengths those of the most frequent one stay; of equally frequent ones the longest.
    """
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    label = F.col("label").cast("int") if "label" in vectors.columns else F.lit(None).cast("int")
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), label.alias("label"), F.col("embedding").cast("array<double>").alias("v"))
    rows = rows.filter(F.col("v").isNotNull() & finite & (F.size("v") > 0))
    most = rows.groupBy(F.size("v").alias("size")).count().orderBy(F.desc("count"), F.desc("size")).first()
    size = most["size"] if most else 0
    return rows.filter(F.size("v") == size), size


def _whole(v: np.ndarray, scale: int) -> np.ndarray:
    """floor(scale * component). The sum of all squared differences of two vectors must fit 64 bits; beyond that it raises."""
    v = np.floor(v * scale)
    most = min(2**31 - 1, int((2**62 / max(v.shape[-1], 1)) ** 0.5) // 2)
    if np.abs(v).max(initial=0) > most:
        raise ValueError(f"a component is beyond {most / scale}")
    return v.astype(np.int64)


def _values(rows: DataFrame, scale: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if n := b.num_rows:
                v = _whole(b.column("v").flatten().to_numpy(zero_copy_only=False).reshape(n, -1), scale)
                yield pa.record_batch([b.column("vec_id"), b.column("label"), _rows(v.astype("<i4"))], names=["vec_id", "label", "values"])

    return rows.mapInArrow(run, "vec_id long, label int, values binary")


def compress(vectors: DataFrame, parts: int = 16, entries: int = 64, rounds: int = 2, scale: int = 256) -> DataFrame:
    """Codes of vectors (vec_id, embedding, label; other columns are ignored) by books trained on all of them.

    A part's book begins as that part of the `entries` smallest vec_ids' vectors (nulls last; of rows with one vec_id the
    smaller vector first). In each round every part goes to its nearest entry by squared distance, ties to the lower
    index, and an entry to the floor of its parts' mean; at last parts are assigned again. Returns vec_id, code (two hex
    digits a part), error (the squared distance), label_error (its sum over the label; nulls are a label),
    codebooks_sha256 (of all components in decimal, joined by commas) and scans (of the parts in the last assignment,
    how many were scanned in full).

    A vector that is null or empty, holds a null or non-finite component or hasn't the table's length (see kept_vectors)
    has no row; a length that the parts don't divide raises, as do components beyond 30 bits or so; repeated rows have a
    row each, with fewer vectors than entries each is an entry, and an empty table gives no rows. Vectors are never
    shuffled: between rounds each row's code and bounds are written to the shared folder beside its values, and of the
    rest only sums by entry move.
    """
    spark = vectors.sparkSession
    bounded_batches(spark)
    kept, size = kept_vectors(vectors)
    if not size:
        return spark.createDataFrame([], "vec_id long, code string, error long, label_error long, codebooks_sha256 string, scans int")
    if size % parts:
        raise ValueError(f"vectors of {size} components have no {parts} equal parts")
    first = [r.v for r in kept.orderBy(F.asc_nulls_last("vec_id"), "v").limit(entries).select("v").collect()]
    books = _whole(np.array(first), scale).reshape(len(first), parts, -1).transpose(1, 0, 2)
    earlier, state, path = None, _values(kept, scale), None
    for _ in range(rounds):
        assigned, old = _assigned(state, books, earlier, False), path
        path = scratch(spark, "codes")
        assigned.write.parquet(path)
        state = spark.read.schema(STATE).parquet(path)
        if old:
            remove(spark, old)
        books, earlier = _moved(state, books), books
    last = stored(_assigned(state, books, earlier, True).select("vec_id", "label", F.lower(F.hex("code")).alias("code"), "error", "scans"), "codes")
    if path:
        remove(spark, path)
    digest = hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()
    sums = last.groupBy(F.col("label").alias("of")).agg(F.sum("error").alias("label_error"))
    return last.join(sums, F.col("label").eqNullSafe(F.col("of"))).select("vec_id", "code", "error", "label_error", F.lit(digest).alias("codebooks_sha256"), "scans")
