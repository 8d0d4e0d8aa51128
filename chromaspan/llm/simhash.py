"""SimHash near-duplicates by BK-trees."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import bounded_batches, connected_components, stored

BITS = 64


def fingerprint(text: bytes, words: int = 4, seed: int = 42, block: int = 20_000) -> int:
    """The bits set in over half of the hashes of all shingles of the text."""
    from xxhash import xxh64_intdigest

    w = text.lower().split()  # of bytes: A-Z, and blanks as in [\x20\x09-\x0D]
    if not w:
        return 0
    n = max(1, len(w) - words + 1)
    ones = np.zeros(BITS, np.int64)
    for i in range(0, n, block):
        h = np.array([xxh64_intdigest(b" ".join(w[k : k + words]), seed) for k in range(i, min(n, i + block))], np.uint64)
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(ones * 2 > n, bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, words: int = 4, keep: Sequence[str] = ()) -> DataFrame:
    """doc_id and fp (the 64 bits as a signed long) of every whole text of docs (doc_id, text), and its other columns to keep."""
    bounded_batches(docs.sparkSession)
    keep = [c for c in keep if c not in ("doc_id", "text", "fp")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = np.array([fingerprint(t or b"", words) for t in b.column("text").to_pylist()], np.uint64)
            yield pa.record_batch([b.column("doc_id"), pa.array(fp.view(np.int64)), *map(b.column, keep)], names=["doc_id", "fp", *keep])

    rows = docs.withColumns({"doc_id": F.col("doc_id").cast("long"), "text": F.col("text").cast("binary")}).select("doc_id", "text", *keep)
    return rows.mapInArrow(run, T.StructType([*T.StructType().add("doc_id", "long").add("fp", "long").fields, *(rows.schema[c] for c in keep)]))


class BKForest:
    """BK-trees over many shards at once: a child's edge is its Hamming distance to its parent.

    All trees grow level by level with array operations. What lies below an edge is exactly that far from the parent,
    so a subtree on an edge within the radius is linked to its parent as a whole.
    """

    def __init__(self, shard: np.ndarray, fp: np.ndarray, radius: int):
        """shard: ascending shard numbers; fp: uint64, distinct in a shard."""
        n = len(fp)
        self.fp, self.radius = fp, radius
        self.parent, self.edge = np.full(n, -1, np.int64), np.zeros(n, np.int64)
        self.root = np.searchsorted(shard, shard)  # the first of each shard
        self.label = np.arange(n)
        todo, under, levels = np.arange(n), self.root.copy(), []
        new = todo[self.root == todo]
        keep = self.root != todo
        todo, under = todo[keep], under[keep]
        while len(todo):
            levels.append(new)
            d = np.bitwise_count(fp[todo] ^ fp[under]).astype(np.int64)
            order = np.lexsort((todo, d, under))
            todo, under, d = todo[order], under[order], d[order]
            first = np.ones(len(todo), bool)
            first[1:] = (under[1:] != under[:-1]) | (d[1:] != d[:-1])
            lead = todo[np.flatnonzero(first)[np.cumsum(first) - 1]]
            new = todo[first]
            self.parent[new], self.edge[new] = under[first], d[first]
            todo, under = todo[~first], lead[~first]
        levels.append(new)
        self.levels = levels
        # Children of a node lie together, by edge.
        kids = np.flatnonzero(self.parent >= 0)
        self.kids = kids[np.lexsort((self.edge[kids], self.parent[kids]))]
        self.kid_key = self.parent[self.kids] * (BITS + 1) + self.edge[self.kids]

    def components(self, block: int = 200_000) -> np.ndarray:
        """Of each element the smallest element that links of its shard reach."""
        n = len(self.fp)
        # A subtree on an edge within the radius joins its parent.
        up = np.where((self.parent >= 0) & (self.edge <= self.radius), self.parent, np.arange(n))
        label = settle(up)
        while True:
            low, high = label.copy(), label.copy()  # least and largest label below each node
            for level in self.levels[:0:-1]:
                np.minimum.at(low, self.parent[level], low[level])
                np.maximum.at(high, self.parent[level], high[level])
            a, b = [], []
            for i in range(0, n, block):
                q = np.arange(i, min(n, i + block))
                node = self.root[q]
                while len(q):
                    apart = (low[node] != high[node]) | (low[node] != label[q])  # else all of it is q's component already
                    q, node = q[apart], node[apart]
                    d = np.bitwise_count(self.fp[q] ^ self.fp[node]).astype(np.int64)
                    hit = (d <= self.radius) & (label[q] != label[node])
                    pair = np.unique(np.stack([label[q[hit]], label[node[hit]]]), axis=1)
                    a.append(pair[0])
                    b.append(pair[1])
                    lo = np.searchsorted(self.kid_key, node * (BITS + 1) + np.maximum(d - self.radius, 0))
                    hi = np.searchsorted(self.kid_key, node * (BITS + 1) + np.minimum(d + self.radius, BITS), side="right")
                    count = hi - lo
                    q = np.repeat(q, count)
                    node = self.kids[np.arange(len(q)) - np.repeat(np.cumsum(count) - count, count) + np.repeat(lo, count)]
            a, b = np.concatenate([*a, np.zeros(0, np.int64)]), np.concatenate([*b, np.zeros(0, np.int64)])
            if not len(a):
                return label
            label = unite(label, a, b)


def settle(up: np.ndarray) -> np.ndarray:
    """The root of every element of a forest of pointers."""
    while True:
        nxt = up[up]
        if (nxt == up).all():
            return up
        up = nxt


def unite(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Labels with the classes a and b joined, pair by pair; a class is named by its smallest element."""
    up = np.arange(len(label))
    while True:
        ra, rb = up[a], up[b]
        if (ra == rb).all():
            return up[label]
        np.minimum.at(up, np.maximum(ra, rb), np.minimum(ra, rb))
        up = settle(up)


def shard_masks(radius: int, share: int = 2) -> list[int]:
    """Masks of bits such that two fingerprints within the radius agree on all bits of at least one mask.

    The bits are cut in radius + share blocks, of which at most radius differ; each mask is `share` of the blocks.
    """
    n = radius + share
    edge = [k * BITS // n for k in range(n + 1)]
    block = [((1 << (edge[k + 1] - edge[k])) - 1) << edge[k] for k in range(n)]
    return [sum(block[k] for k in c) for c in combinations(range(n), share)]


def links(fps: DataFrame, radius: int = 4, share: int = 2, chunk: int = 500_000) -> DataFrame:
    """Edges (a, b) between distinct fingerprints (fp long) whose components are those of all pairs within the radius.

    Every fingerprint goes to one shard for each mask; two that link share one at least. A task holds whole shards
    in a row and grows a BK-tree for each; every fingerprint follows the edges within the radius in its own shard's
    tree, and each shard returns a star per component instead of its pairs. A shard of more than `chunk` fingerprints
    is cut in parts, and a tree is grown of every two parts, so no task holds more and no pair is left out.
    """
    masks = [m - (1 << 64) if m >> 63 else m for m in shard_masks(radius, share)]
    keys = F.array(*[F.struct(F.lit(k).alias("mask"), F.col("fp").bitwiseAND(F.lit(m)).alias("key")) for k, m in enumerate(masks)])
    rows = fps.select("fp", F.explode(keys).alias("s")).select("fp", F.xxhash64("s.mask", "s.key").alias("shard"))
    sizes = rows.groupBy("shard").count().filter(F.col("count") > chunk)
    hot = stored(sizes.selectExpr("shard hot", f"int((count + {chunk // 2 - 1}) div {chunk // 2}) parts"), "hot-shards")
    if not hot.isEmpty():
        # One in `chunk` of all rows at most is the name of a hot shard; Spark broadcasts them if they are few.
        cut = rows.join(hot, F.col("shard") == F.col("hot"), "left").withColumn("p", F.pmod(F.xxhash64("fp"), F.coalesce("parts", F.lit(1))).cast("int"))
        pairs = F.expr("transform(sequence(0, parts - 1), q -> xxhash64(shard, least(p, q), greatest(p, q)))")
        # With itself a part meets in every tree that it is in.
        rows = cut.select("fp", F.explode(F.when(F.col("parts") > 1, pairs).otherwise(F.array("shard"))).alias("shard"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []
        size, most = 0, 2 * chunk

        def edges(last: bool) -> Iterator[pa.RecordBatch]:
            nonlocal held, size, most
            shard, fp = (np.concatenate(x) for x in zip(*held, strict=True))
            cut = len(shard) if last else int(np.searchsorted(shard, shard[-1]))  # the last shard may go on
            held, size = [(shard[cut:], fp[cut:])], len(shard) - cut
            most = max(2 * chunk, 2 * size)
            shard, fp = shard[:cut], fp[:cut]
            many = np.zeros(cut, bool)
            many[1:] = shard[1:] == shard[:-1]
            many[:-1] |= many[1:]
            shard, fp = shard[many], fp[many]
            lead = BKForest(shard, fp.view(np.uint64), radius).components() if len(fp) else np.zeros(0, np.int64)
            out = np.flatnonzero(lead != np.arange(len(lead)))
            yield pa.record_batch([pa.array(fp[out]), pa.array(fp[lead[out]])], names=["a", "b"])

        for b in batches:
            held.append((b.column("shard").to_numpy(), b.column("fp").to_numpy()))
            size += b.num_rows
            if size >= most:
                yield from edges(False)
        if held:
            yield from edges(True)

    return rows.repartition("shard").sortWithinPartitions("shard", "fp").mapInArrow(run, "a long, b long").distinct()


def grouped(fp: DataFrame, radius: int = 4) -> DataFrame:
    """(fp, class, least) of the distinct fingerprints of fp (doc_id, fp): class names their component, least is the smallest doc_id with the fingerprint."""
    own = fp.groupBy("fp").agg(F.min("doc_id").alias("least"))
    edges = stored(links(own.select("fp"), radius), "links")
    comp = connected_components(edges)
    return stored(own.join(comp, own.fp == comp.id, "left").select("fp", "least", F.coalesce("component_id", "fp").alias("class")), "classes")


def near_duplicates(docs: DataFrame, words: int = 4, radius: int = 4) -> DataFrame:
    """doc_id, fingerprint (16 lowercase hex digits) and component_id of every row of docs (doc_id, text).

    Fingerprints that differ in at most `radius` bits link; component_id is the smallest doc_id that links reach. A
    null, empty or blank text has fingerprint zero and is linked like any other; texts of fewer words than a shingle
    have one; a very long text is hashed in blocks of shingles. Rows that repeat link with each other; a null doc_id is
    grouped with its fingerprint, but never is the smallest. Other columns are ignored; an empty table gives no rows.

    Only distinct fingerprints are searched and linked, so copies, however many, cost one row.
    """
    fp = stored(fingerprints(docs, words), "fingerprints")
    group = grouped(fp, radius)
    first = group.groupBy("class").agg(F.min("least").alias("component_id"))
    named = group.join(first, "class").select(F.col("fp").alias("key"), "component_id")
    joined = fp.join(named, F.col("fp") == F.col("key"))
    return joined.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def one_of_each(docs: DataFrame, words: int = 4, radius: int = 4) -> DataFrame:
    """docs (doc_id, text and others) with one row of each group of near duplicates: of those with the smallest doc_id
    (nulls come last) the first in a table that is written once with the fingerprints. All columns stay as they are."""
    row = F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row")
    fp = stored(fingerprints(docs.select("doc_id", "text", row), words, keep=["row"]).withColumn("place", F.monotonically_increasing_id()), "fingerprints")
    group = grouped(fp.select("doc_id", "fp"), radius)
    # The first row of every fingerprint, then of every class: aggregates with partial results, no group is sorted.
    order = lambda: F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "place"))
    own = fp.groupBy("fp").agg(order().alias("first")).select(F.col("fp").alias("own_fp"), "first.*")
    best = own.join(group, own.own_fp == group.fp).groupBy("class").agg(order().alias("first"))
    chosen = stored(best.select(F.col("first.place").alias("chosen")), "chosen")
    return fp.join(chosen, F.col("place") == F.col("chosen"), "left_semi").select("row.*")
