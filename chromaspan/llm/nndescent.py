"""Neighbour graphs by NN-descent, greedy search in them, and near-duplicate vectors."""

from __future__ import annotations

import logging
import math
from collections.abc import Callable, Iterator
from functools import reduce
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import bounded_batches, connected_components, stored

log = logging.getLogger(__name__)
LISTS = "id long, nbrs binary, sims binary"
BLOCK = 1024  # rows compared with each other at once


def valid(rows: DataFrame, key: str, vector: str) -> DataFrame:
    """(id, v array<double>) of the rows that take part, each id once: not null, not zero, all components finite numbers."""
    v = F.col(vector).cast("array<double>")
    fine = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0)
    return rows.select(F.col(key).cast("long").alias("id"), v.alias("v")).filter(F.col("id").isNotNull() & F.col("v").isNotNull()).filter(fine).groupBy("id").agg(F.min("v").alias("v"))


def packed(rows: DataFrame, largest: float | None) -> DataFrame:
    """(id, u binary: float16): v at length 1, or, given the largest length, v / largest with one more component that
    makes it length 1, so that the nearest are those of largest inner product."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            u = []
            for x in b.column("v").to_pylist():
                x = np.array(x)
                if largest is None:
                    x = x / np.abs(x).max()
                    x /= np.sqrt(x @ x)
                else:
                    x = x / largest
                    x = np.append(x, math.sqrt(max(0.0, 1 - x @ x)))
                u.append(x.astype(np.float16).tobytes())
            yield pa.record_batch([b.column("id"), pa.array(u, pa.binary())], names=["id", "u"])

    return rows.mapInArrow(run, "id long, u binary")


def matrix(column: pa.Array) -> np.ndarray:
    rows = column.to_pylist()
    return np.frombuffer(b"".join(rows), np.float16).reshape(len(rows), -1).astype(np.float32)


def whole_groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Tables that hold whole groups of equal keys, of rows that come sorted by them."""
    held: list[pa.RecordBatch] = []
    for b in batches:
        if not b.num_rows:
            continue
        tail = tuple(b.column(k)[-1].as_py() for k in keys)
        cut = b.num_rows
        same = np.ones(b.num_rows, bool)
        for k, t in zip(keys, tail, strict=True):
            same &= b.column(k).to_numpy(zero_copy_only=False) == t
        cut = int(np.argmax(same))
        if cut == 0 and held and tuple(held[-1].column(k)[-1].as_py() for k in keys) == tail:
            held.append(b)
            continue
        t = pa.Table.from_batches([*held, b.slice(0, cut)])
        held = [b.slice(cut)]
        if t.num_rows:
            yield t
    if held:
        yield pa.Table.from_batches(held)


def top(ids: np.ndarray, nbrs: np.ndarray, sims: np.ndarray, k: int) -> pa.RecordBatch:
    """LISTS of the k most similar distinct neighbours of each id, ties to the smaller."""
    order = np.lexsort((-sims, nbrs, ids))
    ids, nbrs, sims = ids[order], nbrs[order], sims[order]
    keep = np.ones(len(ids), bool)
    keep[1:] = (ids[1:] != ids[:-1]) | (nbrs[1:] != nbrs[:-1])
    ids, nbrs, sims = ids[keep], nbrs[keep], sims[keep]
    order = np.lexsort((nbrs, -sims, ids))
    ids, nbrs, sims = ids[order], nbrs[order], sims[order]
    own, start = np.unique(ids, return_index=True)
    end = np.minimum(np.append(start[1:], len(ids)), start + k)
    return pa.record_batch(
        [pa.array(own, pa.int64()), pa.array([nbrs[a:b].tobytes() for a, b in zip(start, end, strict=True)], pa.binary()), pa.array([sims[a:b].tobytes() for a, b in zip(start, end, strict=True)], pa.binary())],
        names=["id", "nbrs", "sims"],
    )


def flat(t: pa.Table | pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """ids, neighbours and similarities of LISTS, an element for each entry."""
    nbrs = t.column("nbrs").to_pylist()
    ids = np.repeat(t.column("id").to_numpy(), [len(x) // 8 for x in nbrs])
    return ids, np.frombuffer(b"".join(nbrs), np.int64), np.frombuffer(b"".join(t.column("sims").to_pylist()), np.float32)


def merged(lists: DataFrame, k: int) -> DataFrame:
    """One list for each id: the best k of all its lists."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in whole_groups(batches, ["id"]):
            yield top(*flat(t), k)

    return lists.repartition("id").sortWithinPartitions("id").mapInArrow(run, LISTS)


def split_hot(rows: DataFrame, keys: DataFrame, key: str, most: int) -> DataFrame:
    """rows (key, id and others) with `part`: 0, but where keys, which has the key of every row, holds a key more than
    `most` times, which is dealt by id into parts of about that many. There are few such keys, one in `most` of all
    rows at most; Spark broadcasts them if they are small."""
    hot = stored(keys.groupBy(key).count().filter(F.col("count") > most).selectExpr(f"{key} hot_key", f"int((count + {most - 1}) div {most}) parts"), "hot-keys")
    if hot.isEmpty():
        return rows.withColumn("part", F.lit(0))
    part = F.pmod(F.xxhash64("id"), F.coalesce("parts", F.lit(1))).cast("int")
    return rows.join(hot, F.col(key) == F.col("hot_key"), "left").withColumn("part", part).drop("hot_key", "parts")


def join_hot(rows: DataFrame, right: DataFrame, key: str, n: str, hot: int) -> DataFrame:
    """rows joined with right, which has each of their keys once and in n how many rows it meets.

    Keys of `hot` rows or more meet theirs by a broadcast, so a large group stays in the tasks that hold it; of these
    there are no more than the number of rows / hot.
    """
    more = [c for c in right.columns if c != key]
    few = F.broadcast(right.filter(F.col(n) >= hot).select(key, F.struct(*more).alias("hot_row")))
    e = rows.join(few, key, "left")
    rest = e.filter("hot_row is null").drop("hot_row").join(right.filter(F.col(n) < hot), key)
    return e.filter("hot_row is not null").select(*rows.columns, *(F.col(f"hot_row.{c}").alias(c) for c in more)).unionByName(rest)


def first_lists(vec: DataFrame, n: int, k: int, trees: int, seed: int, leaf: int = 256) -> DataFrame:
    """Lists to start from: each tree cuts space by random planes through the medians of a bounded sample; vectors of a
    leaf, in blocks of BLOCK along one more direction, are compared with each other. A leaf of more than twice the
    size meant (a group of near copies isn't cut by planes) is dealt in parts. If vec has a column `label`, only vectors
    of different labels are compared."""
    spark = vec.sparkSession
    more = [c for c in ("label",) if c in vec.columns]
    sample = vec.orderBy(F.xxhash64("id", F.lit(seed))).limit(2000).toArrow()
    if not sample.num_rows:
        return spark.createDataFrame([], LISTS)
    m = matrix(sample.column("u"))
    depth = max(0, math.ceil(math.log2(max(1, n) / leaf)))
    rng = np.random.default_rng(seed)
    planes = [rng.standard_normal((m.shape[1], depth + 1)).astype(np.float32) for _ in range(trees)]
    given = spark.sparkContext.broadcast([(p, np.median(m @ p, axis=0)) for p in planes])

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = matrix(b.column("u")) if b.num_rows else np.zeros((0, 1), np.float32)
            for i, (p, mid) in enumerate(given.value) if b.num_rows else ():
                side = x @ p - mid
                code = (side[:, :-1] > 0) @ (1 << np.arange(p.shape[1] - 1, dtype=np.int64)) if p.shape[1] > 1 else np.zeros(len(x), np.int64)
                yield pa.record_batch([pa.array(code + (i << 40)), pa.array(side[:, -1].astype(np.float64)), b.column("id"), b.column("u"), *map(b.column, more)], names=["leaf", "place", "id", "u", *more])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def blocks() -> Iterator[pa.Table]:
            held, size = [], 0  # a leaf too large for one block goes on in the next
            for b in batches:
                held.append(b)
                size += b.num_rows
                while size >= 2 * BLOCK:
                    t = pa.Table.from_batches(held)
                    code = t.column("leaf").to_numpy()
                    cut = int(np.searchsorted(code, code[2 * BLOCK - 1]))
                    cut = cut if cut else BLOCK
                    yield t.slice(0, cut)
                    held, size = t.slice(cut).to_batches(), size - cut
            if size:
                yield pa.Table.from_batches(held)

        for t in blocks():
            code, ids, x = t.column("leaf").to_numpy(), t.column("id").to_numpy(), matrix(t.column("u"))
            label = t.column("label").to_numpy() if more else None
            part = t.column("part").to_numpy()
            start = np.flatnonzero(np.append(True, (np.diff(code) != 0) | (np.diff(part) != 0)))
            start = np.append(start, len(code))
            out = []
            for a, e in zip(start, start[1:], strict=False):
                for i in range(a, e, BLOCK):
                    j = min(e, i + BLOCK)
                    out += nearest(ids[i:j], x[i:j], k, label=label[i:j] if more else None)
            if out:
                yield top(*(np.concatenate(c) for c in zip(*out, strict=True)), k)

    dealt = vec.mapInArrow(deal, ", ".join(["leaf long, place double, id long, u binary", *(f"{c} long" for c in more)]))
    return split_hot(dealt, dealt, "leaf", 2 * leaf).repartition("leaf", "part").sortWithinPartitions("leaf", "part", "place").mapInArrow(compare, LISTS)


def nearest(ids: np.ndarray, x: np.ndarray, k: int, least: np.ndarray | None = None, label: np.ndarray | None = None) -> list[tuple]:
    """(ids, neighbours, similarities) of the k most similar of each row among the others (of another label, if labels
    are given), above its least if given."""
    if len(ids) < 2 or (label is not None and (label == label[0]).all()):
        return []
    s = x @ x.T
    np.fill_diagonal(s, -9)
    if label is not None:
        s[label[:, None] == label] = -9
    k = min(k, len(ids) - 1)
    best = np.argpartition(-s, k - 1, axis=1)[:, :k]
    sim = np.take_along_axis(s, best, 1)
    good = sim > (least[:, None] if least is not None else -2)
    return [(np.repeat(ids, good.sum(1)), ids[best[good]], sim[good])]


def exploded(lists: DataFrame) -> DataFrame:
    """(id, nbr, sim) of each entry."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, nbrs, sims = flat(b)
            yield pa.record_batch([pa.array(ids), pa.array(nbrs), pa.array(sims)], names=["id", "nbr", "sim"])

    return lists.mapInArrow(run, "id long, nbr long, sim float")


def descend(graph: DataFrame, vec: DataFrame, k: int, group: int = 128, near: DataFrame | None = None) -> DataFrame:
    """One round: whoever shares a neighbour (in either direction) is compared, and better lists are kept.

    near: edges (id, nbr) that neighbours are shared by, too. If vec has a column `label`, only vectors of different
    labels are compared.

    The neighbours of a node meet in a join on that node, with their vectors and the similarity that a new entry must
    beat; a node with more than `group` of them has them compared in blocks, and one with many more is dealt in parts.
    """
    more = [c for c in ("label",) if c in vec.columns]
    e = exploded(graph).select("id", "nbr")
    e = e if near is None else e.unionByName(near)
    both = e.unionByName(e.selectExpr("nbr id", "id nbr")).distinct().withColumnsRenamed({"id": "node", "nbr": "id"})

    def worst(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            s = [np.frombuffer(x, np.float32) for x in b.column("sims").to_pylist()]
            yield pa.record_batch([b.column("id"), pa.array([float(x[-1]) if len(x) >= k else -2.0 for x in s], pa.float32())], names=["id", "least"])

    limits = vec.join(graph.mapInArrow(worst, "id long, least float"), "id", "left")
    both = split_hot(both, both, "node", 8 * group)
    met = both.join(limits, "id").select("node", "part", "id", "u", F.coalesce("least", F.lit(-2.0)).cast("float").alias("least"), *more)

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in whole_groups(batches, ["node", "part"]):
            node, part, ids, x, least = t.column("node").to_numpy(), t.column("part").to_numpy(), t.column("id").to_numpy(), matrix(t.column("u")), t.column("least").to_numpy()
            label = t.column("label").to_numpy() if more else None
            start = np.append(np.flatnonzero(np.append(True, (np.diff(node) != 0) | (np.diff(part) != 0))), len(node))
            out = []
            for a, e in zip(start, start[1:], strict=False):
                for i in range(a, e, group):
                    j = min(e, i + group)
                    out += nearest(ids[i:j], x[i:j], k, least[i:j], label[i:j] if more else None)
            if out:
                yield top(*(np.concatenate(c) for c in zip(*out, strict=True)), k)

    new = met.repartition("node", "part").sortWithinPartitions("node", "part", F.xxhash64("id")).mapInArrow(compare, LISTS)
    return merged(graph.unionByName(new), k)


def graph(vec: DataFrame, n: int, k: int, rounds: int, trees: int, seed: int = 1) -> DataFrame:
    """LISTS of k neighbours of every vector (id, u), by `rounds` of NN-descent."""
    g = stored(merged(first_lists(vec, n, k, trees, seed), k), "graph")
    for _ in range(rounds):
        g = stored(descend(g, vec, k), "graph")
    return g


def dot(a: str, b: str):
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def search(rows: DataFrame, queries: Callable, k: int = 20, key: str = "vec_id", vector: str = "embedding", degree: int = 40, rounds: int = 3, trees: int = 8, pool: int = 128, width: int = 128, seeds: int = 16, seed: int = 1) -> DataFrame:
    """(query_id, rank, vec_id, score): of each query the k rows of largest inner product, itself left out.

    queries: a condition on the column `id`; queries are rows of the index themselves. Every valid row is indexed, by a
    neighbour graph of `degree`; a query's greedy search starts at its own node and at the `seeds` longest vectors, and
    in each further hop opens the `width` best nodes of its pool (the best found, `pool` at most) that it hasn't opened
    yet, until all of its pool are; what a query has scored once isn't scored again. The final order and the scores are computed on the original vectors in double precision; ties go to the smaller id.
    Graph and search are over the distinct vectors, each with the k + 1 smallest ids that have it: no more of a group
    of equal vectors can be among a query's k.

    Vectors that are null, empty, zero or hold null or non-finite components take no part, nor do rows with a null id;
    rows that repeat an id count once. With k rows or fewer to find, all are returned; an empty table gives no rows.
    """
    v = stored(valid(rows, key, vector), "vectors")
    first = v.withColumn("place", F.row_number().over(Window.partitionBy("v").orderBy("id"))).filter(F.col("place") <= k + 1)  # tasks prune their rows before they meet
    one = stored(first.groupBy("v").agg(F.min("id").alias("id"), F.sort_array(F.collect_list("id")).alias("ids")), "distinct")
    n, largest = one.agg(F.count("*"), F.max(F.sqrt(dot("v", "v")))).first()
    vec = stored(packed(one.select("id", "v"), largest or 1.0), "lifted")
    g = graph(vec, n, degree, rounds, trees, seed)
    longest = np.array([r.id for r in one.orderBy(F.desc(dot("v", "v")), "id").limit(seeds).select("id").collect()], np.int64).tobytes()
    asked = stored(v.filter(queries(F.col("id"))).select(F.col("id").alias("query_id"), "v").join(one.select("id", "v"), "v").select("query_id", "id"), "asked")
    own = stored(asked.select("id").distinct(), "own")
    pools = ("nbrs", "sims", "opened")
    state = own.select("id", *(F.lit(b"").alias(c) for c in pools))

    def unopened(nbrs: bytes, opened: bytes) -> np.ndarray:
        best = np.frombuffer(nbrs, np.int64)
        return best[~np.isin(best, np.frombuffer(opened, np.int64))][:width]

    def fresh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            nodes = [unopened(x, o) for x, o in zip(b.column("nbrs").to_pylist(), b.column("opened").to_pylist(), strict=True)]
            q = np.repeat(b.column("id").to_numpy(), [len(x) for x in nodes])
            yield pa.record_batch([pa.array(q), pa.array(np.concatenate([*nodes, np.zeros(0, np.int64)]))], names=["q", "id"])

    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            nbrs = b.column("nbrs").to_pylist()
            q = np.repeat(b.column("q").to_numpy(), [len(x) // 8 for x in nbrs])
            yield pa.record_batch([pa.array(q), pa.array(np.frombuffer(b"".join(nbrs), np.int64))], names=["q", "id"])

    def unseen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """One list for each query: what its new lists hold, but itself and what it has scored before."""
        for t in whole_groups(batches, ["q"]):
            q, nbrs, new = t.column("q").to_numpy(), [np.frombuffer(x, np.int64) for x in t.column("nbrs").to_pylist()], t.column("new").to_numpy()
            start = np.append(np.unique(q, return_index=True)[1], len(q))
            who, out = [], []
            for a, e in zip(start, start[1:], strict=False):
                ids = np.unique(np.concatenate([x for x, n in zip(nbrs[a:e], new[a:e], strict=True) if n]))
                ids = ids[~np.isin(ids, np.concatenate([q[a : a + 1], *(x for x, n in zip(nbrs[a:e], new[a:e], strict=True) if not n)]))]
                if len(ids):
                    who.append(int(q[a]))
                    out.append(ids.tobytes())
            yield pa.record_batch([pa.array(who, pa.int64()), pa.array(out, pa.binary())], names=["q", "nbrs"])

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The pools after a hop, of rows with the query's own vector and pool (mine) and rows with new candidates."""
        for t in whole_groups(batches, ["q"]):
            q, ids, x = t.column("q").to_numpy(), t.column("id").to_numpy(), matrix(t.column("u"))
            mine = t.column("mine").to_numpy(zero_copy_only=False)
            held = t.filter(t.column("mine")).select(["q", *pools]).rename_columns(["id", *pools])
            start = np.append(np.unique(q, return_index=True)[1], len(q))
            out = [flat(held)]
            for a, e in zip(start, start[1:], strict=False):
                others = ~mine[a:e]
                me = np.append(x[a:e][~others][0][:-1], np.float32(0))  # a query has no part in the component that evens out lengths
                out.append((q[a:e][others], ids[a:e][others], (x[a:e][others] @ me).astype(np.float32)))
            best = top(*(np.concatenate(c) for c in zip(*out, strict=True)), pool)
            opened = {r["id"]: r["opened"] + unopened(r["nbrs"], r["opened"]).tobytes() for r in held.to_pylist()}
            yield pa.record_batch([*best.columns, pa.array([opened[i] for i in best.column("id").to_pylist()], pa.binary())], names=[*best.schema.names, "opened"])

    bounded_batches(rows.sparkSession)
    ended, done = [], None
    for hop in count():
        nodes = stored(state.mapInArrow(fresh, "q long, id long") if hop else own.selectExpr("id q", "id"), "nodes")
        if nodes.isEmpty():
            break
        # Queries that have nothing more to open take no part in further hops.
        going = nodes.select("q").distinct()
        ended.append(state.join(going, F.col("id") == F.col("q"), "left_anti"))
        lists = nodes.join(g.select("id", "nbrs"), "id").select("q", "nbrs")
        if not hop:
            lists = lists.unionByName(own.select(F.col("id").alias("q"), F.lit(longest).alias("nbrs")))
        lists = lists.withColumn("new", F.lit(True))
        if done is not None:
            lists = lists.unionByName(done.join(going, "q", "left_semi").withColumn("new", F.lit(False)))
        seen = stored(lists.repartition("q").sortWithinPartitions("q").mapInArrow(unseen, "q long, nbrs binary"), "seen")
        done = seen if done is None else done.unionByName(seen)
        mine = state.join(going, F.col("id") == F.col("q"), "left_semi").join(vec, "id").select(F.col("id").alias("q"), "id", "u", *pools, F.lit(True).alias("mine"))
        others = seen.mapInArrow(listed, "q long, id long").join(vec, "id").select("q", "id", "u", *(F.lit(None).cast("binary").alias(c) for c in pools), F.lit(False).alias("mine"))
        state = stored(mine.unionByName(others).repartition("q").sortWithinPartitions("q").mapInArrow(near, f"{LISTS}, opened binary"), "pools")
    state = reduce(DataFrame.unionByName, ended, state)
    a, b = one.select(F.col("id").alias("q"), F.col("v").alias("qv")), one.select("id", "ids", F.col("v").alias("cv"))
    pairs = exploded(state.select("id", "nbrs", "sims")).selectExpr("id q", "nbr id").unionByName(own.selectExpr("id q", "id")).join(b, "id").join(a, "q")

    def best_of(rows: DataFrame, by: str, tie: str, n: int) -> DataFrame:
        return rows.withColumn("rank", F.row_number().over(Window.partitionBy(by).orderBy(F.desc("score"), tie))).filter(F.col("rank") <= n)

    # k + 1 vectors hold the k + 1 best ids, of which a query may be one itself.
    top_vectors = best_of(pairs.select("q", "id", "ids", dot("qv", "cv").alias("score")), "q", "id", k + 1)
    top_ids = best_of(top_vectors.select("q", F.explode("ids").alias("vec_id"), "score"), "q", "vec_id", k + 1).drop("rank")
    found = asked.join(top_ids, F.col("id") == F.col("q")).filter("vec_id <> query_id").select("query_id", "vec_id", "score")
    return best_of(found, "query_id", "vec_id", k).select("query_id", "rank", "vec_id", "score")


def trees_for(n: int, least: float, lost: float = 0.01, leaf: int = 256) -> int:
    """How many trees it takes for all but a share `lost` of pairs at the threshold to meet in a leaf of one: a plane
    parts a pair with a probability of its angle / pi, and the planes of a tree are as many as the table has doublings
    beyond a leaf."""
    depth = max(0, math.ceil(math.log2(max(1, n) / leaf)))
    meet = (1 - math.acos(min(1.0, max(-1.0, least))) / math.pi) ** depth
    return max(8, math.ceil(math.log(lost) / math.log(1 - meet))) if meet < 1 else 8


def cosine():
    return dot("a", "b") / (F.sqrt(dot("a", "a")) * F.sqrt(dot("b", "b")))


def _exact(pairs: DataFrame, v: DataFrame, least: float) -> DataFrame:
    """The pairs (a, b) whose cosine in double precision is at least `least`."""
    p = pairs.selectExpr("a x", "b y").join(v.selectExpr("id x", "v a"), "x").join(v.selectExpr("id y", "v b"), "y")
    return p.filter(cosine() >= least).selectExpr("x a", "y b")


def near_duplicates(rows: DataFrame, least: float = 0.9, key: str = "vec_id", vector: str = "embedding", degree: int = 16, rounds: int = 2, trees: int | None = None, audit: int = 2000, recall: float = 0.999) -> DataFrame:
    """(vec_id, n_links, component_id, kept) of every row: links are pairs of cosine >= least in double precision.

    A neighbour graph by NN-descent over the distinct vectors gives the links of lists that aren't full. Where a list
    is saturated (all its entries link), it is enlarged to all that its links reach: members within half the
    threshold's angle of their class's centre are linked with each other by the triangle inequality and only counted;
    any other member is compared with the whole class, in blocks. So no pairs of a group of copies are listed. Centres
    of classes get a graph of their own, which joins classes that the first graph left apart. A saturated list may
    have no place for a link to another class, as nearer members fill it: all vectors with such lists get further
    lists, of vectors outside their class alone, until no class has a link outside (`_foreign`). The links of `audit`
    vectors drawn from all, and of more until enough of them have links, are then compared with brute force; if less
    than `recall` of the linked ones have all theirs (or less than that by 0.009 of those with about so many links),
    another graph adds its own, with lists twice as long and twice the trees; if lists as long as the table aren't
    enough, an error says so. The number of trees follows the table's size (trees_for), unless it is given.

    Vectors that are null, empty, zero or hold null or non-finite components have no links and are their own component.
    A null vec_id gives a row with nulls and no links; rows that repeat a vec_id get the same result; an empty table
    gives no rows. Other columns are ignored.
    """
    spark = rows.sparkSession
    v = stored(valid(rows, key, vector), "vectors")
    copies = v.groupBy("v").agg(F.min("id").alias("id"), F.count("*").alias("copies"))
    one = stored(copies, "distinct")
    n = one.count()
    vec = stored(packed(one.select("id", "v"), None), "units")
    pairs, trees = None, trees or trees_for(n, least)
    for attempt in count():
        k, more = degree << attempt, trees << attempt
        own = graph(vec, n, k, rounds, more, seed=1 + attempt)
        exact = _exact(_near(own, least), one, least)
        pairs = stored(exact if pairs is None else pairs.unionByName(exact).distinct(), "pairs")
        comp = connected_components(pairs)
        centres = stored(_centres(comp, pairs).join(vec, "id"), "centres")
        g = graph(centres.select("id", "u"), centres.count(), k, 1, more, seed=11 + attempt)
        pairs = stored(pairs.unionByName(_exact(_near(g, least), one, least)).distinct(), "pairs")
        comp = stored(connected_components(pairs), "components")
        pairs, comp = _foreign(own, vec, one, pairs, comp, least, k, rounds, more, seed=101 + 100 * attempt)
        counted = stored(_counts(one, comp, _centres(comp, pairs), least), "links")
        got, worst, linked, asked = _audit(one, counted, n, audit, least)
        log.info("%d of %d audited vectors have links; share of them all of whose links are found: %.4f, least by number of links %.4f", linked, asked, got, worst)
        if got >= recall and worst >= recall - 0.009:
            break
        if k >= n:
            raise RuntimeError(f"only {got:.4f} of {linked} audited vectors with links have all of them with lists of {k}")
    info = one.join(comp.selectExpr("id", "component_id"), "id", "left").join(counted, "id", "left")
    links = (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).cast("long").alias("n_links")
    info = info.select("v", "copies", links, F.coalesce("component_id", "id").alias("component_id"))
    full = join_hot(v, info, "v", "copies", max(100, n // 1000)).select("id", "n_links", "component_id")
    out = rows.select(F.col(key).cast("long").alias("vec_id")).join(full, F.col("vec_id") == F.col("id"), "left")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id")).withColumn("kept", F.col("vec_id") == F.col("component_id"))


def _near(g: DataFrame, least: float) -> DataFrame:
    """The pairs (a, b) of a graph whose similarity may reach `least`."""
    return exploded(g).filter(F.col("sim") >= least - 0.01).select(F.least("id", "nbr").alias("a"), F.greatest("id", "nbr").alias("b")).distinct()


def _foreign(own: DataFrame, vec: DataFrame, one: DataFrame, pairs: DataFrame, comp: DataFrame, least: float, k: int, rounds: int, trees: int, seed: int) -> tuple[DataFrame, DataFrame]:
    """pairs and components with the links between classes that the saturated lists of `own` have no place for.

    A link that is in neither end's list has both lists full of nearer vectors. So vectors with full lists of links get
    lists of vectors outside their class, by leaves and descent along these and their own lists; links found join
    classes, and what is joined is left out of the next lists, until none has a link outside. As every class with such
    a link joins another, the number of these is halved each time.
    """

    def full(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.record_batch([b.column("id").filter(pa.array([len(x) >= 4 * k and float(np.frombuffer(x, np.float32)[-1]) >= least - 0.01 for x in b.column("sims").to_pylist()], pa.bool_()))], names=["id"])

    some = stored(vec.join(own.mapInArrow(full, "id long"), "id", "left_semi"), "saturated")
    n = some.count()
    near = exploded(own).select("id", "nbr").join(some.select("id"), "id", "left_semi")
    while True:
        named = stored(some.join(comp, "id", "left").select("id", "u", F.coalesce("component_id", "id").alias("label")), "labelled")
        if named.select("label").distinct().limit(2).count() < 2:
            return pairs, comp
        g = stored(merged(first_lists(named, n, k, trees, seed), k), "foreign")
        for _ in range(rounds):
            g = stored(descend(g, named, k, near=near), "foreign")
        new = stored(_exact(_near(g, least), one, least), "joins")
        if new.isEmpty():
            return pairs, comp
        pairs = stored(pairs.unionByName(new).distinct(), "pairs")
        comp = stored(connected_components(pairs), "components")
        seed += 1


def _centres(comp: DataFrame, pairs: DataFrame) -> DataFrame:
    """(component_id, id): of each component the vector with most listed links."""
    n = pairs.selectExpr("a id").unionByName(pairs.selectExpr("b id")).groupBy("id").count()
    return comp.join(n, "id").groupBy("component_id").agg(F.max_by("id", F.struct("count", -F.col("id"))).alias("id"))


def _counts(one: DataFrame, comp: DataFrame, centres: DataFrame, least: float, block: int = 2048) -> DataFrame:
    """(id, links) of distinct vectors that have links: copies of other vectors of their component within the threshold."""
    members = stored(comp.join(one, "id").select("component_id", "id", "copies", F.col("v").alias("a")), "joined")
    hot = max(100, members.count() // 1000)
    sizes = members.groupBy("component_id").count()
    lead = centres.join(one.select("id", F.col("v").alias("b")), "id").select("component_id", "b").join(sizes, "component_id")
    rows = join_hot(members, lead, "component_id", "count", hot)
    rows = stored(rows.select("component_id", "id", "copies", F.col("a").alias("v"), (cosine() >= math.sqrt((1 + least) / 2) + 1e-9).alias("core")), "members")
    size = rows.groupBy("component_id").agg(F.sum(F.when(F.col("core"), F.col("copies")).otherwise(0)).alias("in_core"), F.count("*").alias("n"), F.count(F.when(~F.col("core"), 1)).alias("rest"))
    size = stored(size, "sizes")
    met = join_hot(rows, size, "component_id", "n", hot)
    easy = met.filter("core").select("id", (F.col("in_core") - F.col("copies")).alias("links"))
    hard = met.filter("rest > 0").withColumns({"parts": F.expr(f"int((n + {block - 1}) div {block})"), "rests": F.expr(f"int((rest + {block - 1}) div {block})")})
    part = lambda n: F.pmod(F.xxhash64("id"), F.col(n)).cast("int")
    all_ = hard.select("component_id", part("parts").alias("p"), F.explode(F.expr("sequence(0, rests - 1)")).alias("r"), F.lit(False).alias("asks"), "id", "copies", "v", "core")
    rest = hard.filter("not core").select("component_id", F.explode(F.expr("sequence(0, parts - 1)")).alias("p"), part("rests").alias("r"), F.lit(True).alias("asks"), "id", "copies", "v", "core")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in whole_groups(batches, ["component_id", "p", "r"]):
            key = np.stack([t.column(c).to_numpy() for c in ("component_id", "p", "r")])
            change = np.flatnonzero((key[:, 1:] != key[:, :-1]).any(0)) + 1
            asks, core = (t.column(c).to_numpy(zero_copy_only=False) for c in ("asks", "core"))
            ids, n, v = t.column("id").to_numpy(), t.column("copies").to_numpy(), t.column("v").to_pylist()
            who, links = [], []
            for a, e in zip([0, *change], [*change, len(ids)], strict=True):
                x = np.array(v[a:e])
                x /= np.sqrt((x * x).sum(1))[:, None]
                q, o = asks[a:e], ~asks[a:e]
                hit = (x[q] @ x[o].T >= least) & (ids[a:e][q][:, None] != ids[a:e][o])
                who += [ids[a:e][q], ids[a:e][o][core[a:e][o]]]
                links += [hit @ n[a:e][o], n[a:e][q] @ hit[:, core[a:e][o]]]
            yield pa.record_batch([pa.array(np.concatenate(who)), pa.array(np.concatenate(links).astype(np.int64))], names=["id", "links"])

    compared = all_.unionByName(rest).repartition("component_id", "p", "r").sortWithinPartitions("component_id", "p", "r").mapInArrow(compare, "id long, links long")
    return easy.unionByName(compared).groupBy("id").agg(F.sum("links").alias("links"))


def _audit(one: DataFrame, counted: DataFrame, n: int, size: int, least: float, enough: int = 300, most: int = 64_000) -> tuple[float, float, int, int]:
    """Of vectors drawn from all by a hash, compared with all by brute force: the share of those with links whose links,
    copies included, were all counted and no others; the least such share among a hundred or more of like numbers of
    links; how many have links; how many were drawn.

    Nothing of the graph decides who is drawn. `size` vectors are drawn, then twice as many again, until `enough` of them
    have links, or all vectors or `most` are drawn; if none of these have links, hardly any vector has.
    """
    spark = one.sparkSession

    def units(column: pa.Array) -> np.ndarray:
        x = np.array(column.to_pylist())
        x /= np.abs(x).max(1)[:, None]
        return x / np.sqrt((x * x).sum(1))[:, None]

    kinds: dict[int, list[int]] = {}
    low, drawn, whole = 0, 0, 1 << 30
    while n:
        high = min(whole, low + max(1, math.ceil(size / n * whole)))
        place = F.pmod(F.xxhash64("id", F.lit(0)), F.lit(whole))
        t = one.filter((place >= low) & (place < high)).select("id", "v").toArrow()
        drawn += t.num_rows
        if t.num_rows:
            given, block = spark.sparkContext.broadcast((t.column("id").to_numpy(), units(t.column("v")))), max(16, BLOCK * 2000 // max(2000, t.num_rows))

            def brute(batches: Iterator[pa.RecordBatch], given=given, block=block) -> Iterator[pa.RecordBatch]:
                asked, q = given.value
                sure, up_to = np.zeros(len(asked), np.int64), np.zeros(len(asked), np.int64)
                for b in batches:
                    for i in range(0, b.num_rows, block):
                        c = b.slice(i, block)
                        cos, other, copies = q @ units(c.column("v")).T, asked[:, None] != c.column("id").to_numpy(), c.column("copies").to_numpy()
                        sure += ((cos >= least + 1e-9) & other) @ copies
                        up_to += ((cos >= least - 1e-9) & other) @ copies
                yield pa.record_batch([pa.array(asked), pa.array(sure), pa.array(up_to)], names=["q", "due", "up_to"])

            truth = one.select("id", "v", "copies").mapInArrow(brute, "q long, due long, up_to long").groupBy("q").agg(F.sum("due").alias("due"), F.sum("up_to").alias("up_to")).filter("up_to > 0")
            right = F.count_if(F.coalesce("links", F.lit(0)).between(F.col("due"), F.col("up_to")))
            for r in truth.join(counted, F.col("q") == F.col("id"), "left").groupBy(F.floor(F.log2("up_to")).cast("int").alias("kind")).agg(F.count("*").alias("asked"), right.alias("right")).collect():
                old = kinds.get(r["kind"], [0, 0])
                kinds[r["kind"]] = [old[0] + r["asked"], old[1] + r["right"]]
        linked = sum(a for a, _ in kinds.values())
        if linked >= enough or high >= whole or drawn >= most:
            break
        low, size = high, 2 * size
    linked = sum(a for a, _ in kinds.values())
    return (sum(r for _, r in kinds.values()) / linked if linked else 1.0), min((r / a for a, r in kinds.values() if a >= 100), default=1.0), linked, drawn
