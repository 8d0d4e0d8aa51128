"""Order-preserving packing of documents into training sequences by dynamic programming."""

from __future__ import annotations

import json
import zlib
from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import PATTERN, _byte_of_char, _supported
from .common import bounded_batches, slices

PLAN = "doc_id long, start long, length long, doc_tokens long, sequence_id long, offset long"


class Tokens:
    """Ids of texts by a byte-level vocabulary file, the end id included, and where sentences end."""

    def __init__(self, path: str, end_id: int):
        import regex
        import tiktoken

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        _supported(spec)
        back = _byte_of_char()
        ranks = {bytes(back[c] for c in t): i for t, i in spec["model"]["vocab"].items()}
        self.special = {a["content"]: a["id"] for a in spec["added_tokens"]}
        self.cut = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")").split
        self.plain = tiktoken.Encoding("byte-level", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_to_numpy
        self.end_id = end_id
        self.closes = np.zeros(max([*ranks.values(), *self.special.values(), end_id]) + 1, bool)
        for t, i in ranks.items():
            self.closes[i] = t[-1:] in (b".", b"!", b"?", b"\n")

    def ids(self, text: str) -> np.ndarray:
        out = []
        for k, part in enumerate(self.cut(text) if any(s in text for s in self.special) else [text]):
            out.append(np.array([self.special[part]], np.uint32) if k % 2 else self.plain(part).astype(np.uint32))
        return np.concatenate([*out, np.array([self.end_id], np.uint32)])


def cut_points(ids: np.ndarray, closes: np.ndarray, sentence_cost: float, word_cost: float, stride: int) -> tuple[np.ndarray, np.ndarray]:
    """Where a document may be cut and what each cut costs: ends of sentences, its own end (free), and, where no
    sentence ends for a stride, every stride-th token."""
    ends = np.flatnonzero(closes[ids[:-1]]) + 1
    ends = ends[ends < len(ids)]
    edges = np.concatenate([[0], ends, [len(ids)]])
    if int(np.diff(edges).max()) <= stride:
        return edges[1:].astype(np.int64), np.append(np.full(len(ends), sentence_cost), 0.0)
    gaps = np.diff(edges)
    wide = np.flatnonzero(gaps > stride)
    extra = np.concatenate([np.arange(edges[k] + stride, edges[k + 1], stride) for k in wide]) if len(wide) else np.zeros(0, np.int64)
    at = np.concatenate([ends, extra, [len(ids)]])
    cost = np.concatenate([np.full(len(ends), sentence_cost), np.full(len(extra), word_cost), [0.0]])
    order = np.argsort(at, kind="stable")
    return at[order].astype(np.int64), cost[order]


def best_cuts(at: list[int], cost: list[float], window: int, each: float = 0.0) -> list[int]:
    """Window ends among the points `at` (ascending, from 0, no two further apart than window) of the cheapest partition of [0, at[-1]).

    A window of n tokens costs `each`, window - n for its padding (nothing where n is a power of two) and the cost of its end.
    best[j] = cost[j] + each + window - at[j] + min(best[i] + at[i]) over at[i] >= at[j] - window: a sliding minimum, kept in
    a queue that is monotone in best + at. The power-of-two lengths are looked up by their start.
    """
    points = [0, *at]
    # By point the earlier ones that are a power of two before it, by power: few are, so they are found beforehand.
    places = np.array(points)
    back_by: dict[int, list[int]] = {}
    for n in (1 << k for k in range(window.bit_length()) if 1 << k <= window):
        k = np.searchsorted(places, places - n)
        met = np.flatnonzero(places[k] == places - n)
        for j, i in zip(met.tolist(), k[met].tolist(), strict=True):
            back_by.setdefault(j, []).append(i)
    key, back = [0.0] * len(points), [0] * len(points)
    best, queue, head = [0.0] * len(points), deque([0]), 0
    for j in range(1, len(points)):
        p = points[j]
        while points[queue[0]] < p - window:
            queue.popleft()
        i = queue[0]
        least = key[i] + window - p
        for k in back_by.get(j, ()):
            if best[k] < least:
                least, i = best[k], k
        best[j], back[j] = least + cost[j - 1] + each, i
        key[j] = best[j] + p
        while queue and key[queue[-1]] >= key[j]:
            queue.pop()
        queue.append(j)
    out, j = [], len(points) - 1
    while j:
        out.append(points[j])
        j = back[j]
    return out[::-1]


def pack(
    docs: DataFrame, path: str, window: int = 2048, end_id: int = 1, sentence_cost: float = 4.0, word_cost: float = 24.0, stride: int = 64, block_tokens: int = 400_000,
    with_ids: bool = True, sequence_cost: float = 512.0,
) -> DataFrame:
    """Sequences of at most `window` tokens that hold every token of docs (doc_id, text) once, in order of doc_id.

    Returns a row per piece of a document in a sequence: doc_id, start (tokens of the document before it), length,
    doc_tokens (its end id included), sequence_id, offset (in the sequence) and ids_crc32 (of the piece's ids as
    little-endian unsigned 32-bit integers); with_ids adds the ids. A null text is empty (its end id alone), a null
    doc_id comes first and stays null, repeated rows are packed each, a very long text is cut like any other, an empty
    table gives no rows, and other columns are ignored. A sequence costs sequence_cost beside its padding and cuts, so
    that short ones of a power of two tokens, which have no padding, don't come cheap.

    Documents are dealt by ranges of doc_id, and of a hash of the text where many rows have one doc_id; each range is tokenised once and cut in blocks of about block_tokens,
    whose last, still open window goes on into the next block. So a task holds one block (or one longer document),
    ids are never shuffled, and only a range's last sequence may stay short.
    """
    spark = docs.sparkSession
    bounded_batches(spark)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = Tokens(path, end_id)
        sequence = (TaskContext.get().partitionId()) << 40
        #: Parts of documents not yet in a sequence: (doc_id, tokens before the part, its ids, the document's tokens), and their cuts.
        held: list[tuple] = []
        at: list[np.ndarray] = []
        cost: list[np.ndarray] = []
        size = 0

        def flush(last: bool) -> pa.RecordBatch:
            nonlocal held, at, cost, size, sequence
            points, costs = np.concatenate(at), np.concatenate(cost)
            ends = best_cuts(points.tolist(), costs.tolist(), window, sequence_cost)
            if not last and len(ends) > 1:
                ends.pop()
            rows: list[tuple] = []
            part, used, begin = 0, 0, 0
            for end in ends:
                offset = 0
                while begin < end:
                    doc, before, ids, total = held[part]
                    n = min(len(ids) - used, end - begin)
                    piece = ids[used : used + n]
                    rows.append((doc, before + used, n, total, sequence, offset, zlib.crc32(piece.tobytes()), piece.tolist() if with_ids else None))
                    used, begin, offset = used + n, begin + n, offset + n
                    if used == len(ids):
                        part, used = part + 1, 0
                sequence += 1
            done = ends[-1]
            rest = held[part:]
            if rest and used:
                doc, before, ids, total = rest[0]
                rest[0] = (doc, before + used, ids[used:].copy(), total)
            keep = points > done
            held, at, cost, size = rest, [points[keep] - done], [costs[keep]], size - done
            cols = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (*[pa.int64()] * 7, pa.list_(pa.int32())), strict=True)]
            return pa.record_batch(cols[:8] if with_ids else cols[:7], names=["doc_id", "start", "length", "doc_tokens", "sequence_id", "offset", "ids_crc32", "ids"][: 8 if with_ids else 7])

        for b in batches:
            doc_ids, texts = b.column("doc_id").to_pylist(), [t or "" for t in b.column("text").to_pylist()]
            for i, j in slices(texts, block_tokens * 2):
                for doc, text in zip(doc_ids[i:j], texts[i:j], strict=True):
                    ids = tokens.ids(text)
                    p, c = cut_points(ids, tokens.closes, sentence_cost, word_cost, stride)
                    held.append((doc, 0, ids, len(ids)))
                    at.append(p + size)
                    cost.append(c)
                    size += len(ids)
                if size >= block_tokens:
                    yield flush(False)
        if held:
            yield flush(True)

    schema = PLAN + ", ids_crc32 long" + (", ids array<int>" if with_ids else "")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.repartitionByRange("doc_id", F.xxhash64("text")).sortWithinPartitions("doc_id", F.xxhash64("text")).mapInArrow(run, schema)
