"""Periodic runs of words: maximal stretches that repeat themselves, from the Lyndon arrays of both word orders."""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import StructType

from .common import bounded_batches, slices

Run = tuple[int, int, int]  # start, length, period


def lyndon_edges(w: list[int], seen: list[int] | None = None) -> tuple[list[int], list[int]]:
    """The next smaller suffix of every position (len(w) if there is none), and how many letters both have in common.

    Positions are taken from left to right, each against the chain of smaller suffixes before it. No letter is
    compared where earlier extensions tell: of three suffixes two extensions give the third unless they are equal; and
    where the text repeats what stood `shift` before, the pair of the same places in the copy has been answered, up to
    the end of what is known to match. From there on letters are compared, each once as a match. seen[0] counts comparisons.
    """
    n = len(w)
    before, shared = [-1] * n, [0] * n  # the previous smaller suffix, and the letters in common with it
    after, common = [n] * n, [0] * n
    begin, shift, known = 0, 0, 0  # w[begin:known] equals what stands `shift` before it, and w[known] doesn't
    compared = 0
    for i in range(1, n):
        k, length, extend = i - 1, 0, True
        while True:
            if extend:
                if i + length < known:
                    if i - k == shift and k >= begin - shift:
                        length, extend = known - i, False
                    elif k >= begin:
                        a, b = k - shift, i - shift
                        got = shared[b] if before[b] == a else common[a] if after[a] == b else -1
                        if got >= 0:
                            if i + got < known:
                                length, extend = got, False
                            elif known - i > length:
                                length = known - i
                if extend:
                    start = length
                    while i + length < n and w[k + length] == w[i + length]:
                        length += 1
                    compared += length - start + 1
                    if i + length > known:
                        begin, shift, known = i, i - k, i + length
            if i + length < n and w[k + length] < w[i + length]:
                before[i], shared[i] = k, length
                break
            after[k], common[k] = i, length
            q = before[k]
            if q < 0:
                break
            extend = shared[k] == length
            if shared[k] < length:
                length = shared[k]
            k = q
    if seen is not None:
        seen[0] += compared
    return after, common


def runs_of(w: list[int], least: int = 6, times: int = 4) -> list[Run]:
    """All runs of w: maximal stretches of least letters and `times` periods or more, by start, then period.

    A run's period is the length of a Lyndon word in the order of letters or in its reverse, and the suffix after that
    word is the next smaller one; so every run shows as an edge of one of both Lyndon arrays. Its first such word
    begins less than a period after its start.
    """
    found: set[Run] = set()
    for order in (w, [-x for x in w]):
        after, common = lyndon_edges(order)
        for i, (j, right) in enumerate(zip(after, common, strict=True)):
            p = j - i
            if right <= (times - 2) * p:
                continue
            left = 0
            while left < p and left < i and w[i - 1 - left] == w[j - 1 - left]:
                left += 1
            if left < p and left + p + right >= max(least, times * p):
                found.add((i - left, left + p + right, p))
    return sorted(found, key=lambda r: (r[0], r[2]))


def stretches(words: list, least: int, times: int, again: int = 1) -> Iterator[tuple[int, int]]:
    """Ranges of words outside of which no run can reach: every word of a run occurs `times` times in it, so a word that
    is rarer in a text, and then in a range, parts what may be runs."""
    often = {w for w, n in Counter(words).items() if n >= times}
    if not often or len(words) < least:
        return
    rare = np.flatnonzero(np.fromiter((w not in often for w in words), bool, len(words)))
    edges = np.concatenate([[-1], rare, [len(words)]])
    for k in np.flatnonzero(np.diff(edges) > least):
        a, b = int(edges[k]) + 1, int(edges[k + 1])
        if again and len(rare):
            for x, y in stretches(words[a:b], least, times, again - 1):
                yield a + x, a + y
        else:
            yield a, b


def word_runs(words: list[bytes], least: int = 6, times: int = 4) -> list[Run]:
    """The runs of a text's words, by start, then period. Words are letters, ordered by their bytes."""
    out: list[Run] = []
    for a, b in stretches(words, least, times):
        own = words[a:b]
        rank = {x: k for k, x in enumerate(sorted(set(own)))}
        out += [(a + s, n, p) for s, n, p in runs_of([rank[x] for x in own], least, times)]
    return out


def most_periodic(runs: list[Run]) -> Run | None:
    """The run of most periods; of equal ones the first to start, then the shortest period. (Quotients of whole numbers below 2**26 are equal as doubles only if they are equal.)"""
    return max(runs, key=lambda r: (r[1] / r[2], -r[0], -r[2]), default=None)


def collapsed(words: list[bytes], runs: list[Run]) -> list[bytes]:
    """The words but for those that a run repeats: of each run its first period stays, unless another run drops it."""
    if not runs:
        return words
    gone = np.zeros(len(words) + 1, np.int64)
    for start, length, period in runs:
        gone[start + period] += 1
        gone[start + length] -= 1
    return [w for w, n in zip(words, np.cumsum(gone)[:-1].tolist(), strict=True) if not n]


def run_rows(docs: DataFrame, row: Callable[[list[bytes], list[Run]], tuple], schema: str, words: Callable[[int | None, list[bytes]], list[bytes]] | None = None, least: int = 6, times: int = 4) -> DataFrame:
    """doc_id and what row(words, runs) returns, for every whole text of docs (doc_id, text; other columns are ignored).

    Words are what white space (blank, and 9 to 13) parts; words(doc_id, words), if given, replaces them. A null,
    empty or blank text has no words and no runs, a null doc_id stays null, repeated rows give a row each, a very long
    text is handled whole, an empty table gives no rows. Each text is judged by itself, so nothing is shuffled.
    """
    bounded_batches(docs.sparkSession)
    fields = [(f.name, to_arrow_type(f.dataType)) for f in StructType.fromDDL(schema).fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            names, texts = b.column("doc_id").to_pylist(), [t or b"" for t in b.column("text").to_pylist()]
            for i, j in slices(texts):
                rows = []
                for name, text in zip(names[i:j], texts[i:j], strict=True):
                    own = text.split()
                    if words:
                        own = words(name, own)
                    rows.append(row(own, word_runs(own, least, times)))
                cols = [pa.array(c, t) for c, (_, t) in zip(zip(*rows, strict=True), fields, strict=True)]
                yield pa.record_batch([b.column("doc_id").slice(i, j - i), *cols], names=["doc_id", *(n for n, _ in fields)])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").cast("binary").alias("text"))
    return rows.mapInArrow(run, f"doc_id long, {schema}")


def collapse(docs: DataFrame, least: int = 6, times: int = 4) -> DataFrame:
    """doc_id, text without what runs repeat (words joined by one blank), and the runs themselves (start, length, period)."""

    def row(words: list[bytes], runs: list[Run]) -> tuple:
        return b" ".join(collapsed(words, runs)).decode("utf-8", "replace"), [dict(zip(("start", "length", "period"), r, strict=True)) for r in runs]

    return run_rows(docs, row, "text string, runs array<struct<start: long, length: long, period: long>>", least=least, times=times)
