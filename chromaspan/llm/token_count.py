"""Token counts by a map-side two-tier lookup."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, slices

SUMMARY = "words binary, counts binary"
LONG = 256  # bytes; words as long as that are neither counted nor cached, so that tables of words are bounded in bytes
SCHEMA = "doc_id long, n_bytes long, n_tokens long, over_limit boolean"


def _lengths(tokenizer, words: list[bytes]) -> Iterator[int]:
    """Tokens of each word. White space ends a pre-token and is dropped, so a text's count is the sum over its words."""
    for e in tokenizer.encode_batch_fast([w.decode("utf-8", "replace") for w in words], add_special_tokens=False):
        yield len(e.ids)


def _tokenizer(path: str):
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    t.no_truncation()
    t.no_padding()
    return t


def _summary(seen: Counter, words: int) -> pa.RecordBatch:
    """The `words` most frequent words of a count, packed in one row."""
    top = seen.most_common(words)
    return pa.record_batch([pa.array([b" ".join(w for w, _ in top)], pa.binary()), pa.array([np.array([n for _, n in top], np.int64).tobytes()], pa.binary())], names=["words", "counts"])


def _pruned(seen: Counter, words: int) -> Counter:
    """The count itself, or its frequent half once it holds four times as many words as are wanted."""
    return Counter(dict(seen.most_common(2 * words))) if len(seen) > 4 * words else seen


def _added(seen: Counter, rows: list[tuple[bytes, bytes]], words: int) -> Counter:
    """A count with those of summaries added to it."""
    for joined, counts in rows:
        if joined:
            seen.update(dict(zip(joined.split(b" "), np.frombuffer(counts, np.int64).tolist(), strict=True)))
            seen = _pruned(seen, words)
    return seen


def frequent_words(docs: DataFrame, words: int, groups: tuple[int, ...] = (1024, 32)) -> list[bytes]:
    """About the `words` most frequent words, of under LONG bytes, of all whole texts.

    Each task counts its own texts, pruned to a bounded number of words, and hands on one packed summary; summaries
    are merged in two levels of groups, so that the driver adds up groups[-1] of them at most, whatever the input. A
    word is never a row. Pruning may lose words of middling rank, which only costs the lookup a miss.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()
        for b in batches:
            texts = [t or b"" for t in b.column("text").to_pylist()]
            for i, j in slices(texts):
                own = Counter(chain.from_iterable(map(bytes.split, texts[i:j])))
                seen.update({w: n for w, n in own.items() if len(w) < LONG})
                seen = _pruned(seen, words)
        yield _summary(seen, words)

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()
        for b in batches:
            seen = _added(seen, list(zip(b.column("words").to_pylist(), b.column("counts").to_pylist(), strict=True)), words)
        if seen:
            yield _summary(seen, words)

    rows = docs.select(F.col("text").cast("binary").alias("text")).mapInArrow(count, SUMMARY)
    for n in groups:
        rows = rows.withColumn("g", F.pmod(F.spark_partition_id(), F.lit(n))).repartition("g").select("words", "counts").mapInArrow(merge, SUMMARY)
    seen = _added(Counter(), [(bytes(r.words), bytes(r.counts)) for r in rows.collect()], words)
    return [w for w, _ in seen.most_common(words)]


def frequent_lengths(docs: DataFrame, path: str, words: int) -> tuple[bytes, bytes]:
    """The first tier: the corpus's frequent words and their lengths, as two byte strings."""
    top = frequent_words(docs, words)
    return b" ".join(top), bytes(min(x, 255) for x in _lengths(_tokenizer(path), top))


def count_tokens(docs: DataFrame, path: str, limit: int = 2048, frequent: int = 65_536, cache_words: int = 400_000) -> DataFrame:
    """Tokens of every whole text, as the tokenizers library gives them for the word-level vocabulary at path.

    docs needs doc_id and text; other columns are ignored. A null text counts as empty (0 bytes, 0 tokens), rows that
    repeat give a row each, a null doc_id stays null, a very long text or word is counted whole, an empty table gives no
    rows. The lengths of the `frequent` most
    frequent words of all texts are broadcast as two compact byte strings; a word they lack is encoded once per worker
    and kept in a cache of at most cache_words words. No pre-token is shuffled: only packed summaries of the tasks'
    word counts are.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    table = spark.sparkContext.broadcast(frequent_lengths(docs, path, frequent))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = _tokenizer(path)
        joined, n = table.value
        hot = dict(zip(joined.split(b" ") if joined else (), n, strict=True))
        hot = {w: k for w, k in hot.items() if k < 255}
        known = dict(hot)
        for b in batches:
            texts = [t or b"" for t in b.column("text").to_pylist()]
            counts: list[int] = []
            for i, j in slices(texts):
                parts = [t.split() for t in texts[i:j]]
                missing = list(set(chain.from_iterable(parts)).difference(known))
                if len(known) + len(missing) > cache_words:
                    known = dict(hot)
                    missing = list(set(chain.from_iterable(parts)).difference(known))
                known.update(zip(missing, _lengths(tokenizer, missing), strict=True))
                counts += [sum(map(known.__getitem__, p)) for p in parts]
                for w in missing:
                    if len(w) >= LONG:
                        del known[w]
            yield pa.record_batch(
                [b.column("doc_id"), pa.array([len(t) for t in texts], pa.int64()), pa.array(counts, pa.int64()), pa.array([c > limit for c in counts], pa.bool_())],
                names=["doc_id", "n_bytes", "n_tokens", "over_limit"],
            )

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text")).mapInArrow(run, SCHEMA)
