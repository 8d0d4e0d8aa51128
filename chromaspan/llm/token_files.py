"""Token ids in files: canonical length-limited Huffman codes, in independent blocks with bit-offset checkpoints.

A token file is a folder of three Parquet tables, so that it is written and committed by Spark on any file system:

- `blocks`: (part, block, start, n_ids, doc_ids, lengths, checkpoints, payload, crc): whole documents in ascending
  doc_id order, until they hold block_ids ids or more. `payload` is the bits of the ids' codes, most significant bit
  first; `checkpoints` the bit offset of every STRIDE-th id as little-endian unsigned 64-bit integers; `crc` the crc32
  of the ids as little-endian unsigned 32-bit integers; `start` the ids of the part before the block.
- `parts`: (part, first): the ids of all parts before each part. Parts follow each other by doc_id.
- `codes`: one row; byte k of `lengths` is the length of id k's code, 0 for ids that don't occur. Codes are canonical,
  so lengths say all.
"""

from __future__ import annotations

import json
import re
import zlib
from collections.abc import Callable, Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import StructType

from .common import bounded_batches, scratch, stored
from .token_count import LONG, _tokenizer

STRIDE = 256  # ids between checkpoints
SLICE_BYTES = 8_000_000  # of text whose words are told apart at once
BLOCKS = "part int, block int, start long, n_ids long, doc_ids array<long>, lengths array<long>, checkpoints binary, payload binary, crc long"


def code_lengths(counts: np.ndarray, limit: int) -> np.ndarray:
    """Lengths of the best prefix code of at most `limit` bits for ids that occur counts[id] times: package-merge.

    Level by level the cheapest packages of two are merged with the single ids. Of a level's first m items those that
    are single ids take one more bit each, and the packages among them ask for twice as many items a level below.
    """
    used = np.flatnonzero(counts)
    n = len(used)
    out = np.zeros(len(counts), np.uint8)
    if n < 2:
        out[used] = 1
        return out
    if n > 1 << limit:
        raise ValueError(f"{n} ids have no code of at most {limit} bits")
    by_count = used[np.argsort(counts[used], kind="stable")]
    single = counts[by_count].astype(np.int64)
    items, levels = single, [np.ones(n, bool)]
    for _ in range(limit - 1):
        m = len(items) // 2 * 2
        both = np.concatenate([single, items[0:m:2] + items[1:m:2]])
        order = np.argsort(both, kind="stable")
        items = both[order]
        levels.append(order < n)
    bits, m = np.zeros(n, np.int64), 2 * n - 2
    for singles in reversed(levels):
        k = int(np.count_nonzero(singles[:m]))
        bits[:k] += 1
        m = 2 * (m - k)
    out[by_count] = bits
    return out


class Codes:
    """The canonical code of given lengths: shorter codes first, of a length the smaller id first."""

    def __init__(self, lengths: bytes):
        self.lengths = np.frombuffer(lengths, np.uint8)
        used = np.flatnonzero(self.lengths)
        order = used[np.argsort(self.lengths[used], kind="stable")]
        bits = self.lengths[order].astype(np.int64)
        self.limit = int(bits.max(initial=1))
        if self.limit > 25:
            raise ValueError(f"codes of {self.limit} bits don't fit a window of 32 bits at any bit of a byte")
        #: Every window of `limit` bits begins with one code; table: its id and length.
        width = 1 << (self.limit - bits)
        begin = np.cumsum(width) - width
        self.codes = np.zeros(len(self.lengths), np.uint64)
        self.codes[order] = (begin >> (self.limit - bits)).astype(np.uint64)
        self.ids_of, self.bits_of = np.zeros(1 << self.limit, np.uint32), np.ones(1 << self.limit, np.uint8)
        n = int(width.sum())
        self.ids_of[:n], self.bits_of[:n] = np.repeat(order, width), np.repeat(bits, width)

    def encode(self, ids: np.ndarray) -> tuple[bytes, np.ndarray]:
        """The payload of ids, and the checkpoints. A code spans two words of 32 bits at most, and no two share a bit."""
        if not len(ids):
            return b"", np.zeros(0, np.uint64)
        bits = self.lengths[ids].astype(np.int64)
        if not bits.all():
            raise ValueError("an id has no code")
        at = np.cumsum(bits) - bits
        value = self.codes[ids] << (64 - bits - (at & 31)).astype(np.uint64)
        word = at >> 5
        first = np.concatenate([[0], np.flatnonzero(np.diff(word)) + 1])
        words = np.zeros(len(first) + 1, np.uint64)
        words[:-1] += np.add.reduceat(value >> np.uint64(32), first)
        words[1:] += np.add.reduceat(value & np.uint64(0xFFFFFFFF), first)
        size = int(at[-1] + bits[-1] + 7) // 8
        return words.astype(">u4").tobytes()[:size], at[::STRIDE].astype("<u8")

    def decode(self, payload: bytes, checkpoints: np.ndarray, n: int) -> np.ndarray:
        """The n ids of a payload: the stretches between checkpoints side by side, one id of each at a time."""
        raw = np.frombuffer(payload + bytes(8), np.uint8).astype(np.uint32)
        window = raw[:-3] << 24 | raw[1:-2] << 16 | raw[2:-1] << 8 | raw[3:]
        at, last = checkpoints.astype(np.int64), len(window) - 1
        mask, high = np.uint32((1 << self.limit) - 1), 32 - self.limit
        out = np.empty((min(n, STRIDE), len(at)), np.uint32)
        for step in range(len(out)):
            code = window[np.minimum(at >> 3, last)] >> (high - (at & 7)).astype(np.uint32) & mask
            out[step] = self.ids_of[code]
            at += self.bits_of[code]
        return out.T.ravel()[:n] if len(at) else np.zeros(0, np.uint32)


#: The normalizer and the pre-tokenizer pattern of word-level vocabularies of this kind.
NORMALIZER = ["NFC", "Replace", "Lowercase"]
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
#: The same pieces of lower-case words of printable ASCII and Latin-1 letters, and such words.
PIECES = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^a-zß-öø-ÿ0-9]+").findall
PLAIN = re.compile("[!-~À-ÖØ-öø-ÿ]+").fullmatch


class Words:
    """Ids of texts by a vocabulary file of that kind, word by word: white space ends a pre-token and is dropped.

    A word that was met before is looked up; another one is put together from its pieces, which are looked up or
    encoded. Only words of other characters, or with a special string, are encoded whole. When `cache_words` words (or half
    as many pieces) are known, they make place and are taken over one by one as they occur again, so that frequent ones
    stay and about twice as many are held at most.
    """

    def __init__(self, path: str, cache_words: int = 800_000):
        self.tokenizer, self.cache_words = _tokenizer(path), cache_words
        spec = json.loads(self.tokenizer.to_str())
        steps = [x["type"] for x in (spec["normalizer"] or {}).get("normalizers", [])]
        split = ((spec["pre_tokenizer"] or {}).get("pretokenizers") or [{}])[0]
        if steps != NORMALIZER or split.get("pattern") != {"Regex": PATTERN} or not spec["model"].get("end_of_word_suffix") or any(a["lstrip"] or a["rstrip"] for a in spec["added_tokens"]):
            raise ValueError(f"not a word-level vocabulary whose pre-tokens white space ends: {path}")
        self.special = [a["content"] for a in spec["added_tokens"]]
        self.kind = "<u2" if self.tokenizer.get_vocab_size(with_added_tokens=True) <= 1 << 16 else "<u4"
        suffix = spec["model"]["end_of_word_suffix"]
        self.ends = np.zeros(max(self.tokenizer.get_vocab().values()) + 1, bool)
        for token, i in self.tokenizer.get_vocab().items():
            self.ends[i] = token.endswith(suffix)
        self.known: dict[bytes, bytes] = {}
        self.older: dict[bytes, bytes] = {}
        self.pieces: dict[str, bytes] = {}
        self.older_pieces: dict[str, bytes] = {}

    def _whole(self, words: list[str]) -> list[bytes]:
        return [np.array(e.ids, self.kind).tobytes() for e in self.tokenizer.encode_batch_fast(words, add_special_tokens=False)]

    def _encoded(self, pieces: list[str], at_once: int = 1000) -> Iterator[bytes]:
        """Ids of pieces, each of which is one pre-token: they are encoded as one text, and every last token ends a piece."""
        size = np.dtype(self.kind).itemsize
        for i in range(0, len(pieces), at_once):
            some = pieces[i : i + at_once]
            ids = np.array(self.tokenizer.encode_batch_fast([" ".join(some)], add_special_tokens=False)[0].ids, self.kind)
            ends = (np.flatnonzero(self.ends[ids]) + 1) * size
            if len(ends) == len(some):
                raw = ids.tobytes()
                yield from (raw[a:b] for a, b in zip([0, *ends.tolist()], ends.tolist(), strict=False))
            else:
                yield from self._whole(some)

    def _learn(self, missing: set[bytes]) -> None:
        """Puts missing words into self.known."""
        if len(self.known) + len(missing) > self.cache_words:
            self.known, self.older = {}, self.known
        if 2 * len(self.pieces) > self.cache_words:
            self.pieces, self.older_pieces = {}, self.pieces
        joined = b" ".join(missing)
        special = [x for x in self.special if x.encode() in joined]
        cut, whole, asked = {}, [], set()
        older = self.older.get
        for w in missing:
            if (got := older(w)) is not None:
                self.known[w] = got
            elif w.isalpha():  # letters of ASCII: one piece
                cut[w] = piece = (w.decode().lower(),)
                asked.update(piece)
            elif PLAIN(t := w.decode("utf-8", "replace")) and not any(x in t for x in special):
                cut[w] = PIECES(t.lower())
                asked.update(cut[w])
            else:
                whole.append(w)
        asked.difference_update(self.pieces)
        fresh = []
        for p in asked:
            if (got := self.older_pieces.get(p)) is not None:
                self.pieces[p] = got
            else:
                fresh.append(p)
        self.pieces.update(zip(fresh, self._encoded(fresh), strict=True))
        self.known.update(zip(whole, self._whole([w.decode("utf-8", "replace") for w in whole]), strict=True))
        of = self.pieces.__getitem__
        self.known.update((w, of(x[0]) if len(x) == 1 else b"".join(map(of, x))) for w, x in cut.items())
        for p in fresh:
            if len(p) >= LONG:  # what is kept is bounded in bytes, too
                del self.pieces[p]

    def ids(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts (strings without nulls) one after the other, and how many each has.

        Words are split and told apart by Arrow's kernels; only different ones are looked up, and their ids are laid out for
        every word by numpy.
        """
        parts = pc.ascii_split_whitespace(texts)
        words = parts.flatten().dictionary_encode()
        distinct = words.dictionary.cast(pa.binary()).to_pylist()
        found = list(map(self.known.get, distinct))
        missing = {w for w, x in zip(distinct, found, strict=True) if x is None}
        self._learn(missing)
        known = self.known
        found = [known[w] if x is None else x for w, x in zip(distinct, found, strict=True)]
        for w in missing:
            if len(w) >= LONG:
                del known[w]
        of = words.indices.to_numpy()
        sizes = np.fromiter(map(len, found), np.int64, len(found)) // np.dtype(self.kind).itemsize
        each = sizes[of]
        ends = np.concatenate([[0], np.cumsum(each)])
        at = np.repeat((np.cumsum(sizes) - sizes)[of] - ends[:-1], each) + np.arange(ends[-1])
        first = parts.offsets.to_numpy().astype(np.int64) - parts.offsets[0].as_py()
        return np.frombuffer(b"".join(found), self.kind)[at], np.diff(ends[first])


@lru_cache(2)
def _words(path: str, cache_words: int) -> Words:
    """One that a worker keeps from task to task."""
    return Words(path, cache_words)


@lru_cache(2)
def _codes(lengths: bytes) -> Codes:
    return Codes(lengths)


def token_ids(docs: DataFrame, path: str, end_id: int, cache_words: int = 800_000) -> DataFrame:
    """(doc_id, tie, ids): the ids of every whole text and the end id, in two bytes each if the vocabulary allows it, else four; tie numbers a task's rows."""
    bounded_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, row = _words(path, cache_words), 0
        for b in batches:
            texts = b.column("text").fill_null("")
            for i, j in _ranges(pc.binary_length(texts).to_numpy(), SLICE_BYTES):
                ids, n = words.ids(texts.slice(i, j - i))
                whole = np.insert(ids, np.cumsum(n), end_id)
                offsets = np.concatenate([[0], np.cumsum(n + 1)]) * whole.itemsize
                column = pa.LargeBinaryArray.from_buffers(pa.large_binary(), j - i, [None, pa.py_buffer(offsets), pa.py_buffer(whole)]).cast(pa.binary())
                yield pa.record_batch([b.column("doc_id").slice(i, j - i), pa.array(np.arange(row, row + j - i)), column], names=["doc_id", "tie", "ids"])
                row += j - i

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, tie long, ids binary")


def _ranges(sizes: np.ndarray, limit: int) -> Iterator[tuple[int, int]]:
    """Ranges of rows whose sizes add up to about limit; a larger row stands alone."""
    ends, i = np.cumsum(sizes), 0
    while i < len(sizes):
        j = max(i + 1, int(np.searchsorted(ends, (ends[i - 1] if i else 0) + limit, "right")))
        yield i, j
        i = j


def _ids_of(column: pa.Array, kind: str) -> tuple[np.ndarray, np.ndarray]:
    """All ids of a column of binaries, and how many each row has."""
    lengths = np.array([len(x) // np.dtype(kind).itemsize for x in column.to_pylist()], np.int64)
    return np.frombuffer(b"".join(column.to_pylist()), kind), lengths


def global_counts(ids: DataFrame, kind: str) -> np.ndarray:
    """How often each id occurs. A task hands on one row for each id that it has; the driver gets one for each id."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(0, np.int64)
        for b in batches:
            n = np.bincount(_ids_of(b.column("ids"), kind)[0])
            if len(n) < len(total):
                n, total = total, n
            n[: len(total)] += total
            total = n
        used = np.flatnonzero(total)
        yield pa.record_batch([pa.array(used, pa.int32()), pa.array(total[used], pa.int64())], names=["id", "n"])

    rows = ids.select("ids").mapInArrow(run, "id int, n long").groupBy("id").agg(F.sum("n").alias("n")).collect()
    out = np.zeros(max((r.id for r in rows), default=-1) + 1, np.int64)
    for r in rows:
        out[r.id] = r.n
    return out


def write(docs: DataFrame, vocabulary: str, path: str, end_id: int = 1, limit: int = 20, block_ids: int = 1 << 19, part_ids: int = 1 << 25) -> None:
    """Write every whole text of docs (doc_id, text; other columns are ignored) as ids of the vocabulary file, and an end id each, to a token file.

    Documents come in ascending order of doc_id. A null text is empty (the end id alone), a null doc_id comes first and
    stays null, rows that repeat are kept each (those of one doc_id in an order of their ids), a very long text is one
    block, and an empty table gives a file without blocks. The folder `path` must not exist yet.

    Texts are tokenised once, to a scratch table; the ids' counts over all of them make one code. Ids are then dealt by
    ranges of (doc_id, hash of the ids, number), so that rows of one doc_id don't meet in one task, and each range
    is encoded in blocks. Of the data the driver sees one count for each id and one sum for each part.
    """
    spark = docs.sparkSession
    kind = Words(vocabulary).kind
    ids = stored(token_ids(docs, vocabulary, end_id), "ids")
    counts = global_counts(ids, kind)
    lengths = code_lengths(counts, max(limit, int(max(np.count_nonzero(counts), 1) - 1).bit_length())).tobytes()
    code = spark.sparkContext.broadcast(lengths)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes = _codes(code.value)
        part, block, start = TaskContext.get().partitionId(), 0, 0
        held: list[tuple[list, np.ndarray, np.ndarray]] = []

        def flush() -> pa.RecordBatch:
            nonlocal block, start
            own = np.concatenate([h[2] for h in held]).astype("<u4")
            payload, checkpoints = codes.encode(own)
            row = {
                "part": part, "block": block, "start": start, "n_ids": len(own), "doc_ids": list(chain.from_iterable(h[0] for h in held)), "lengths": np.concatenate([h[1] for h in held]).tolist(),
                "checkpoints": checkpoints.tobytes(), "payload": payload, "crc": zlib.crc32(own),
            }
            block, start = block + 1, start + len(own)
            held.clear()
            return pa.RecordBatch.from_pylist([row], schema)

        size = 0
        for b in batches:
            names = b.column("doc_id").to_pylist()
            own, n = _ids_of(b.column("ids"), kind)
            ends, row = np.cumsum(n), 0
            while row < len(n):
                before = int(ends[row - 1]) if row else 0
                upto = min(int(np.searchsorted(ends, before + block_ids - size)) + 1, len(n))
                held.append((names[row:upto], n[row:upto], own[before : int(ends[upto - 1])]))
                size, row = size + int(ends[upto - 1]) - before, upto
                if size >= block_ids:
                    yield flush()
                    size = 0
        if held:
            yield flush()

    schema = pa.schema([(f.name, to_arrow_type(f.dataType)) for f in StructType.fromDDL(BLOCKS).fields])
    order = ["doc_id", F.xxhash64("ids"), "tie"]
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), int(counts.sum()) // part_ids)
    ids.repartitionByRange(parts, *order).sortWithinPartitions(*order).select("doc_id", "ids").mapInArrow(run, BLOCKS).write.parquet(f"{path}/blocks")
    sums = sorted(map(tuple, spark.read.schema(BLOCKS).parquet(f"{path}/blocks").groupBy("part").agg(F.sum("n_ids")).collect()))
    first = np.cumsum([0, *(n for _, n in sums)]).tolist()
    spark.createDataFrame([(p, f) for (p, _), f in zip(sums, first, strict=False)], "part int, first long").coalesce(1).write.parquet(f"{path}/parts")
    spark.createDataFrame([(lengths,)], "lengths binary").coalesce(1).write.parquet(f"{path}/codes")


def read_rows(spark: SparkSession, path: str, row: Callable[[np.ndarray], tuple], schema: str) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens and what row(ids) returns, for every document of a token file. A block whose ids don't have its checksum raises."""
    bounded_batches(spark)
    code = spark.sparkContext.broadcast(bytes(spark.read.schema("lengths binary").parquet(f"{path}/codes").first().lengths))
    fields = [(f.name, to_arrow_type(f.dataType)) for f in StructType.fromDDL(schema).fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes = _codes(code.value)
        for b in batches:
            for r in b.to_pylist():
                ids = codes.decode(r["payload"], np.frombuffer(r["checkpoints"], "<u8"), r["n_ids"])
                if zlib.crc32(ids) != r["crc"]:
                    raise ValueError(f"block {r['block']} of part {r['part']} is damaged")
                n = np.array(r["lengths"], np.int64)
                ends = np.cumsum(n)
                rows = [row(ids[e - k : e]) for e, k in zip(ends.tolist(), r["lengths"], strict=True)]
                cols = [pa.array(c, t) for c, (_, t) in zip(zip(*rows, strict=True), fields, strict=True)]
                own = [pa.array(r["doc_ids"], pa.int64()), pa.array(r["first"] + r["start"] + ends - n, pa.int64()), pa.array(n, pa.int64())]
                yield pa.record_batch([*own, *cols], names=["doc_id", "start", "n_tokens", *(name for name, _ in fields)])

    blocks, parts = spark.read.schema(BLOCKS).parquet(f"{path}/blocks"), spark.read.schema("part int, first long").parquet(f"{path}/parts")
    return blocks.join(parts, "part").mapInArrow(run, f"doc_id long, start long, n_tokens long, {schema}")


def read(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens and ids (array of int) of every document of a token file."""
    return read_rows(spark, path, lambda ids: (ids.tolist(),), "ids array<int>")


def round_trip(docs: DataFrame, vocabulary: str, end_id: int = 1) -> DataFrame:
    """docs written to a token file in the shared folder and read back: doc_id, start, n_tokens, ids_crc32."""
    path = scratch(docs.sparkSession, "tokens")
    write(docs, vocabulary, path, end_id)
    return read_rows(docs.sparkSession, path, lambda ids: (zlib.crc32(ids),), "ids_crc32 long")
