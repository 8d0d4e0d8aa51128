"""Byte-level BPE by dynamic programming over prefixes."""

from __future__ import annotations

import json
from array import array
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import StructType

from .common import bounded_batches, slices

#: Fixed value: the pre-tokenizer pattern that byte-level vocabularies of this kind use.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def _byte_of_char() -> dict[str, int]:
    """The printable stand-in of each byte in a byte-level vocabulary, inverted: printable Latin-1 stands for itself, the rest follows from 256 on."""
    plain = {b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255}
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


def _supported(spec: dict) -> None:
    """Raises if the vocabulary file asks for steps that aren't done here."""
    pre, added = spec.get("pre_tokenizer") or {}, spec.get("added_tokens", [])
    plain = pre.get("type") == "ByteLevel" and not pre.get("add_prefix_space") and pre.get("use_regex", True) and not spec.get("normalizer")
    strips = [a["content"] for a in added if a.get("lstrip") or a.get("rstrip") or a.get("single_word")]
    if not plain or spec["model"]["type"] != "BPE" or strips:
        raise ValueError(f"not a plain byte-level BPE file: pre_tokenizer {pre}, normalizer {spec.get('normalizer')}, model {spec['model']['type']}, stripping added tokens {strips}")


class Codec:
    """Exact ids of a byte-level BPE vocabulary file, and texts of ids.

    A prefix of a pre-token has exactly one encoding, hence one last token. An automaton over the vocabulary names the
    tokens that end at each byte; the one whose predecessor (the last token of what precedes it) forms a pair that BPE
    keeps apart is stored. Following those back from the end gives the ids.
    """

    def __init__(self, path: str, cache_words: int = 800_000):
        import ahocorasick
        import regex

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        _supported(spec)
        back = _byte_of_char()
        vocab = spec["model"]["vocab"]
        raw = {i: bytes(back[c] for c in t) for t, i in vocab.items()}
        self.special = {a["content"]: a["id"] for a in spec["added_tokens"]}
        self.bytes_of = [b""] * (max([*raw, *self.special.values()]) + 1)
        for i, t in raw.items():
            self.bytes_of[i] = t
        for t, i in self.special.items():
            self.bytes_of[i] = t.encode()
        #: rank[t]: when BPE makes t (bytes: -1); parts[t]: what it makes t of; made[pair]: the token of a merge.
        self.rank, self.parts, self.made = [-1] * len(self.bytes_of), [None] * len(self.bytes_of), {}
        for r, m in enumerate(spec["model"]["merges"]):
            a, b = m.split(" ") if isinstance(m, str) else m
            t = vocab[a + b]
            if self.rank[t] < 0:
                self.rank[t], self.parts[t] = r, (vocab[a], vocab[b])
            self.made[vocab[a], vocab[b]] = (r, t)
        self.ends = ahocorasick.Automaton()
        for i, t in raw.items():
            if t and (len(t) == 1 or self.rank[i] >= 0):
                self.ends.add_word(t.decode("latin-1"), (i, len(t)))
        self.ends.make_automaton()
        self.pieces = regex.compile(PATTERN).findall
        self.cut = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")").split if self.special else None
        self.apart: dict[tuple[int, int], bool] = {}
        self.whole: dict[int, bool] = {}
        self.known: dict[str, bytes] = {}
        self.cache_words = cache_words

    def _keeps(self, a: int, b: int) -> bool:
        """Whether BPE over the bytes of a and b ends in a, b: no merge across their border comes before both are complete.

        Going back in time, the later made of the two is undone first; what faces the border is then its inner part.
        A merge of the facing parts that comes before that moment would have joined them.
        """
        until, rank, parts, made = 1 << 60, self.rank, self.parts, self.made
        while True:
            m = made.get((a, b))
            if m is not None and m[0] < until:
                return False
            if parts[a] is None and parts[b] is None:
                return True
            if rank[a] > rank[b]:
                until, a = rank[a], parts[a][1]
            else:
                # Of equal merges the left one comes first, hence the 1.
                until, b = rank[b] + 1, parts[b][0]

    def _single(self, t: int) -> bool:
        """Whether the bytes of t encode to t alone."""
        got = self.whole.get(t)
        if got is None:
            p = self.parts[t]
            got = self.whole[t] = p is None or self._chain(self.bytes_of[t]) == [t]
        return got

    def _chain(self, data: bytes) -> list[int]:
        """Merging by rank, leftmost first: the definition, used to vet a token once."""
        ids = [self._byte_id(x) for x in data]
        while len(ids) > 1:
            best = min(((self.made[p][0], k) for k, p in enumerate(zip(ids, ids[1:], strict=False)) if p in self.made), default=None)
            if best is None:
                break
            k = best[1]
            ids[k : k + 2] = [self.made[ids[k], ids[k + 1]][1]]
        return ids

    def _byte_id(self, x: int) -> int:
        return self.ends.get(chr(x))[0]

    def piece(self, text: str) -> list[int]:
        """Ids of one pre-token."""
        s = text.encode("utf-8", "surrogatepass").decode("latin-1")
        last, size = [-1] * (len(s) + 1), [0] * (len(s) + 1)
        apart = self.apart
        for end, (t, n) in self.ends.iter(s):
            end += 1
            if last[end] >= 0:
                continue
            start = end - n
            if start == 0:
                ok = self._single(t)
            else:
                before = last[start]
                if before < 0:
                    continue
                ok = apart.get((before, t))
                if ok is None:
                    if len(apart) > 2_000_000:
                        apart.clear()
                    ok = apart[before, t] = self._single(t) and self._keeps(before, t)
            if ok:
                last[end], size[end] = t, n
        ids, at = [], len(s)
        while at:
            if last[at] < 0:
                raise ValueError(f"the vocabulary has no encoding that ends at byte {at} of {text[:80]!r}")
            ids.append(last[at])
            at -= size[at]
        ids.reverse()
        return ids

    def _ordinary(self, text: str) -> list[bytes]:
        parts, known = self.pieces(text), self.known
        try:
            return list(map(known.__getitem__, parts))
        except KeyError:
            missing = set(parts).difference(known)
            if len(known) + len(missing) > self.cache_words:
                known.clear()
                missing = set(parts)
            for p in missing:
                known[p] = array("I", self.piece(p)).tobytes()
            out = list(map(known.__getitem__, parts))
            for p in missing:
                if len(p) >= 256:  # the cache is bounded in bytes, too
                    del known[p]
            return out

    def encode(self, text: str) -> bytes:
        """Ids of a whole text as little-endian unsigned 32-bit integers; special strings give their own id."""
        if self.cut is None or not any(s in text for s in self.special):
            return b"".join(self._ordinary(text))
        out: list[bytes] = []
        for k, part in enumerate(self.cut(text)):
            out += [array("I", [self.special[part]]).tobytes()] if k % 2 else self._ordinary(part)
        return b"".join(out)

    def decode(self, ids: bytes) -> str:
        return b"".join(map(self.bytes_of.__getitem__, memoryview(ids).cast("I"))).decode("utf-8", "replace")


def encode_rows(docs: DataFrame, path: str, row: Callable[[bytes, str], tuple], schema: str) -> DataFrame:
    """doc_id and what row(ids, decoded text) returns, for every whole text of docs (doc_id, text; other columns are ignored).

    A null text is empty: no ids. Repeated rows give a row each, a null doc_id stays null, a very long text or word is
    encoded whole, an empty table gives no rows.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    fields = [(f.name, to_arrow_type(f.dataType)) for f in StructType.fromDDL(schema).fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec(path)
        for b in batches:
            texts = [t or "" for t in b.column("text").to_pylist()]
            for i, j in slices(texts):
                rows = [row(ids := codec.encode(t), codec.decode(ids)) for t in texts[i:j]]
                cols = [pa.array(c, t) for c, (_, t) in zip(zip(*rows, strict=True), fields, strict=True)]
                yield pa.record_batch([b.column("doc_id").slice(i, j - i), *cols], names=["doc_id", *(n for n, _ in fields)])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, f"doc_id long, {schema}")


def encode(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, ids (array of int) and the text decoded from them."""
    return encode_rows(docs, path, lambda ids, text: (memoryview(ids).cast("I").tolist(), text), "ids array<int>, decoded string")
