"""Byte-level BPE: encoding and decoding of whole texts with a given vocabulary.

Two tiers. A minimal perfect hash over the vocabulary resolves every pre-token that is
itself a token; any other pre-token goes through a heap of adjacent pairs over a linked
list of its bytes, lowest rank first and leftmost among equals. Both tiers are pure
functions of a pre-token, so results are kept in a bounded memo per worker process.

Between two characters that are not white space, a single space always opens a new
pre-token under the usual patterns; so a text splits there at C speed and the slow
Unicode pattern runs only on pieces not met before. Texts with other white space beside
a space take the pattern as a whole; both ways give the same pre-tokens.

Defined cases: a null text is the empty text and has no ids. Lone surrogates can't occur
in a Spark string. Columns other than the id and the text are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
import sys
from array import array

import numpy as np
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkfold.llm.common import Bounded, prepare

WORDS, PIECES = 100_000, 300_000


def read_ranks(path: str) -> dict[bytes, int]:
    """Token bytes to id, from a file of base64 tokens and ranks."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


class PerfectHash:
    """Minimal perfect hash of byte strings: hash, then displace by bucket.

    Each of ``n`` keys has its own of ``n`` slots. Buckets are placed from the largest;
    a bucket of one key stores its slot itself (as -1 - slot). ``get`` compares the key in
    the slot, so strings outside the set give None.
    """

    def __init__(self, keys: list[bytes], seed: int = 1):
        n = self.n = len(keys)
        self.m = max(1, n // 2)
        while True:
            self.seed = seed
            hashes = [xxhash.xxh3_64_intdigest(k, seed) for k in keys]
            if len(set(hashes)) == n and self._place(hashes):
                break
            seed += 1
        self.keys: list[bytes] = [b""] * n
        for k, h in zip(keys, hashes, strict=True):
            self.keys[self._slot(h)] = k

    def _slot(self, h: int) -> int:
        d = self.shift[h % self.m]
        return -1 - d if d < 0 else ((h >> 17) + d * ((h >> 41) | 1)) % self.n

    def _place(self, hashes: list[int]) -> bool:
        buckets: list[list[int]] = [[] for _ in range(self.m)]
        for h in hashes:
            buckets[h % self.m].append(h)
        self.shift, taken, free = [0] * self.m, bytearray(self.n), 0
        for b in sorted(range(self.m), key=lambda b: -len(buckets[b])):
            own = buckets[b]
            if not own:
                break
            if len(own) == 1:
                while taken[free]:
                    free += 1
                taken[free], self.shift[b] = 1, -1 - free
                continue
            for d in range(self.n):
                slots = {((h >> 17) + d * ((h >> 41) | 1)) % self.n for h in own}
                if len(slots) == len(own) and not any(taken[s] for s in slots):
                    break
            else:
                return False
            self.shift[b] = d
            for s in slots:
                taken[s] = 1
        return True

    def slot(self, key: bytes) -> int | None:
        s = self._slot(xxhash.xxh3_64_intdigest(key, self.seed))
        return s if self.keys[s] == key else None


class Vocabulary:
    """What encoding and decoding need; built on the driver, of the vocabulary's size."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks, self.pattern = ranks, pattern
        self.hash = PerfectHash(list(ranks))
        self.ids = [ranks[k] for k in self.hash.keys]
        self.key = hashlib.sha256(pattern.encode() + b"".join(self.hash.keys) + np.array(self.ids, "<u4").tobytes()).hexdigest()


def merge_by_heap(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of a piece by successive merges over linked bytes."""
    n = len(piece)
    after, before, rank, push, pop = list(range(1, n + 2)), list(range(-1, n)), ranks.get, heapq.heappush, heapq.heappop
    bits = n.bit_length()
    low = (1 << bits) - 1
    heap = [(r << bits | i) << bits | i + 2 for i in range(n - 1) if (r := rank(piece[i : i + 2])) is not None]  # rank, start, end
    heapq.heapify(heap)
    while heap:
        top = pop(heap)
        i, end = top >> bits & low, top & low
        mid = after[i]
        if mid < 0 or after[mid] != end or mid == n:  # one of the two is gone or has grown
            continue
        after[i], after[mid] = end, -1
        if end < n:
            before[end] = i
            if (r := rank(piece[i : after[end]])) is not None:
                push(heap, (r << bits | i) << bits | after[end])
        if (p := before[i]) >= 0 and (r := rank(piece[p:end])) is not None:
            push(heap, (r << bits | p) << bits | end)
    out, i = [], 0
    while i < n:
        out.append(ranks[piece[i : after[i]]])
        i = after[i]
    return out


def _le(ids: array) -> bytes:
    if sys.byteorder == "big":
        ids.byteswap()
    return ids.tobytes()


class _Mixed(Exception):
    """White space other than single spaces between words."""


class Texts:
    """Encodes texts piece by piece: ``encode(text)`` gives the ids as little-endian uint32 bytes."""

    def __init__(self, pattern: str, piece_ids, words: int = WORDS, pieces: int = PIECES):
        self.find = regex.compile(pattern).findall
        self.piece_ids = piece_ids
        self.by_word = Bounded(self._word, words)
        self.by_piece = Bounded(self._piece, pieces)

    def _piece(self, piece: str) -> bytes:
        return _le(array("I", self.piece_ids(piece.encode("utf-8", "surrogatepass"))))

    def _pieces(self, text: str) -> bytes:
        return b"".join(map(self.by_piece.__getitem__, self.find(text)))

    def _word(self, word: str) -> bytes:
        if not word or word[0].isspace() or word[-1].isspace():
            raise _Mixed
        return self._pieces(" " + word)

    def encode(self, text: str) -> bytes:
        words = text.split(" ")
        if len(words) < 3 or not words[0] or words[0][-1].isspace() or not words[-1] or words[-1][0].isspace():
            return self._pieces(text)
        first, last = words[0], words.pop()
        del words[0]
        try:
            inner = b"".join(map(self.by_word.__getitem__, words))
        except _Mixed:
            return self._pieces(text)
        return self._pieces(first) + inner + self._pieces(" " + last)


class Codec(Texts):
    """Both directions for a vocabulary."""

    def __init__(self, vocabulary: Vocabulary):
        self.vocabulary = vocabulary
        self.bytes_of = {i: k for k, i in vocabulary.ranks.items()}
        self.text_of = {i: str(i) for i in self.bytes_of}
        super().__init__(vocabulary.pattern, self._ids)

    def _ids(self, piece: bytes) -> list[int]:
        slot = self.vocabulary.hash.slot(piece)
        return [self.vocabulary.ids[slot]] if slot is not None else merge_by_heap(piece, self.vocabulary.ranks)

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids))


_CODECS: dict[str, Codec] = {}


def codec(vocabulary: Vocabulary) -> Codec:
    """This process's codec; its memo serves all tasks that the worker runs."""
    if vocabulary.key not in _CODECS:
        _CODECS.clear()
        _CODECS[vocabulary.key] = Codec(vocabulary)
    return _CODECS[vocabulary.key]


def encode(docs: DataFrame, ranks_path: str, pattern: str, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, ids array<int>): the ids of every whole text."""
    vocabulary = _shipped(docs, ranks_path, pattern)

    def run(batches):
        c = codec(vocabulary.value)
        for batch in batches:
            ids = [np.frombuffer(c.encode(t or ""), "<i4") for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.list_(pa.int32()))], ["doc_id", "ids"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, f"doc_id {kind}, ids array<int>")


def decode(encoded: DataFrame, ranks_path: str, pattern: str, *, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """(doc_id, bytes binary): the bytes that the ids stand for."""
    vocabulary = _shipped(encoded, ranks_path, pattern)

    def run(batches):
        c = codec(vocabulary.value)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([c.decode(ids or []) for ids in batch.column(1).to_pylist()], pa.binary())], ["doc_id", "bytes"])

    kind = encoded.schema[id_col].dataType.simpleString()
    return encoded.select(F.col(id_col).alias("doc_id"), F.col(ids_col).alias("ids")).mapInArrow(run, f"doc_id {kind}, bytes binary")


def round_trip(docs: DataFrame, ranks_path: str, pattern: str, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256): encodes, then decodes those ids, in one pass."""
    vocabulary = _shipped(docs, ranks_path, pattern)

    def run(batches):
        c = codec(vocabulary.value)
        for batch in batches:
            n, of_ids, of_bytes = [], [], []
            for text in batch.column(1).to_pylist():
                ids = np.frombuffer(c.encode(text or ""), "<u4").tolist()
                n.append(len(ids))
                of_ids.append(hashlib.sha256(",".join(map(c.text_of.__getitem__, ids)).encode()).hexdigest())
                of_bytes.append(hashlib.sha256(c.decode(ids)).hexdigest())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n, pa.int64()), pa.array(of_ids, pa.string()), pa.array(of_bytes, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
            )

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")


def _shipped(df: DataFrame, ranks_path: str, pattern: str):
    """The vocabulary as a broadcast variable: its size is that of the vocabulary file, not of the data."""
    spark = prepare(df.sparkSession)
    return spark.sparkContext.broadcast(Vocabulary(read_ranks(ranks_path), pattern))
