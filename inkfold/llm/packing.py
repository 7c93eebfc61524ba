"""Packing: token sequences of a fixed size from whole documents, with little padding.

A document of n ids gives n // size full pieces, each a sequence of its own, and one
remainder. Remainders are packed by minimum bin slack: only the histogram of remainder
lengths (fewer than ``size`` counts, whatever the corpus) goes to the driver. There a
window takes the longest remainder left, a bitset subset-sum dynamic programme finds the
multiset of other lengths that fills it closest to capacity, counts are backtracked, and
that pattern is used as often as the counts allow. Where no multiset comes near enough
(as when one length holds most of the rows), remainders of the most frequent length are
cut, and their fronts fill the windows. Only the corpus' last window can stay half empty.

The plan speaks of ranks within a length, so it is as small as the histogram; each
remainder finds its place from its rank, by prefix sums over input partitions. That table
has a row for each pair of input partition and length at most, so it grows with the number of
tasks: the planner broadcasts it while it is small, and joins by (length, task) beyond. Checksums
of all possible pieces are taken while a text is encoded: texts are read once.

Defined cases: a null text is the empty text, one piece with the end id alone. The string of an
added token of the vocabulary file gets that token's id, as the library does by default. Rows that
repeat an id are packed separately. An empty table gives an empty result. Columns other
than the id and the text are ignored.
"""

from __future__ import annotations

import json
import re
import zlib
from bisect import bisect_right
from collections import defaultdict, deque

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from inkfold.llm.common import prepare, written

SIZE = 2048
END_ID = 1
#: Remainders are cut at multiples of this only; a window is closed when less is left.
GRAIN = 32
LOOK_AHEAD = r"\s+(?!\S)|"
SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
PIECES = "doc_id long, n long, rest int, task int, rank long, chunk long, full array<long>, crcs array<long>"


def fill(counts: dict[int, int], capacity: int) -> dict[int, int]:
    """The multiset of lengths, within their counts, whose sum comes closest to capacity from below.

    Frequent lengths go first, so that an exact filling draws on what is plentiful.
    """
    if capacity <= 0:
        return {}
    mask, reach, steps = (1 << (capacity + 1)) - 1, 1, []
    for length in sorted(counts, key=lambda x: (-counts[x], -x)):
        left, k = min(counts[length], capacity // length) if length else 0, 1
        while left > 0:
            k = min(k, left)
            steps.append((length, k, reach))
            reach |= reach << (length * k) & mask
            left, k = left - k, k * 2
        if reach >> capacity & 1:
            break
    at, chosen = reach.bit_length() - 1, defaultdict(int)
    for length, k, earlier in reversed(steps):
        if not earlier >> at & 1:
            at -= length * k
            chosen[length] += k
    return dict(chosen)


class Plan:
    """Where remainders go.

    ``rows[length, start]`` lists, for pieces that begin at ``start`` of remainders of
    ``length``: (first rank, count, index, piece length, sequence, pieces per window, offset).
    """

    def __init__(self, histogram: dict[int, int], size: int = SIZE, grain: int = GRAIN):
        self.size, self.grain, self.rows, self.sequences = size, grain, defaultdict(list), 0
        self.counts = {x: n for x, n in histogram.items() if x > 0 and n > 0}
        #: By piece length: runs of (length of the remainder, first rank, count, start in the remainder).
        self.pool = {x: deque([(x, 0, n, 0)]) for x, n in self.counts.items()}
        self._pack()
        for rows in self.rows.values():
            rows.sort()

    def _take(self, length: int, n: int):
        self.counts[length] -= n
        if not self.counts[length]:
            del self.counts[length]
        runs = self.pool[length]
        while n:
            origin, rank, count, start = runs.popleft()
            k = min(n, count)
            if k < count:
                runs.appendleft((origin, rank + k, count - k, start))
            n -= k
            yield origin, rank, k, start

    def _use(self, pattern: dict[int, int], times: int, cut: tuple[int, int] | None = None) -> None:
        """``times`` windows of this pattern, each also with the first ``cut[1]`` ids of a piece of length ``cut[0]``."""
        offset = 0
        for length, each in sorted(pattern.items(), reverse=True):
            index = 0
            for origin, rank, k, start in self._take(length, each * times):
                self.rows[origin, start].append((rank, k, index, length, self.sequences, each, offset))
                index += k
            offset += each * length
        if cut:
            (length, part), index = cut, 0
            for origin, rank, k, start in list(self._take(length, times)):
                self.rows[origin, start].append((rank, k, index, part, self.sequences, 1, offset))
                self.pool.setdefault(length - part, deque()).append((origin, rank, k, start + part))
                self.counts[length - part] = self.counts.get(length - part, 0) + k
                index += k
        self.sequences += times

    def _pack(self) -> None:
        while self.counts:
            longest = max(self.counts)
            rest = {x: n - (x == longest) for x, n in self.counts.items() if n > (x == longest)}
            pattern = fill(rest, self.size - longest)
            pattern[longest] = pattern.get(longest, 0) + 1
            slack, cut = self.size - sum(x * n for x, n in pattern.items()), None
            if (part := slack // self.grain * self.grain) > 0:
                # Each window also takes the front of a frequent piece that is longer.
                left = {x: n // (pattern.get(x, 0) + 1) for x, n in self.counts.items() if x > part}
                y = max(left, key=lambda x: (left[x], x), default=0)
                if y and left[y]:
                    cut = (y, part)
            used = dict(pattern)
            if cut:
                used[cut[0]] = used.get(cut[0], 0) + 1
            self._use(pattern, min(self.counts[x] // n for x, n in used.items()), cut)

    def place(self, length: int, rank: int) -> list[tuple[int, int, int, int]]:
        """(start in the remainder, piece length, sequence, offset there) of each piece of a remainder."""
        out, start = [], 0
        while start < length:
            rows = self.rows[length, start]
            first, _, index, piece, sequence, each, offset = rows[bisect_right(rows, (rank, float("inf"))) - 1]
            i = index + rank - first
            out.append((start, piece, sequence + i // each, offset + i % each * piece))
            start += piece
        return out


def crc_joined(a: int, b: int, n: int) -> int:
    """CRC-32 of two byte strings one after the other, from their own and the second's length; also its inverse in b."""
    zeros = bytes(n)
    return zlib.crc32(zeros, a) ^ zlib.crc32(zeros) ^ b


class Encoder:
    """Ids of a vocabulary file of the ``tokenizers`` library (byte-level BPE), as little-endian uint32 bytes.

    The file's tokens and merges become ranks; as merges are numbered in the order in
    which they apply, the ids equal that library's. As there, the file's added tokens get their
    own ids wherever their strings stand in a text, which is cut there first (``specials``: string to id).
    A text without two white-space characters in a row needs no look-ahead in the pattern,
    and matches several times as fast without it.
    """

    def __init__(self, ranks: dict[bytes, int], pattern: str, specials: dict[str, int] | None = None):
        make = lambda p: tiktoken.Encoding("packing", pat_str=p, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        self.any, self.plain = make(pattern), make(pattern.replace(LOOK_AHEAD, ""))
        self.runs = re.compile(r"\s\s").search if LOOK_AHEAD in pattern else bool
        self.specials = specials or {}
        self.cut = re.compile("|".join(re.escape(t) for t in sorted(self.specials, key=lambda t: (-len(t), t)))) if self.specials else None

    def encode(self, text: str) -> bytes:
        if self.cut is None or not self.cut.search(text):
            return self._plain(text)
        out, at = [], 0
        for m in self.cut.finditer(text):
            out += [self._plain(text[at : m.start()]), self.specials[m[0]].to_bytes(4, "little")]
            at = m.end()
        return b"".join([*out, self._plain(text[at:])])

    def _plain(self, text: str) -> bytes:
        return np.array((self.any if self.runs(text) else self.plain)(text), "<u4").tobytes()


def byte_level(path: str) -> tuple[dict[bytes, int], dict[str, int]]:
    """Token bytes to ids, and added tokens to ids, from a byte-level BPE file whose merges are numbered in order."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]  # printable bytes stand for themselves, the others follow from 256
    letters = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in set(plain))}
    special = {t["content"]: t["id"] for t in spec["added_tokens"] if t["content"]}
    if any(t.get(flag) for t in spec["added_tokens"] for flag in ("single_word", "lstrip", "rstrip")):
        raise ValueError("added tokens that look at their neighbours aren't supported")
    vocabulary = {t: i for t, i in spec["model"]["vocab"].items() if t not in special}
    order = [vocabulary["".join(m) if isinstance(m, list) else m.replace(" ", "", 1)] for m in spec["model"]["merges"]]
    if order != sorted(order):
        raise ValueError("the merges of this vocabulary aren't numbered in order")
    return {bytes(letters[c] for c in t): i for t, i in vocabulary.items()}, special


_ENCODERS: dict[tuple, Encoder] = {}


def _pieces(ranks, pattern: str, path: str, size: int, end_id: int):
    def run(batches):
        if (path, pattern) not in _ENCODERS:
            _ENCODERS.clear()
            _ENCODERS[path, pattern] = Encoder(ranks.value[0], pattern, ranks.value[1])
        encode, task = _ENCODERS[path, pattern].encode, TaskContext.get().partitionId()
        end, step = end_id.to_bytes(4, "little"), 4 * size
        ranks_of, chunks = defaultdict(int), 0
        for batch in batches:
            cols = [[] for _ in range(7)]
            for text in batch.column(1).to_pylist():
                ids = encode(text or "") + end
                n = len(ids) // 4
                full, rest = n // size, n % size
                tail = ids[full * step :]
                crcs, crc = [], 0  # of the remainder's first GRAIN, 2 * GRAIN, ... ids, and of all
                for at in range(0, len(tail), 4 * GRAIN):
                    crcs.append(crc := zlib.crc32(tail[at : at + 4 * GRAIN], crc))
                row = (n, rest, task, ranks_of[rest], chunks, [zlib.crc32(ids[i * step : (i + 1) * step]) for i in range(full)], crcs)
                ranks_of[rest] += 1
                chunks += full
                for c, x in zip(cols, row, strict=True):
                    c.append(x)
            kinds = [pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64())]
            arrays = [pa.array(c, k) for c, k in zip(cols, kinds, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), *arrays], ["doc_id", "n", "rest", "task", "rank", "chunk", "full", "crcs"])

    return run


def _placed(plan, size: int):
    def run(batches):
        p: Plan = plan.value
        for batch in batches:
            out = [[] for _ in range(7)]
            doc, n, rest, task, rank, chunk, full, crcs = (batch.column(i).to_pylist() for i in range(8))
            for i in range(len(doc)):
                rows = [(j * size, size, crc, p.sequences + (task[i] << 36) + chunk[i] + j, 0) for j, crc in enumerate(full[i])]
                base = n[i] - rest[i]
                for start, piece, sequence, offset in p.place(rest[i], rank[i]):
                    crc = crcs[i][-1 if start + piece == rest[i] else (start + piece) // GRAIN - 1]
                    if start:
                        crc = crc_joined(crcs[i][start // GRAIN - 1], crc, 4 * piece)
                    rows.append((base + start, piece, crc, sequence, offset))
                for start, piece, crc, sequence, offset in rows:
                    for c, x in zip(out, (doc[i], start, piece, crc, n[i], sequence, offset), strict=True):
                        c.append(x)
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in out], SCHEMA.replace(" long", "").split(", "))

    return run


def pack(docs: DataFrame, vocabulary_path: str, pattern: str, *, id_col: str = "doc_id", text_col: str = "text", size: int = SIZE, end_id: int = END_ID) -> DataFrame:
    """One row per piece: (doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset).

    Sequences of remainders are numbered from 0, those of full pieces after them, with gaps.
    """
    spark = prepare(docs.sparkSession)
    if not 2 <= size <= 1 << 16 or size & (size - 1):
        raise ValueError("size must be a power of two up to 65536: the plan's cost depends on it")
    ranks = spark.sparkContext.broadcast(byte_level(vocabulary_path))
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    pieces = written(docs.mapInArrow(_pieces(ranks, pattern, vocabulary_path, size, end_id), PIECES), "pieces")

    by_task = pieces.groupBy("rest", "task").agg(F.count(F.lit(1)).alias("n_rows"))
    before = F.sum("n_rows").over(Window.partitionBy("rest").orderBy("task").rowsBetween(Window.unboundedPreceding, -1))
    by_task = written(by_task.select("rest", "task", "n_rows", F.coalesce(before, F.lit(0)).alias("before")), "ranks")
    histogram = {r["rest"]: r["n"] for r in by_task.groupBy("rest").agg(F.sum("n_rows").alias("n")).collect()}  # below `size` rows
    plan = spark.sparkContext.broadcast(Plan(histogram, size))
    ranked = pieces.join(by_task, ["rest", "task"]).select("doc_id", "n", "rest", "task", (F.col("rank") + F.col("before")).alias("rank"), "chunk", "full", "crcs")
    return ranked.mapInArrow(_placed(plan, size), SCHEMA)
