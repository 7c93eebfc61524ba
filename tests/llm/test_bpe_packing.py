import functools
import hashlib
import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from inkfold.llm import bpe, packing

RANKS = P.path("byte_bpe_multi_50k.tiktoken")


@pytest.fixture(scope="module")
def library():
    return tiktoken.Encoding("t", pat_str=P.PATTERN, mergeable_ranks=bpe.read_ranks(RANKS), special_tokens={})


@pytest.fixture(scope="module")
def codec():
    return bpe.Codec(bpe.Vocabulary(bpe.read_ranks(RANKS), P.PATTERN))


def test_perfect_hash_is_minimal():
    keys = [f"key{i}".encode() for i in range(3000)] + [b""]
    h = bpe.PerfectHash(keys)
    assert sorted(h.slot(k) for k in keys) == list(range(len(keys)))
    assert h.slot(b"none") is None


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.sampled_from("ab Zé\n\t'sd1,.日 \x1c\x85😀 "), max_size=60))
def test_same_ids_as_library(library, codec, text):
    ids = np.frombuffer(codec.encode(text), "<u4").tolist()
    assert ids == library.encode_ordinary(text)
    assert codec.decode(ids) == text.encode()


def round_trip(frame, library):
    want = [(r["doc_id"], ids := library.encode_ordinary(r["text"] or ""), (r["text"] or "").encode()) for r in frame.collect()]
    found = bpe.round_trip(frame, RANKS, P.PATTERN).collect()
    sha = lambda b: hashlib.sha256(b).hexdigest()
    assert sorted(map(str, map(tuple, found))) == sorted(str((i, len(ids), sha(",".join(map(str, ids)).encode()), sha(t))) for i, ids, t in want)


def test_round_trip(docs, odd_docs, no_docs, library):
    for frame in (docs, odd_docs, no_docs):
        round_trip(frame, library)


def test_encode_and_decode(odd_docs):
    encoded = bpe.encode(odd_docs.where("doc_id is not null"), RANKS, P.PATTERN)
    back = {r["doc_id"]: bytes(r["bytes"]) for r in bpe.decode(encoded, RANKS, P.PATTERN).collect()}
    assert back == {r["doc_id"]: (r["text"] or "").encode() for r in odd_docs.where("doc_id is not null").collect()}


def check_packed(frame, size=2048):
    t = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    want = sorted(((r["doc_id"], [*t.encode(r["text"] or "", add_special_tokens=False).ids, 1]) for r in frame.collect()), key=str)
    rows = packing.pack(frame, P.path("byte_bpe_50k.json"), P.PATTERN, size=size).collect()
    filled, used, total = defaultdict(list), defaultdict(int), 0
    by_doc = defaultdict(list)
    for r in rows:
        filled[r["sequence_id"]].append((r["offset"], r["length"]))
        by_doc[r["doc_id"]].append(r)
    for pieces in filled.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at and length > 0
            at += length
        assert at <= size
        total += at if at & (at - 1) == 0 else size
    for doc_id, ids in want:
        own = sorted((r for r in by_doc[doc_id] if r["doc_tokens"] == len(ids)), key=lambda r: r["start"])
        for r in own:
            part = ids[r["start"] : r["start"] + r["length"]]
            used[doc_id] += 0
            assert zlib.crc32(np.array(part, "<u4").tobytes()) == r["ids_crc32"]
        copies = sum(w == (doc_id, ids) for w in want)
        assert sum(r["length"] for r in own) == copies * len(ids)
    n = sum(len(ids) for _, ids in want)
    return (total - n) / max(1, n)


SPECIAL = st.sampled_from(["<|endoftext|>", "<|endoftext", "|>", " ", "  ", "a", "It's", "\n", "é", "12"])


@settings(max_examples=200, deadline=None)
@given(st.lists(SPECIAL, max_size=12).map("".join))
def test_same_ids_as_library_with_added_tokens(text):
    encoder, library = encoders()
    assert np.frombuffer(encoder.encode(text), "<u4").tolist() == library.encode(text, add_special_tokens=False).ids


@functools.cache
def encoders():
    ranks, specials = packing.byte_level(P.path("byte_bpe_50k.json"))
    return packing.Encoder(ranks, P.PATTERN, specials), Tokenizer.from_file(P.path("byte_bpe_50k.json"))


def test_packing(docs, odd_docs, no_docs):
    assert check_packed(docs) < 0.02
    assert odd_docs.where("text like '%<|endoftext|>%'").count() == 1
    check_packed(odd_docs)
    assert packing.pack(no_docs, P.path("byte_bpe_50k.json"), P.PATTERN).collect() == []


def test_many_equal_lengths(spark):
    frame = spark.createDataFrame([(i, "the " * 1500) for i in range(60)], "doc_id long, text string")
    assert check_packed(frame) < 0.03


@pytest.mark.parametrize("seed", range(6))
def test_plan_places_every_id_once(seed):
    rng = random.Random(seed)
    histogram = {rng.randrange(1, 2048): rng.choice([1, 3, 50, 400]) for _ in range(rng.choice([1, 5, 200]))}
    plan = packing.Plan(histogram)
    where = defaultdict(list)
    for length, n in histogram.items():
        for rank in range(n):
            pieces = plan.place(length, rank)
            assert [p[0] for p in pieces] == [sum(q[1] for q in pieces[:i]) for i in range(len(pieces))] and sum(p[1] for p in pieces) == length
            for _, piece, sequence, offset in pieces:
                where[sequence].append((offset, piece))
    for pieces in where.values():
        at = 0
        for offset, piece in sorted(pieces):
            assert offset == at
            at += piece
        assert at <= 2048


def test_fill_is_best():
    rng = random.Random(3)
    for _ in range(50):
        counts = {rng.randrange(1, 40): rng.randrange(1, 4) for _ in range(5)}
        reach = {0}
        for x, n in counts.items():
            reach = {s + x * k for s in reach for k in range(n + 1)}
        got = packing.fill(counts, 60)
        assert sum(x * n for x, n in got.items()) == max(s for s in reach if s <= 60) and all(n <= counts[x] for x, n in got.items())


def test_crc_joined():
    a, b = b"some bytes", b"and others" * 9
    both = zlib.crc32(a + b)
    assert packing.crc_joined(zlib.crc32(a), zlib.crc32(b), len(b)) == both
    assert packing.crc_joined(zlib.crc32(a), both, len(b)) == zlib.crc32(b)
