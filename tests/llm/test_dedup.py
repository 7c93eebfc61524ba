import random
import re
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from inkfold.llm import dedup
from inkfold.llm.common import sieve, written

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingles(text, n):
    words = WORD.findall(text.translate(LOWER)) if text else []
    k = min(n, len(words))
    return {tuple(words[i : i + k]) for i in range(len(words) - k + 1)} if words else set()


def brute(rows, n):
    """(doc_id, n_shingles, component) of each row, by comparing all pairs that share a shingle."""
    sets = [shingles(t, n) for _, t in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    by = defaultdict(list)
    for i, s in enumerate(sets):
        for x in s:
            by[x].append(i)
    tested = set()
    for own in by.values():
        for a in own:
            for b in own:
                if a < b and (a, b) not in tested:
                    tested.add((a, b))
                    if 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                        x, y = find(a), find(b)
                        root[max(x, y)] = min(x, y)
    groups = defaultdict(list)
    for i in range(len(rows)):
        groups[find(i)].append(rows[i][0])
    least = {r: min((x for x in ids if x is not None), default=None) for r, ids in groups.items()}
    return sorted(((rows[i][0], len(sets[i]), least[find(i)]) for i in range(len(rows))), key=str)


def check(frame, n, **options):
    rows = [(r["doc_id"], r["text"]) for r in frame.select("doc_id", "text").collect()]
    found = dedup.near_duplicates(frame, ngram=n, **options).collect()
    assert sorted(((r["doc_id"], r["n_shingles"], r["component_id"]) for r in found), key=str) == brute(rows, n)
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in found)


def test_against_brute_force(docs):
    check(docs, 4)


def test_odd_rows(odd_docs):
    check(odd_docs, 4)
    check(odd_docs, 5)


def test_empty(no_docs):
    assert dedup.near_duplicates(no_docs, ngram=4).collect() == []
    assert dedup.keep_one(no_docs).collect() == []


def test_tiles_find_links_that_stars_miss(spark):
    """Texts that each differ a little from the next: a chain in shared buckets, in tiles of two."""
    words = [f"w{i}" for i in range(60)]
    rows = [(i, " ".join([*(f"{i}x{j}" if j < 2 * 0 else w for j, w in enumerate(words[i : i + 50]))])) for i in range(10)]
    rows += [(100 + i, " ".join([*words[:30], *(f"v{i}{j}" for j in range(30))])) for i in range(8)]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    check(frame, 4, tile=2)


def test_keep_one(spark, docs):
    kept = dedup.keep_one(docs, ngram=5)
    assert kept.columns == docs.columns
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(i for i, _, c in brute(rows, 5) if i == c)
    twice = spark.createDataFrame([(1, "a b c d e f"), (1, "a b c d e f"), (2, "a b c d e f"), (None, None), (None, None)], "doc_id long, text string")
    assert sorted(map(str, (tuple(r) for r in dedup.keep_one(twice).collect()))) == sorted(map(str, [(1, "a b c d e f"), (None, None), (None, None)]))


def test_minima_do_not_depend_on_batches():
    rng = np.random.default_rng(0)
    sets = [np.unique(rng.integers(0, 2**63, n, dtype=np.uint64)) for n in (1, 5, 7000, 3, 2100)]
    minima = dedup.Minima(6, 4)
    assert all((minima(sets)[:, [i]] == minima([s])).all() for i, s in enumerate(sets))


@pytest.mark.parametrize("edges", [[(1, 2), (2, 3), (3, 4), (7, 8), (9, 7), (4, 5)], [(i, i + 1) for i in range(40)], [(0, i) for i in range(1, 30)]])
def test_star_components(spark, edges):
    found = {r["node"]: r["comp"] for r in dedup.star_components(spark.createDataFrame(edges, "u long, v long")).collect()}
    root = {x: x for e in edges for x in e}
    for _ in edges:
        for a, b in edges:
            root[a] = root[b] = min(root[a], root[b])
    assert {x: found.get(x, x) for x in root} == root


def test_links_that_meet_in_many_buckets(spark):
    """Short texts that differ in their last word only: a similarity of exactly 0.8, many bands in common, several tiles."""
    heads = [" ".join(f"{b}{i}" for i in range(11)) for b in "pqr"]
    rows = [(1000 * h + i, f"{head} last{i}") for h, head in enumerate(heads) for i in range(90)]
    found = dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), ngram=4, tile=16).collect()
    assert sorted((r["doc_id"], r["n_shingles"], r["component_id"]) for r in found) == sorted((d, 9, d // 1000 * 1000) for d, _ in rows)


@pytest.mark.parametrize("bits", [1 << 25, 1 << 8])
def test_sieve(spark, bits):
    """No row whose key is wanted is among the others, however full the bitmap; with bits enough few others pass."""
    rows = spark.range(20_000).withColumn("_p", F.lit("clash")).union(spark.createDataFrame([(None, "null")], "id long, _p string"))
    keys = written(spark.range(0, 20_000, 10).select((F.col("id") - 50).alias("k")).union(spark.createDataFrame([(None,)], "k long")), "test-keys")
    maybe, others = sieve(rows, F.col("id"), keys, bits)
    assert maybe.columns == others.columns == ["id", "_p"]
    maybe, others = {r["id"] for r in maybe.collect()}, {r["id"] for r in others.collect()}
    assert not maybe & others and len(maybe | others) == 20_001
    assert {r["k"] for r in keys.collect()} & others == set() and None in maybe
    assert bits == 1 << 8 or len(maybe) < 5_000
    maybe, others = sieve(rows, F.col("id"), written(keys.where("false"), "no-keys"), bits)
    assert maybe.isEmpty() and others.count() == 20_001


def test_keep_one_with_odd_rows(odd_docs):
    kept = dedup.keep_one(odd_docs, ngram=4)
    assert kept.columns == odd_docs.columns
    rows = [(r["doc_id"], r["text"]) for r in odd_docs.select("doc_id", "text").collect()]
    ids = {i for i, _, c in brute(rows, 4) if i == c}
    assert {r["doc_id"] for r in kept.collect()} == ids


def test_no_partner_is_lost_in_crowded_buckets():
    """Pairs at 0.81 to 0.9 in one tile: each is held in exactly one of the buckets that both are in."""
    rng = np.random.default_rng(4)
    minima, lost, held = dedup.Minima(dedup.BANDS, dedup.ROWS_PER_BAND), 0, 0
    for shared in (179, 190):  # of 200: similarities of 0.81 and 0.905
        for _ in range(125):
            core = rng.integers(0, 2**63, shared, dtype=np.uint64)
            sets = [np.unique(np.concatenate([core, rng.integers(0, 2**63, 200 - shared, dtype=np.uint64)])) for _ in range(10)]
            least = minima(sets)
            sig, keys = (dedup._mix(least) >> np.uint64(56)).astype(np.uint8).T, minima.band_keys(least)
            comp, right = np.arange(10), np.arange(10)
            for i in range(10):
                found = np.concatenate([dedup._partners(sig, keys, comp, i, right, band, dedup._least_matches(sig.shape[1], 80)) for band in range(dedup.BANDS)])
                meet = [j for j in range(10) if j != i and (keys[i] == keys[j]).any()]
                assert sorted(found.tolist()) == meet
                held, lost = held + len(meet), lost + 9 - len(meet)
    assert held > 20_000 and lost <= 5


def test_families_whose_links_lie_in_crowded_buckets(spark):
    """Each text has one partner at 0.86 and hundreds below 0.8 that share its buckets; every pair must come out."""
    rng = random.Random(9)
    rows, wanted = [], {}
    for family in range(4):
        head = [f"f{family}w{i}" for i in range(180)]
        for pair in range(60):
            own = [f"f{family}p{pair}x{i}" for i in range(16)]
            for half in range(2):
                doc = len(rows)
                wanted[doc] = doc - half
                rows.append((doc, " ".join([*head, *own, *(f"d{doc}y{rng.random()}" for _ in range(12))])))
    found = dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), ngram=4, tile=32)
    assert {r["doc_id"]: r["component_id"] for r in found.collect()} == wanted


CLASHES = ["score", "spans", "lang_pred", "node", "rep", "_sieve_p", "_sieve_word", "_sieve_bits", "_group_id", "_group_stay", "_group_worded", "_text", "_found", "with.dot", "salt", "p"]


def test_clashing_columns_come_back_unchanged(spark, docs):
    frame = docs.limit(60).withColumns({c: F.concat(F.lit(f"{c} of "), F.col("doc_id").cast("string")) for c in CLASHES}).withColumn("Score_", F.lit(7.0))
    frame = written(frame.union(frame.where("doc_id < 5")), "clashes")
    kept = dedup.keep_one(frame, ngram=4)
    assert kept.columns == frame.columns
    rows = kept.collect()
    assert rows and all(r[c] == f"{c} of {r['doc_id']}" for r in rows for c in CLASHES)
