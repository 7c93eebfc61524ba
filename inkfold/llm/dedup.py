"""Near-duplicate documents: MinHash with banding, exact confirmation, star components.

Many universal hash minima of a document's word shingles are banded; documents that
agree in a whole band become candidates, signatures and then full shingle sets confirm
them, and alternating large-star and small-star steps label the connected components.

How it stays linear and whole:

* Documents with equal shingle sets form one class before anything is paired, so a group
  of exact copies costs one node however large it is.
* A band bucket first links each member to the bucket's smallest class only. Buckets
  whose members then still lie in different components are searched in full, in square
  tiles of at most ``tile`` + ``tile`` classes, and a tile returns a spanning forest of
  its confirmed links, never all pairs. So no link between candidates is lost and no
  bucket is ever gathered into one task.
* Full sets are built a second time only for classes that share a bucket, and are moved
  only to places where signatures alone leave a link possible. A bitmap of bounded size
  (``common.sieve``) picks the rows that exact joins then move, so neither texts nor bands
  of documents without partners are shuffled.

Defined cases: a null text, or one without words, has an empty set, links with nothing
and forms its own component. Fewer words than ``ngram`` make the whole sequence one
shingle. Rows that repeat an id with the same text are one class and carry the same
result. A null id is never the label of a component that holds another id. Columns
other than the id and the text are ignored, whatever their names.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkfold.llm.common import Bounded, columns, fresh, prepare, sieve, written

ROWS_PER_BAND = 4
BANDS = 24
THRESHOLD_PERCENT = 80
#: Standard deviations below the threshold at which a signature rules a pair out.
SLACK = 6.0
TILE = 256
SALTS = 8
SEED = 0x5EED_0F_1DEA

_U = np.uint64
_M1, _M2 = _U(0xFF51AFD7ED558CCD), _U(0xC4CEB9FE1A85EC53)


def _mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> _U(33))
    x = x * _M1
    x = x ^ (x >> _U(33))
    x = x * _M2
    return x ^ (x >> _U(33))


def _odd(n: int, seed: int) -> np.ndarray:
    return np.random.default_rng(seed).integers(1, 2**63, n, dtype=np.uint64) * _U(2) + _U(1)


class Shingler:
    """Sorted distinct 64-bit shingle hashes of a text."""

    def __init__(self, ngram: int):
        self.ngram = ngram
        self.factors = _odd(ngram, SEED)
        self.word = Bounded(xxhash.xxh3_64_intdigest, 300_000)

    def __call__(self, text: str | None) -> np.ndarray:
        words = text.encode("utf-8", "surrogatepass").lower().split() if text else []
        if not words:
            return np.empty(0, np.uint64)
        hashes = np.fromiter(map(self.word.__getitem__, words), np.uint64, len(words))
        k = min(self.ngram, len(words))
        n = len(words) - k + 1
        total = np.full(n, _U(k if k < self.ngram else 0), np.uint64)
        for i in range(k):
            total += hashes[i : i + n] * self.factors[i]
        return np.unique(_mix(total))


class Minima:
    """Minima of ``bands * rows`` multiply-add hashes modulo 2^64, batched over documents."""

    def __init__(self, bands: int, rows: int):
        self.bands, self.rows = bands, rows
        k = bands * rows
        self.a = _odd(k, SEED + 1)[:, None]
        self.b = _odd(k, SEED + 2)[:, None]
        self.band_factor = _odd(rows, SEED + 3)[None, :, None]

    def __call__(self, sets: list[np.ndarray], chunk: int = 2048) -> np.ndarray:
        """One column of minima for each of the (non-empty) sets."""
        k = self.a.shape[0]
        out = np.full((k, len(sets)), np.iinfo(np.uint64).max, np.uint64)
        flat = np.concatenate(sets)
        ends = np.cumsum([len(s) for s in sets])
        starts = ends - [len(s) for s in sets]
        work = np.empty((k, min(chunk, len(flat))), np.uint64)
        for lo in range(0, len(flat), chunk):
            hi = min(lo + chunk, len(flat))
            first, last = np.searchsorted(ends, lo, "right"), np.searchsorted(starts, hi, "left")
            part = work[:, : hi - lo]
            np.multiply(flat[None, lo:hi], self.a, out=part)
            part += self.b
            at = np.maximum(starts[first:last], lo) - lo
            np.minimum(out[:, first:last], np.minimum.reduceat(part, at, axis=1), out=out[:, first:last])
        return out

    def band_keys(self, minima: np.ndarray) -> np.ndarray:
        """(documents, bands) keys; the lowest byte is the band's number."""
        parts = minima.reshape(self.bands, self.rows, -1) * self.band_factor
        return (_mix(parts.sum(axis=1, dtype=np.uint64)) & ~_U(255) | np.arange(self.bands, dtype=np.uint64)[:, None]).T


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _node(shingles: np.ndarray) -> int:
    return _signed(xxhash.xxh3_64_intdigest(shingles.tobytes(), SEED & 0xFFFF))


def _sign(ngram: int, bands: int, rows: int):
    def run(batches):
        shingle, minima = Shingler(ngram), Minima(bands, rows)
        for batch in batches:
            sets = [shingle(t) for t in batch.column(1).to_pylist()]
            full = [i for i, s in enumerate(sets) if len(s)]
            keys = minima.band_keys(minima([sets[i] for i in full])).astype(np.int64) if full else []
            nodes, band = [None] * len(sets), [None] * len(sets)
            for i, row in zip(full, keys, strict=True):
                nodes[i], band[i] = _node(sets[i]), row
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).cast(pa.int64()), pa.array([len(s) for s in sets], pa.int64()), pa.array(nodes, pa.int64()), pa.array(band, pa.list_(pa.int64()))],
                ["doc_id", "n", "node", "bands"],
            )

    return run


def _full_sets(ngram: int, bands: int, rows: int):
    def run(batches):
        shingle, minima = Shingler(ngram), Minima(bands, rows)
        for batch in batches:
            sets = [s for s in map(shingle, batch.column(0).to_pylist()) if len(s)]
            if sets:
                least = minima(sets)
                # Mixed first: the low bytes of multiply-add hashes aren't independent of each other.
                low, keys = (_mix(least) >> _U(56)).astype(np.uint8).T, minima.band_keys(least)
                held = [pa.array([x.tobytes() for x in rows], pa.binary()) for rows in (low, keys, sets)]
                yield pa.RecordBatch.from_arrays([pa.array([_node(s) for s in sets], pa.int64()), *held], ["node", "sig", "keys", "shingles"])

    return run


def _least_matches(k: int, percent: int) -> int:
    """Signature positions that must agree; a true link falls below with a chance of about 1e-9."""
    p = percent / 100
    return max(0, int(k * p - SLACK * (k * p * (1 - p)) ** 0.5))


def linked(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    """Whether two sorted distinct sets reach the similarity: 100 * both >= percent * either."""
    small, large = (a, b) if len(a) <= len(b) else (b, a)
    if 100 * len(small) < percent * len(large):
        return False
    at = np.searchsorted(large, small)
    both = int((large[np.minimum(at, len(large) - 1)] == small).sum())
    return 100 * both >= percent * (len(a) + len(b) - both)


def _signatures(column) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(len(column), -1)


def _alike(percent: int):
    """Of pairs (u, v, su, sv), those whose signatures leave the similarity possible."""

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                su, sv = _signatures(batch.column(2)), _signatures(batch.column(3))
                keep = (su == sv).sum(axis=1) >= _least_matches(su.shape[1], percent)
                yield batch.select(["u", "v"]).filter(pa.array(keep))

    return run


def _verify(percent: int):
    def run(batches):
        for batch in batches:
            u, v, xu, xv = (batch.column(i).to_pylist() for i in range(4))
            keep = [i for i in range(len(u)) if linked(np.frombuffer(xu[i], np.uint64), np.frombuffer(xv[i], np.uint64), percent)]
            yield pa.RecordBatch.from_arrays([pa.array([u[i] for i in keep], pa.int64()), pa.array([v[i] for i in keep], pa.int64())], ["u", "v"])

    return run


def _partners(sig: np.ndarray, keys: np.ndarray, comp: np.ndarray, i: int, right: np.ndarray, band: int, least: int) -> np.ndarray:
    """Those of ``right`` in other components whose signature comes near, and whose first band key in common with ``i`` is this bucket's.

    So a pair that meets in many buckets is held in one only: the first key that both have is a
    bucket of both, whole keys being compared.
    """
    near = np.flatnonzero(((sig[right] == sig[i]).sum(axis=1) >= least) & (comp[right] != comp[i]))
    common = keys[right[near]] == keys[i]
    return right[near[(common.argmax(axis=1) == band) & common[:, band]]]


def _tile(key, table):
    sides = table.column("side").to_numpy()
    keys = np.frombuffer(b"".join(table.column("keys").to_pylist()), _U).reshape(len(table), -1)
    return np.flatnonzero(sides != 1), np.flatnonzero(sides != 0), key[0].as_py() & 255, table.column("comp").to_numpy(), _signatures(table.column("sig")), keys


def _tile_alike(percent: int):
    def run(key, table):
        """The members of a tile that have a partner there."""
        left, right, band, comp, sig, keys = _tile(key, table)
        least, keep = _least_matches(sig.shape[1], percent), np.zeros(len(comp), bool)
        for i in left:
            near = _partners(sig, keys, comp, i, right, band, least)
            if len(near):
                keep[i] = True
                keep[near] = True
        return table.drop_columns(["sig", "keys"]).filter(pa.array(keep))

    return run


def _tile_links(percent: int):
    def run(key, table):
        """A spanning forest of the confirmed links between components that meet in this tile."""
        left, right, band, comp, sig, keys = _tile(key, table)
        node, sets = table.column("node").to_pylist(), [np.frombuffer(s, np.uint64) for s in table.column("shingles").to_pylist()]
        root: dict[int, int] = {}

        def find(x: int) -> int:
            while root.get(x, x) != x:
                x = root[x]
            return x

        least, out = _least_matches(sig.shape[1], percent), []
        for i in left:
            for j in _partners(sig, keys, comp, i, right, band, least):
                x, y = find(int(comp[i])), find(int(comp[j]))
                if x != y and linked(sets[i], sets[j], percent):
                    root[max(x, y)] = min(x, y)
                    out.append((node[i], node[j]))
        return pa.table({"u": pa.array([x for x, _ in out], pa.int64()), "v": pa.array([y for _, y in out], pa.int64())})

    return run


def star_components(edges: DataFrame, name: str = "stars") -> DataFrame:
    """Connected components of ``edges`` (u, v): returns (node, comp), comp the smallest node.

    Alternating large-star and small-star; each round is written to the shared folder, and
    the rounds end when the edge table no longer changes. Nodes without edges don't appear.
    """

    def state(e: DataFrame) -> tuple:
        return tuple(e.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v"))).first())

    e = written(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), name)
    before = state(e)
    while before[0]:
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        met = large.join(least, "u")
        small = met.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v")))
        e = written(small.distinct(), name)
        after = state(e)
        if after == before:
            break
        before = after
    return e.select(F.col("u").alias("node"), F.col("v").alias("comp"))


def _tiles(members: DataFrame, comps: DataFrame, sets: DataFrame, tile: int, percent: int) -> DataFrame:
    """Links between components that share a bucket, by tiles.

    In each bucket the classes of its smallest component stand on one side, all others
    ("strays") on both: strays meet each other and the first component, chunk by chunk.
    Tiles are first held with signatures alone, which leaves few members; then with sets.
    A bucket's counts meet its members by key and salt, so that a large bucket is laid out by many tasks.
    """
    m = members.join(comps, "node", "left").select("band_key", "node", F.coalesce("comp", "node").alias("comp"))
    split = m.groupBy("band_key").agg(F.min("comp").alias("first"), F.max("comp").alias("last")).where("first <> last")
    m = written(m.join(split.select("band_key", "first"), "band_key").withColumn("stray", F.col("comp") != F.col("first")), "residual")
    counts = m.groupBy("band_key").agg(
        F.ceil(F.count_if("stray") / tile).cast("int").alias("ns"), F.ceil(F.count_if(~F.col("stray")) / tile).cast("int").alias("nm")
    )
    counts = counts.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    m = m.withColumn("salt", F.pmod(F.xxhash64("node", F.lit(11)), F.lit(SALTS)).cast("int")).join(counts, ["band_key", "salt"])
    chunk = F.pmod(F.xxhash64("node", F.lit(7)), F.when(F.col("stray"), F.col("ns")).otherwise(F.col("nm"))).cast("int")
    pair = lambda kind, i, j, side: F.struct(F.lit(kind).alias("kind"), i.cast("int").alias("i"), j.cast("int").alias("j"), side.cast("int").alias("side"))
    c = F.col("chunk")
    with_first = F.transform(F.sequence(F.lit(0), F.col("nm") - 1), lambda j: pair(0, c, j, F.lit(0)))
    with_stray = F.transform(
        F.sequence(F.lit(0), F.col("ns") - 1),
        lambda j: pair(1, F.least(c, j), F.greatest(c, j), F.when(c == j, 2).when(c < j, 0).otherwise(1)),
    )
    as_first = F.transform(F.sequence(F.lit(0), F.col("ns") - 1), lambda i: pair(0, i, c, F.lit(1)))
    tiles = (
        m.withColumn("chunk", chunk)
        .select("band_key", "node", "comp", F.explode(F.when(F.col("stray"), F.concat(with_first, with_stray)).otherwise(as_first)).alias("t"))
        .select("band_key", "t.kind", "t.i", "t.j", "t.side", "node", "comp")
    )
    place = ["band_key", "kind", "i", "j"]
    near = tiles.join(sets.select("node", "sig", "keys"), "node").select(*place, "side", "node", "comp", "sig", "keys").groupBy(*place)
    near = written(near.applyInArrow(_tile_alike(percent), "band_key long, kind int, i int, j int, side int, node long, comp long"), "tile-members")
    used = written(near.select("node").distinct(), "used")
    return near.join(sieve(sets, F.col("node"), used)[0], "node").groupBy(*place).applyInArrow(_tile_links(percent), "u long, v long")


def near_duplicates(
    docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", ngram: int = 5, percent: int = THRESHOLD_PERCENT, bands: int = BANDS, rows: int = ROWS_PER_BAND, tile: int = TILE
) -> DataFrame:
    """Returns (doc_id, n_shingles, component_id, kept), one row per row of ``docs``.

    Two classes are linked if their sets' similarity reaches ``percent``; a true link is
    missed only if no band agrees, at most (1 - s^rows)^bands: 3e-6 at s = 0.8 by default.
    Classes are keyed by a 64-bit hash of the sorted set.
    """
    prepare(docs.sparkSession)
    if bands > 256:
        raise ValueError("a bucket's key has one byte for its band")
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    signed = written(docs.mapInArrow(_sign(ngram, bands, rows), "doc_id long, n long, node long, bands array<long>"), "signatures")
    classes = written(signed.where("node is not null").groupBy("node").agg(F.min("doc_id").alias("rep")), "classes")

    exploded = signed.where("node is not null").select("node", F.explode("bands").alias("band_key"))
    # Most keys stand alone: they are counted first, so that only the keys of others move with their nodes.
    shared = written(exploded.groupBy("band_key").agg(F.count(F.lit(1)).alias("rows")).where("rows > 1").select("band_key"), "shared")
    met = written(sieve(exploded, F.col("band_key"), shared)[0].distinct(), "met")
    buckets = written(met.groupBy("band_key").agg(F.min("node").alias("hub"), F.max("node").alias("top")).where("hub <> top").select("band_key", "hub"), "buckets")
    members = written(met.join(buckets, "band_key").select("band_key", "node", "hub"), "members")

    # Written, so that the planner knows its size before it decides whether texts must be moved.
    wanted = written(members.select("node").distinct().join(classes, "node").select("rep").distinct(), "wanted")
    full = sieve(docs, F.col("doc_id"), wanted)[0].join(wanted, F.col("doc_id").eqNullSafe(F.col("rep")), "left_semi").select("text")
    sets = written(full.mapInArrow(_full_sets(ngram, bands, rows), "node long, sig binary, keys binary, shingles binary"), "sets")
    if sets.count() > wanted.count():  # rows that repeat an id
        sets = written(sets.dropDuplicates(["node"]), "sets")

    def of_both(pairs: DataFrame, column: str) -> DataFrame:
        used = written(pairs.select(F.explode(F.array("u", "v")).alias("node")).distinct(), "used")
        some = sieve(sets, F.col("node"), used)[0]
        u, v = (some.select(F.col("node").alias(x), F.col(column).alias(f"of_{x}")) for x in "uv")
        return pairs.join(u, "u").join(v, "v").select("u", "v", "of_u", "of_v")

    stars = members.where("node <> hub").select(F.col("node").alias("u"), F.col("hub").alias("v")).distinct()
    alike = written(of_both(stars, "sig").mapInArrow(_alike(percent), "u long, v long"), "alike")
    links = written(of_both(alike, "shingles").mapInArrow(_verify(percent), "u long, v long"), "links")
    comps = star_components(links)
    more = written(_tiles(members, comps, sets, tile, percent).distinct(), "tile-links")
    if not more.isEmpty():
        comps = star_components(comps.select(F.col("node").alias("u"), F.col("comp").alias("v")).union(more))

    labelled = classes.join(comps, "node", "left").select("node", "rep", F.coalesce("comp", "node").alias("comp"))
    least = labelled.groupBy("comp").agg(F.min("rep").alias("component_id"))
    label = written(labelled.join(least, "comp").select("node", "component_id"), "labels")
    done = signed.select("doc_id", "n", "node").join(label, "node", "left")
    component = F.when(F.col("node").isNull(), F.col("doc_id")).otherwise(F.col("component_id"))
    return done.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"), component.eqNullSafe(F.col("doc_id")).alias("kept"))


def keep_one(docs: DataFrame, **options) -> DataFrame:
    """The documents that stay: one of each group, all columns unchanged.

    A row that repeats another's id and text goes too; documents without words all stay.
    """
    found = near_duplicates(docs, **options)
    id_col, text_col = options.get("id_col", "doc_id"), options.get("text_col", "text")
    of, stay, worded = fresh(docs, "_group_id", "_group_stay", "_group_worded")
    own, stays = columns(docs.columns), F.col("kept")
    by_id = found.groupBy(F.col("doc_id").alias(of)).agg(F.count_if(stays).alias(stay), F.coalesce(F.max(F.when(stays, F.col("n_shingles"))) > 0, F.lit(False)).alias(worded))
    # Most documents are alone or the first of their group; only the ids of others are compared, and only what may be theirs moves.
    other = written(by_id.where(F.col(stay) != 1), "other")
    maybe, once = sieve(docs, F.col(id_col).cast("long"), other.select(of))
    joined = maybe.join(other, F.col(id_col).cast("long").eqNullSafe(F.col(of)), "left")
    once = once.union(joined.where(F.col(stay).isNull()).select(*own))
    if other.where(F.col(stay) > 1).isEmpty():
        return once
    again = joined.where(F.col(stay) > 1)
    return once.union(again.where(F.col(worded)).select(*own).dropDuplicates([id_col, text_col])).union(again.where(~F.col(worded)).select(*own))
