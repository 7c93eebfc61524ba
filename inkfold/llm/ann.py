"""Nearest neighbours by largest inner product: a block matrix join.

Queries are dealt into R rows of blocks and candidates into G columns; tile (r, g) meets
each block pair once, so shuffles carry |queries| * G + |candidates| * R vectors, and
both factors follow from the block sizes. In a tile the product of int8 quantised blocks
gives every inner product up to a bound known from the quantisation errors; pairs whose
upper bound reaches the k-th best lower bound survive and are recomputed from the original
vectors in double precision, summed in order. Each tile keeps a query's k best; these
are merged by bounded heaps, over groups of tiles first and over the groups then.
The bounds are strict, so the result is exact. Exactness has its price: with a fixed share of queries the
vectors moved grow with the square of the rows, |queries| / QUERY_BLOCK copies of each candidate, so blocks
should be as large as a task's memory allows.

Defined cases: vectors that are null, empty, zero or hold null or non-finite components
take no part, neither do rows without id. Vectors meet only those of their own dimension.
Ties go to the smaller id; a repeated id is a candidate once for each row; a query's own
id is none of its candidates. Columns other than the two named ones are ignored.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkfold.llm.common import prepare, written

QUERY_BLOCK, CANDIDATE_BLOCK = 4096, 32768
STEP = 1024
#: Products of int8 values, summed over this many dimensions, are exact in float32.
EXACT_DIMS = 1024
FAN_IN = 32


def quantise(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Rows as (int8 values, scale, norm of the quantised row, norm of the error)."""
    scale = np.maximum(np.abs(x).max(axis=1) / 127, 1e-290)
    q = np.rint(x / scale[:, None]).astype(np.int8)
    back = q * scale[:, None]
    return q, scale, np.linalg.norm(back, axis=1), np.linalg.norm(x - back, axis=1)


def product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """a @ b.T of int8 blocks, exact: float32 matrix products are, over few enough dimensions."""
    total = np.zeros((len(a), len(b)))
    for lo in range(0, a.shape[1], EXACT_DIMS):
        total += a[:, lo : lo + EXACT_DIMS].astype(np.float32) @ b[:, lo : lo + EXACT_DIMS].astype(np.float32).T
    return total


def exact(query: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Inner products in double precision, each summed from the first component to the last."""
    out = np.empty(len(rows))
    for lo in range(0, len(rows), 4096):
        out[lo : lo + 4096] = np.cumsum(rows[lo : lo + 4096] * query, axis=1)[:, -1]
    return out


def tile_nearest(qid: np.ndarray, q: np.ndarray, cid: np.ndarray, c: np.ndarray, k: int) -> list[list[tuple[float, int]]]:
    """For each query its k nearest of these candidates, as (-score, id) in order."""
    heaps: list[list[tuple[float, int]]] = [[] for _ in qid]
    iq, sq, nq, eq = quantise(q)
    full = np.linalg.norm(q, axis=1)
    for lo in range(0, len(cid), STEP):
        own, ids = c[lo : lo + STEP], cid[lo : lo + STEP]
        ic, sc, nc, ec = quantise(own)
        near = product(iq, ic) * sq[:, None] * sc[None, :]
        # |x.y - x'.y'| <= |x'||y - y'| + |x - x'||y|, and a little for rounding in these sums.
        size = np.linalg.norm(own, axis=1)
        bound = nq[:, None] * ec[None, :] + eq[:, None] * size[None, :] + 1e-9 * full[:, None] * size[None, :]
        for i in range(len(qid)):
            other = ids != qid[i]
            low = (near[i] - bound[i])[other]
            least = -np.inf
            if len(low) >= k:
                least = np.partition(low, len(low) - k)[len(low) - k]
            if len(heaps[i]) == k:
                least = max(least, -heaps[i][-1][0])
            keep = np.flatnonzero(other & (near[i] + bound[i] >= least))
            if len(keep):
                scores = exact(q[i], own[keep])
                heaps[i] = heapq.nsmallest(k, [*heaps[i], *zip((-scores).tolist(), ids[keep].tolist(), strict=True)])
    return heaps


def _tiles(k: int):
    def run(key, queries: pa.Table, candidates: pa.Table) -> pa.Table:
        out_q, out_g, out_id, out_score = [], [], [], []
        if queries.num_rows and candidates.num_rows:
            dim = key[2].as_py()
            (qid, q), (cid, c) = (
                (t.column(i).to_numpy(), np.asarray(t.column(x).combine_chunks().flatten().to_numpy(zero_copy_only=False), np.float64).reshape(-1, dim))
                for t, i, x in ((queries, "id", "v"), (candidates, "cid", "cv"))
            )
            for q, heap in zip(qid.tolist(), tile_nearest(qid, q, cid, c, k), strict=True):
                out_q.append(q)
                out_g.append(key[1].as_py())
                out_id.append([i for _, i in heap])
                out_score.append([-s for s, _ in heap])
        return pa.table({"query_id": pa.array(out_q, pa.int64()), "g": pa.array(out_g, pa.int32()), "ids": pa.array(out_id, pa.list_(pa.int64())), "scores": pa.array(out_score, pa.list_(pa.float64()))})

    return run


def _merge(k: int):
    """Merges the lists of each (query, group); a task holds k entries for each of its keys."""

    def run(batches):
        heaps: dict[tuple[int, int], list] = {}
        for batch in batches:
            for q, g, ids, scores in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                heaps[q, g] = list(heapq.merge(heaps.get((q, g), []), [(-s, i) for s, i in zip(scores, ids, strict=True)]))[:k]
        keys = list(heaps)
        for lo in range(0, len(keys), 512):
            part = keys[lo : lo + 512]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([q for q, _ in part], pa.int64()), pa.array([g for _, g in part], pa.int32()),
                    pa.array([[i for _, i in heaps[x]] for x in part], pa.list_(pa.int64())), pa.array([[-s for s, _ in heaps[x]] for x in part], pa.list_(pa.float64())),
                ],
                ["query_id", "g", "ids", "scores"],
            )

    return run


def nearest(
    vectors: DataFrame, is_query, *, k: int = 20, id_col: str = "vec_id", vector_col: str = "embedding", query_block: int = QUERY_BLOCK, candidate_block: int = CANDIDATE_BLOCK
) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest of each row for which the column ``is_query`` holds."""
    spark = prepare(vectors.sparkSession)
    v = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("v"), F.coalesce(is_query, F.lit(False)).alias("is_query"))
    fine = F.col("id").isNotNull() & F.col("v").isNotNull() & F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0)
    v = written(v.where(F.coalesce(fine, F.lit(False))).withColumn("dim", F.size("v")), "vectors")
    n, n_queries = v.agg(F.count(F.lit(1)), F.count_if("is_query")).first()
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = max(1, -(-n_queries // query_block))
    # Columns enough for the block size, and for every task if the blocks stay worth their while.
    columns = max(1, -(-n // candidate_block), min(parts, -(-n // STEP)))
    deal = lambda by, n: F.pmod(F.xxhash64("id", F.lit(by)), F.lit(n)).cast("int")
    q = v.where("is_query").select("dim", deal(1, rows).alias("r"), F.explode(F.sequence(F.lit(0), F.lit(columns - 1))).alias("g"), "id", "v")
    c = v.select("dim", F.explode(F.sequence(F.lit(0), F.lit(rows - 1))).alias("r"), deal(2, columns).alias("g"), F.col("id").alias("cid"), F.col("v").alias("cv"))
    schema = "query_id long, g int, ids array<long>, scores array<double>"
    found = q.groupBy("r", "g", "dim").cogroup(c.groupBy("r", "g", "dim")).applyInArrow(_tiles(k), schema)
    while columns > FAN_IN:
        columns = -(-columns // FAN_IN)
        found = found.withColumn("g", (F.col("g") / FAN_IN).cast("int")).repartition(parts, "query_id", "g").mapInArrow(_merge(k), schema)
    found = found.withColumn("g", F.lit(0)).repartition(parts, "query_id").mapInArrow(_merge(k), schema)
    pairs = found.select("query_id", F.posexplode(F.arrays_zip("ids", "scores")).alias("p", "x"))
    return pairs.select("query_id", (F.col("p") + 1).cast("int").alias("rank"), F.col("x.ids").alias("vec_id"), F.col("x.scores").alias("score"))
