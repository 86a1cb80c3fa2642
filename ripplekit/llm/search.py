"""Exact top-k inner products by columnar branch and bound.

Vectors are laid out by component (vertical layout). For a query, inner products accumulate over
blocks of components; after each block a candidate is dropped if its sum so far plus the most that
the remaining components can add (the product of the remaining norms) stays below the k-th best
lower bound, and the survivors are compacted. Components are floor(256 * x) as whole numbers.

Queries go to all tasks in batches of bounded bytes; each batch is one pass over the vectors, and a
pass keeps k rows of a query in each task. Vectors that are null or hold a null or non-finite
component take no part. Shorter vectors count as filled up with zeros. Rows that repeat a query's
vec_id are its own and no candidates; a repeated query is answered once (its least vector). Other
repeated rows are candidates each. Ties go to the smaller vec_id. Null ids take no part.
Sums are exact while the product of two norms is below 2**53.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Bytes of a batch of queries, and candidates that a task handles at a time.
QUERY_BYTES, BLOCK, DIM_BLOCK = 64 << 20, 16_384, 16
SCALE = 256


def _integers(ids: pa.Array, vectors: pa.ListArray, dims: int) -> tuple[np.ndarray, np.ndarray]:
    """Ids and rows of whole numbers of the vectors that take part."""
    flat = vectors.flatten().cast(pa.float64())
    rows = np.asarray(vectors.is_valid()) & np.asarray(ids.is_valid())
    size = np.where(np.asarray(vectors.is_valid()), np.asarray(vectors.value_lengths().fill_null(0)), 0)
    bad = ~np.isfinite(flat.to_numpy(zero_copy_only=False).astype(float)) | np.asarray(flat.is_null())
    owner = np.repeat(np.arange(len(size)), size)
    rows[owner[bad]] = False
    out = np.zeros((len(size), dims))
    place = np.arange(len(owner)) - np.repeat(np.cumsum(size) - size, size)
    keep = rows[owner]
    out[owner[keep], place[keep]] = np.floor(SCALE * flat.to_numpy(zero_copy_only=False)[keep])
    return ids.fill_null(0).to_numpy(zero_copy_only=False)[rows], out[rows]


def top_k(queries: np.ndarray, query_ids: np.ndarray, ids: np.ndarray, vectors: np.ndarray, k: int, floor: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query row, vec_id, score) of the k best of ``vectors`` for every query, exact.

    floor: scores that a query has k of already; candidates below it are dropped at once.
    """
    dims = vectors.shape[1]
    columns = np.ascontiguousarray(vectors.T)
    cuts = list(range(0, dims, DIM_BLOCK)) + [dims] if dims else [0]
    mass = lambda x: np.sqrt(np.stack([(x[:, c:] ** 2).sum(1) for c in cuts], axis=1))
    left_v, left_q = mass(vectors), mass(queries)
    out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    for q in range(len(queries)):
        alive = np.flatnonzero(ids != query_ids[q])
        sums = np.zeros(len(alive))
        least = -np.inf if floor is None else floor[q]
        for b in range(len(cuts) - 1):
            lo, hi = cuts[b], cuts[b + 1]
            part = columns[lo:hi] if len(alive) == len(ids) else columns[lo:hi, alive]
            sums = sums + queries[q, lo:hi] @ part
            slack = left_q[q, b + 1] * left_v[alive, b + 1] * (1 + 1e-9) + 1e-6
            if len(alive) > k:
                lower = np.partition(sums - slack, len(alive) - k)[len(alive) - k]
                least = max(least, lower)
            keep = sums + slack >= least
            if not keep.all():
                alive, sums = alive[keep], sums[keep]
        order = np.lexsort((ids[alive], -sums))[:k]
        out.append((np.full(len(order), q), ids[alive[order]], sums[order].astype(np.int64)))
    return tuple(np.concatenate(x) if out else np.zeros(0, np.int64) for x in zip(*out)) if out else (np.zeros(0, np.int64),) * 3


def nearest(vectors: DataFrame, is_query, k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding", query_bytes: int = QUERY_BYTES) -> DataFrame:
    """(query_id, rank, vec_id, score): the k candidates of highest score for every query row."""
    spark = vectors.sparkSession
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("v"))
    dims, n = vectors.select(F.max(F.size(vector_col)), F.sum(F.when(is_query, 1))).head()
    dims, n = max(dims or 0, 0), n or 0
    batches = max(1, -(-n * (dims + 1) * 8 // query_bytes))
    done: DataFrame | None = None
    for i in range(batches):
        some = vectors.where(is_query).select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("v"))
        some = some.where(F.col("id").isNotNull() & F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))))
        some = some.where(F.pmod(F.xxhash64("id"), F.lit(batches)) == i) if batches > 1 else some
        found = some.groupBy("id").agg(F.min("v").alias("v")).toArrow().combine_chunks()  # bounded by query_bytes
        qid, q = _integers(*(found.column(c).combine_chunks() if found.num_rows else pa.array([], t) for c, t in (("id", pa.int64()), ("v", pa.list_(pa.float64())))), dims)
        shared = spark.sparkContext.broadcast((qid, q))

        def run(batches_: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            qid, q = shared.value
            best: tuple[np.ndarray, np.ndarray, np.ndarray] = (np.zeros(0, np.int64),) * 3
            held: list[tuple[np.ndarray, np.ndarray]] = []

            def search() -> None:
                nonlocal best
                ids, vecs = (np.concatenate(x) for x in zip(*held))
                held.clear()
                floor = np.full(len(qid), -np.inf)
                if len(best[0]):
                    first = np.searchsorted(best[0], np.arange(len(qid) + 1))
                    full = np.diff(first) == k
                    floor[full] = best[2][first[1:][full] - 1]
                found = top_k(q, qid, ids, vecs, k, floor)
                a, b, c = (np.concatenate(x) for x in zip(best, found))
                order = np.lexsort((b, -c, a))
                a, b, c = a[order], b[order], c[order]
                place = np.arange(len(a)) - np.searchsorted(a, a)
                best = a[place < k], b[place < k], c[place < k]

            for batch in batches_:
                if len(qid) == 0:
                    continue
                held.append(_integers(batch.column(0), batch.column(1), q.shape[1]))
                if sum(len(h[0]) for h in held) >= BLOCK:
                    search()
            if held:
                search()
            yield pa.RecordBatch.from_arrays([pa.array(qid[best[0]] if len(best[0]) else np.zeros(0, np.int64)), pa.array(best[1]), pa.array(best[2])], ["query_id", "vec_id", "score"])

        part = rows.mapInArrow(run, "query_id long, vec_id long, score long")
        done = part if done is None else done.union(part)
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = done.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")
