"""Exact top-k inner products over an impact-ordered index, score at a time.

A component of 64 dimensions is a posting: its quantised impact is the power of
two below its absolute value.  Postings of one impact form a segment, and a
block of vectors is indexed as its segments in descending impact.  A block of
queries adds segment after segment to the scores.  After each one, the rest of
a vector can change its score by at most the product of the norms of the query
and of the vector's unread postings (Cauchy-Schwarz); a vector whose highest
possible score is under the k-th best sure score is out by proof.  When few are
left, or no segment is, those left are scored exactly on their whole vectors.

Queries go over all vectors in blocks of ``QUERY_BLOCK``; only such a block,
of bounded size, is sent to the tasks.

Cases: rows without id, and vectors that are null or hold null or non-finite
components, take no part; of rows with the same id the smallest vector counts;
shorter vectors are filled up with zeros; ties go to the smaller id; an empty
table gives an empty result; further columns take no part.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cipherlake.plans.scratch import materialize

#: Queries of one pass, and vectors of one indexed block.
QUERY_BLOCK, VECTOR_BLOCK = 8192, 4096
#: Queries scored together; the index stops once at most this share of a block can still be a member.
TOGETHER, FEW = 256, 0.02


def integer_vectors(table: DataFrame, key: str = "vec_id", vector: str = "embedding", scale: int = 64) -> DataFrame:
    """``vec_id, v``: each component as floor(scale * x), for the vectors that take part."""
    usable = table.select(F.col(key).cast("long").alias("vec_id"), F.col(vector).cast("array<double>").alias("x"))
    finite = F.forall("x", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    usable = usable.where(F.col("vec_id").isNotNull() & F.col("x").isNotNull() & F.coalesce(finite, F.lit(False)))
    return usable.groupBy("vec_id").agg(F.min("x").alias("x")).select("vec_id", F.transform("x", lambda x: F.floor(x * scale)).alias("v"))


def dense(column: pa.Array, width: int) -> np.ndarray:
    """A list column as a matrix, rows filled up with zeros."""
    lengths = np.diff(column.offsets.to_numpy())
    values = column.flatten().to_numpy()
    if len(lengths) and (lengths == width).all():
        return values.reshape(-1, width).astype(np.float64)
    out = np.zeros((len(column), width))
    rows = np.repeat(np.arange(len(lengths)), lengths)
    out[rows, np.arange(len(values)) - np.repeat(np.cumsum(lengths) - lengths, lengths)] = values
    return out


class ImpactIndex:
    """The posting segments of a block of integer vectors."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray):
        self.ids, self.vectors = ids, vectors
        impact = np.frexp(np.abs(vectors))[1]
        self.segments, self.rest = [], []
        kind = np.float32 if np.abs(vectors).max(initial=0) < 2**24 else np.float64
        left = vectors.copy()
        for level in sorted({int(x) for x in np.unique(impact)} - {0}, reverse=True):
            segment = np.where(impact == level, vectors, 0)
            left -= segment
            self.segments.append(np.ascontiguousarray(segment.T, kind))
            self.rest.append(np.sqrt((left**2).sum(axis=1)))
        self.largest = float(np.sqrt((vectors**2).sum(axis=1)).max(initial=0))

    def search(self, ids: np.ndarray, queries: np.ndarray, k: int, floor: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query row, vector row, score) of all that may be among a query's best ``k``; ``floor``: the k-th best scores so far."""
        norms = np.sqrt((queries**2).sum(axis=1))
        n = len(self.ids)
        alive = np.ones((len(ids), n), bool)
        # Sums of integer products are exact in single precision up to 2**24 and in double up to 2**53; beyond, rounding widens the bounds.
        most = self.largest * norms.max(initial=0)
        kind = np.float32 if most < 2**24 else np.float64
        scores, mine = np.zeros((len(ids), n), kind), queries.astype(kind)
        for segment, rest in zip(self.segments, self.rest, strict=True):
            scores += mine @ segment.astype(kind, copy=False)
            slack = norms[:, None] * rest[None, :] + 1 + most * 2.0**-40
            sure = floor
            if n > k:
                sure = np.maximum(floor, np.partition(scores - slack, n - k - 1, axis=1)[:, n - k - 1])
            alive = scores + slack >= sure[:, None]
            if alive.mean() <= FEW:
                break
        q, v = np.nonzero(alive)
        other = ids[q] != self.ids[v]
        q, v = q[other], v[other]
        exact = np.empty(len(q), np.int64)
        whole, asked = self.vectors.astype(np.int64), queries.astype(np.int64)
        for a in range(0, len(q), 1 << 16):
            exact[a : a + (1 << 16)] = np.einsum("ij,ij->i", asked[q[a : a + (1 << 16)]], whole[v[a : a + (1 << 16)]])
        return q, v, exact


def best(q: np.ndarray, ids: np.ndarray, scores: np.ndarray, k: int) -> np.ndarray:
    """Rows of each query's ``k`` best, in order of query, score descending, id."""
    order = np.lexsort((ids, -scores, q))
    first = np.searchsorted(q[order], q[order])
    return order[np.arange(len(order)) - first < k]


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 20) -> DataFrame:
    """``query_id, rank, vec_id, score``: of each of ``queries (vec_id, v)`` its ``k`` best among ``vectors (vec_id, v)``."""
    vectors, queries = materialize(vectors), materialize(queries)
    width = max(vectors.agg(F.max(F.size("v"))).first()[0] or 0, 1)
    passes = max(1, -(-queries.count() // QUERY_BLOCK))
    found = None
    for part in range(passes):
        rows = queries.where(F.pmod(F.xxhash64("vec_id"), F.lit(passes)) == part).toArrow().combine_chunks().to_batches()
        sent = vectors.sparkSession.sparkContext.broadcast([(b.column(0).to_numpy(), dense(b.column(1), width)) for b in rows])

        def search(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            asked, mine = (np.concatenate([b[i] for b in sent.value]) for i in (0, 1)) if sent.value else (np.zeros(0, np.int64), np.zeros((0, width)))
            floor = np.full(len(asked), -np.inf)
            q, ids, scores = (np.zeros(0, np.int64) for _ in range(3))
            for batch in batches:
                for a in range(0, batch.num_rows, VECTOR_BLOCK):
                    block = batch.slice(a, VECTOR_BLOCK)
                    index = ImpactIndex(block.column(0).to_numpy(), dense(block.column(1), width))
                    for b in range(0, len(asked), TOGETHER):
                        got = index.search(asked[b : b + TOGETHER], mine[b : b + TOGETHER], k + 1, floor[b : b + TOGETHER])
                        q, ids, scores = np.concatenate([q, got[0] + b]), np.concatenate([ids, index.ids[got[1]]]), np.concatenate([scores, got[2]])
                    kept = best(q, ids, scores, k)
                    q, ids, scores = q[kept], ids[kept], scores[kept]
                    last = np.flatnonzero(np.bincount(q, minlength=len(asked)) == k)
                    if len(last):
                        floor[last] = scores[np.searchsorted(q, last, "right") - 1]
            if len(q):
                yield pa.RecordBatch.from_arrays([pa.array(asked[q]), pa.array(ids), pa.array(scores)], ["query_id", "vec_id", "score"])

        some = vectors.mapInArrow(search, "query_id long, vec_id long, score long")
        if passes > 1:
            some = materialize(some)
        found = some if found is None else found.union(some)
    ranked = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(ranked)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
