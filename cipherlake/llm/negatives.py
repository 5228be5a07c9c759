"""Hard negatives of each anchor and positive, by segment summaries of the vectors.

A vector is cut into segments of neighbouring components, and of each its mean
and its deviation (the norm of what the mean leaves) are stored.  The inner
product of two segments of ``m`` components is ``m`` times the product of their
means, plus or minus at most the product of their deviations.  Summed over the
segments this bounds a score from both sides.  Blocks of vectors are held
against blocks of anchors with wide segments first; where many pairs can still
matter, all segments are halved, and what is left in the end is scored exactly.

Two passes over the vectors: the first finds each anchor's positives, the second
the negatives in the window under each positive's score.  Anchors go over all
vectors in blocks of ``ANCHOR_BLOCK``; only such a block, of bounded size, is sent
to the tasks.

Cases: rows without id or label, and vectors that are null or hold null or
non-finite components, take no part; of rows with the same id the one with the
smallest label and vector counts; shorter vectors are filled up with zeros; ties
go to the smaller id; an anchor without positives, and a positive without
negatives in its window, give no row; a positive score under zero has an empty
window; an empty table gives an empty result; further columns take no part.
Scores are exact while vectors' norms multiply to less than 2**53.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cipherlake.llm.topk import best, dense
from cipherlake.plans.scratch import drop_table, materialize

#: Anchors of one pass, vectors of one block, anchors held against it at once.
ANCHOR_BLOCK, VECTOR_BLOCK, TOGETHER = 8192, 4096, 256
#: Components of the segments, from the widest; refining stops once at most ``FEW`` of the pairs can still matter.
WIDTHS, FEW = (16, 8, 4, 2), 0.02


def labelled_vectors(table: DataFrame, label: Column, key: str = "vec_id", vector: str = "embedding", scale: int = 256) -> DataFrame:
    """``vec_id, label, v``: each component as floor(scale * x), for the rows that take part."""
    rows = table.select(F.col(key).cast("long").alias("vec_id"), label.cast("long").alias("label"), F.col(vector).cast("array<double>").alias("x"))
    finite = F.forall("x", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = rows.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.coalesce(finite, F.lit(False)))
    one = rows.groupBy("vec_id").agg(F.min(F.struct("label", "x")).alias("r"))
    return one.select("vec_id", "r.label", F.transform("r.x", lambda x: F.floor(x * scale)).alias("v"))


class Summaries:
    """Segment means and deviations of integer vectors, level by level."""

    def __init__(self, vectors: np.ndarray):
        n, width = vectors.shape
        self.vectors = vectors
        self.norms = np.sqrt((vectors**2).sum(axis=1))
        self.levels = []
        for size in WIDTHS:
            filled = np.zeros((n, -(-width // size), size))
            filled.reshape(n, -1)[:, :width] = vectors
            mean = filled.mean(axis=2)
            deviation = np.sqrt(((filled - mean[:, :, None]) ** 2).sum(axis=2))
            # The mean is stored times the root of the size, so that a product of two holds the size.
            self.levels.append((mean * np.sqrt(size), deviation))

    def some(self, rows: slice) -> Summaries:
        part = object.__new__(Summaries)
        part.vectors, part.norms = self.vectors[rows], self.norms[rows]
        part.levels = [(m[rows], d[rows]) for m, d in self.levels]
        return part


def bounds(a: Summaries, b: Summaries) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Lowest and highest possible scores of all pairs, closer at each level."""
    slack = np.outer(a.norms, b.norms) * 2.0**-40 + 2.0**-20
    for (mean, deviation), (other, spread) in zip(a.levels, b.levels, strict=True):
        middle, apart = mean @ other.T, deviation @ spread.T + slack
        yield middle - apart, middle + apart


def exact(a: Summaries, b: Summaries, alive: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, column and score of the pairs that are alive."""
    i, j = np.nonzero(alive)
    if len(i) > 0.1 * alive.size:
        # Products of integers, exact in double precision.
        return i, j, np.rint((a.vectors @ b.vectors.T)[i, j]).astype(np.int64)
    score = np.empty(len(i), np.int64)
    for k in range(0, len(i), 1 << 16):
        some = slice(k, k + (1 << 16))
        score[some] = np.rint(np.einsum("ij,ij->i", a.vectors[i[some]], b.vectors[j[some]])).astype(np.int64)
    return i, j, score


def positives_in(anchors: Summaries, ids: np.ndarray, labels: np.ndarray, floor: np.ndarray, block: Summaries, theirs: np.ndarray, kinds: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pairs of one label that may be among an anchor's first ``k``; ``floor``: its k-th best score so far."""
    alive = (labels[:, None] == kinds[None, :]) & (ids[:, None] != theirs[None, :])
    allowed = alive
    for low, high in bounds(anchors, block):
        sure = floor
        if low.shape[1] > k:
            low = np.where(allowed, low, -np.inf)
            sure = np.maximum(floor, np.partition(low, low.shape[1] - k, axis=1)[:, low.shape[1] - k])
        alive = alive & (high >= sure[:, None])
        if alive.mean() <= FEW:
            break
    return exact(anchors, block, alive)


def negatives_in(anchors: Summaries, labels: np.ndarray, windows: tuple[np.ndarray, np.ndarray], floor: np.ndarray, block: Summaries, kinds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pairs of different labels that may be in one of the anchor's windows, above its k-th best score there."""
    least, most = np.maximum(windows[0], floor), windows[1]
    alive = labels[:, None] != kinds[None, :]
    for low, high in bounds(anchors, block):
        meets = np.zeros(alive.shape, bool)
        for slot in range(least.shape[1]):
            meets |= (high >= least[:, slot, None]) & (low <= most[:, slot, None])
        alive = alive & meets
        if alive.mean() <= FEW:
            break
    return exact(anchors, block, alive)


def searched(vectors: DataFrame, anchors: DataFrame, width: int, k: int, per_window: int | None, share: int) -> DataFrame:
    """``anchor_id, slot, vec_id, score``: the best candidates of each block of vectors; positives if ``per_window`` is None."""
    rows = anchors.toArrow().combine_chunks().to_batches()
    columns = [(b.column(0).to_numpy(), b.column(1).to_numpy(), dense(b.column(2), width), *((dense(b.column(3), k),) if per_window else ())) for b in rows if b.num_rows]
    sent = vectors.sparkSession.sparkContext.broadcast(columns)

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if not sent.value:
            return
        ids, labels, mine, *scores = (np.concatenate(c) for c in zip(*sent.value, strict=True))
        asked = Summaries(mine)
        slots = k if per_window else 1
        keep = per_window or k
        if per_window:
            # Where an anchor has fewer positives, the window is empty.
            missing = np.isnan(scores[0])
            least = -((-share * np.where(missing, 0, scores[0]).astype(np.int64)) // 100)
            window = (np.where(missing, np.inf, least), np.where(missing, -np.inf, scores[0]))
        floor = np.full((len(ids), slots), -np.inf)
        held = [np.zeros(0, np.int64) for _ in range(3)]
        for batch in batches:
            for a in range(0, batch.num_rows, VECTOR_BLOCK):
                part = batch.slice(a, VECTOR_BLOCK)
                theirs, kinds, block = part.column(0).to_numpy(), part.column(1).to_numpy(), Summaries(dense(part.column(2), width))
                for b in range(0, len(ids), TOGETHER):
                    own = slice(b, b + TOGETHER)
                    some = asked.some(own)
                    if per_window is None:
                        i, j, score = positives_in(some, ids[own], labels[own], floor[own, 0], block, theirs, kinds, k)
                        q = i + b
                    else:
                        i, j, score = negatives_in(some, labels[own], (window[0][own], window[1][own]), floor[own], block, kinds)
                        inside = (score[:, None] >= np.maximum(window[0][own][i], floor[own][i])) & (score[:, None] <= window[1][own][i])
                        at, slot = np.nonzero(inside)
                        j, score, q = j[at], score[at], (i[at] + b) * slots + slot
                    held = [np.concatenate(x) for x in zip(held, (q, theirs[j], score), strict=True)]
                kept = best(held[0], held[1], held[2], keep)
                held = [x[kept] for x in held]
                full = np.flatnonzero(np.bincount(held[0], minlength=len(ids) * slots) == keep)
                if len(full):
                    floor.ravel()[full] = held[2][np.searchsorted(held[0], full, "right") - 1]
        if len(held[0]):
            yield pa.RecordBatch.from_arrays([pa.array(ids[held[0] // slots]), pa.array(held[0] % slots), pa.array(held[1]), pa.array(held[2])], ["anchor_id", "slot", "vec_id", "score"])

    return vectors.mapInArrow(search, "anchor_id long, slot long, vec_id long, score long")


def hard_negatives(vectors: DataFrame, anchors: DataFrame, positives: int = 5, negatives: int = 5, share: int = 80) -> DataFrame:
    """``anchor_id, positive_id, rank, negative_id, positive_score, negative_score`` among ``vectors (vec_id, label, v)``.

    ``anchors`` are some of the vectors.  A positive is one of an anchor's first
    ``positives`` other vectors of its label.  Its negatives are the first
    ``negatives`` vectors of other labels whose score is at most the positive's
    and at least ``share`` percent of it.
    """
    vectors, anchors = materialize(vectors), materialize(anchors)
    width = max(vectors.agg(F.max(F.size("v"))).first()[0] or 0, 1)
    passes = max(1, -(-anchors.count() // ANCHOR_BLOCK))
    out = None
    for part in range(passes):
        some = anchors.where(F.pmod(F.xxhash64("vec_id"), F.lit(passes)) == part)
        place = Window.partitionBy("anchor_id").orderBy(F.desc("score"), "vec_id")
        first = searched(vectors, some, width, positives, None, share).withColumn("place", F.row_number().over(place)).where(F.col("place") <= positives)
        first = materialize(first.select("anchor_id", (F.col("place") - 1).cast("long").alias("slot"), F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score")))
        # The scores in order of their places; places that a shorter list leaves open become NaN.
        scores = first.groupBy(F.col("anchor_id").alias("vec_id")).agg(F.array_sort(F.collect_list(F.struct("slot", "positive_score"))).alias("s"))
        filled = F.transform(F.sequence(F.lit(0), F.lit(positives - 1)), lambda i: F.coalesce(F.get("s.positive_score", i).cast("double"), F.lit(float("nan"))))
        asked = some.join(scores, "vec_id").select("vec_id", "label", "v", filled.alias("scores"))
        ranked = Window.partitionBy("anchor_id", "slot").orderBy(F.desc("score"), "vec_id")
        found = searched(vectors, asked, width, positives, negatives, share).withColumn("rank", F.row_number().over(ranked)).where(F.col("rank") <= negatives)
        found = found.join(first, ["anchor_id", "slot"]).select("anchor_id", "positive_id", "rank", F.col("vec_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))
        if passes > 1:
            found = materialize(found)
            drop_table(first)
        out = found if out is None else out.union(found)
    return out
