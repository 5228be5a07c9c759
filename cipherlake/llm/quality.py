"""Quality classifier: naive Bayes log-count ratios under a linear support vector machine.

A text's features are indicators of hashed n-grams: byte trigrams, words, word
pairs, and the pair of a word with itself.  The log-count ratio of each
feature between the classes is counted over all training rows; the support
vectors are fitted on indicators scaled by it, by dual coordinate descent, on a
sample of at most about ``FIT_ROWS`` training rows.  A logistic curve, fitted
on a part of the sample held back from the descent, turns margins into scores.

Cases: null and empty texts have no feature and get the score of the bias; of
several labels of one document the largest counts; null labels are ignored;
with labels of one class or none every score is the share of label 1 (0.5
without labels); repeated rows get equal results; a null ``doc_id`` isn't held
out; an empty table gives an empty result; further columns take no part.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cipherlake.llm.text import documents_of, mix, ragged, slices, text_bytes, tune, word_hashes, word_spans
from cipherlake.plans.scratch import materialize, small

FEATURES = 1 << 16
#: Training rows that the support vectors are fitted on, about; one in ``CURVE`` of them only fits the logistic curve.
FIT_ROWS, CURVE = 6_000, 4
EPOCHS, COST, SMOOTHING, THRESHOLD = 30, 1.0, 1.0, 0.7


def feature_sets(column: pa.Array) -> Iterator[np.ndarray]:
    """The features of each text, distinct and sorted."""
    data, at = text_bytes(column)
    begins, ends = word_spans(data, at[:-1])
    words, cut = word_hashes(data, begins, ends), np.searchsorted(begins, at)
    wide = data.astype(np.uint32)
    triples = ((wide[:-2] | wide[1:-1] << 8 | wide[2:] << 16) * np.uint32(2654435761) >> np.uint32(16)).astype(np.int64) if len(data) > 2 else np.zeros(0, np.int64)
    single = (words % np.uint64(FEATURES)).astype(np.int64)
    pairs = (mix(words[:-1] * np.uint64(3) + words[1:]) % np.uint64(FEATURES)).astype(np.int64)
    pairs[words[:-1] == words[1:]] = 0
    flags = np.zeros(FEATURES, bool)
    for i in range(len(at) - 1):
        a, b = int(cut[i]), int(cut[i + 1])
        flags[triples[at[i] : max(at[i], at[i + 1] - 2)]] = True
        flags[single[a:b]] = True
        flags[pairs[a : max(a, b - 1)]] = True
        found = np.flatnonzero(flags)
        flags[found] = False
        yield found


def training_rows(docs: DataFrame, labels: DataFrame, usable: Column) -> DataFrame:
    """``y`` and the features of each labelled document that ``usable (doc_id)`` lets through."""
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("y")).where("doc_id is not null and y is not null")
    known = materialize(known.where(usable).groupBy("doc_id").agg(F.max("y").alias("y")))

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            yield pa.RecordBatch.from_arrays([batch.column(2), batch.column(0), ragged(list(feature_sets(batch.column(1))), pa.int32())], ["y", "doc_id", "features"])

    return tune(docs.join(small(known), "doc_id").select("doc_id", "text", "y")).mapInArrow(build, "y int, doc_id long, features array<int>")


def log_ratios(counts: np.ndarray, rows: tuple[int, int]) -> np.ndarray:
    """Log of the smoothed share of a feature in class 1 over that in class 0."""
    return np.log((counts[1] + SMOOTHING) / (rows[1] + 2 * SMOOTHING)) - np.log((counts[0] + SMOOTHING) / (rows[0] + 2 * SMOOTHING))


def descend(rows: list[np.ndarray], y: np.ndarray, ratios: np.ndarray, seed: int = 1) -> np.ndarray:
    """Weights of the scaled indicators and, last, the bias: hinge loss, dual coordinate descent.

    Rows have unit length, so a step's denominator is 1 plus that of the bias.
    Each class has the same total cost.
    """
    weights, random = np.zeros(len(ratios) + 1), np.random.default_rng(seed)
    sign = np.where(y == 1, 1.0, -1.0)
    most = np.where(y == 1, COST * len(y) / 2 / max(1, (y == 1).sum()), COST * len(y) / 2 / max(1, (y != 1).sum()))
    values = [ratios[r] / max(np.sqrt((ratios[r] ** 2).sum()), 1e-9) for r in rows]
    dual = np.zeros(len(y))
    for _ in range(EPOCHS):
        moved = 0.0
        for i in random.permutation(len(y)):
            slope = sign[i] * (weights[rows[i]] @ values[i] + weights[-1]) - 1
            new = min(max(dual[i] - slope / 2, 0.0), most[i])
            if new != dual[i]:
                weights[rows[i]] += (step := (new - dual[i]) * sign[i]) * values[i]
                weights[-1] += step
                moved, dual[i] = max(moved, abs(new - dual[i])), new
        if moved < 1e-3:
            break
    return weights


def curve(margins: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and offset of the logistic curve that fits best, with a small pull towards slope 1."""
    slope, offset = 1.0, 0.0
    goal = np.where(y == 1, ((y == 1).sum() + 1) / ((y == 1).sum() + 2), 1 / ((y != 1).sum() + 2))
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(slope * margins + offset, -30, 30)))
        d, v = p - goal, p * (1 - p) + 1e-6
        gradient = np.array([(d * margins).sum() + 0.1 * (slope - 1), d.sum()])
        hessian = np.array([[(v * margins**2).sum() + 0.1, (v * margins).sum()], [(v * margins).sum(), v.sum()]])
        step = np.linalg.solve(hessian, gradient)
        slope, offset = slope - step[0], offset - step[1]
    return float(slope), float(offset)


def fit(docs: DataFrame, labels: DataFrame, usable: Column) -> tuple[np.ndarray, np.ndarray, float, float] | float:
    """(ratios, weights, slope, offset), or the one score where there is nothing to tell apart."""
    rows = materialize(training_rows(docs, labels, usable))
    of = {r["y"]: r["n"] for r in rows.groupBy("y").agg(F.count("*").alias("n")).collect()}
    total, ones = sum(of.values()), of.get(1, 0)
    if ones in (0, total):
        return ones / total if total else 0.5
    # At most FEATURES rows come to the driver, whatever the number of documents.
    counted = rows.select((F.col("y") == 1).cast("int").alias("c"), F.explode("features").alias("f")).groupBy("f").agg(F.sum("c").alias("one"), F.count("*").alias("n")).toPandas()
    counts = np.zeros((2, FEATURES))
    counts[1, counted["f"]], counts[0, counted["f"]] = counted["one"], counted["n"] - counted["one"]
    ratios = log_ratios(counts, (total - ones, ones))
    share = F.pmod(F.xxhash64("doc_id", F.lit(7)), F.lit(1_000_000)) < int(1_000_000 * min(1.0, FIT_ROWS / total))

    def train(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(list(batches)).sort_by("doc_id")
        y, sets = table.column(0).to_numpy(), table.column(2).combine_chunks()
        rows = np.split(sets.flatten().to_numpy(), sets.offsets.to_numpy()[1:-1])
        back = np.arange(len(y)) % CURVE == 0
        weights = descend([r for r, b in zip(rows, back, strict=True) if not b], y[~back], ratios)
        margins = np.array([margin(r, ratios, weights) for r, b in zip(rows, back, strict=True) if b])
        yield pa.RecordBatch.from_arrays([pa.array([weights.tolist()]), *(pa.array([x]) for x in curve(margins, y[back]))], ["weights", "slope", "offset"])

    got = rows.where(share).coalesce(1).mapInArrow(train, "weights array<double>, slope double, offset double").first()
    return ratios, np.array(got["weights"]), got["slope"], got["offset"]


def margin(row: np.ndarray, ratios: np.ndarray, weights: np.ndarray) -> float:
    scaled = ratios[row]
    return float(weights[row] @ scaled / max(np.sqrt(scaled @ scaled), 1e-9) + weights[-1])


def scores(docs: DataFrame, labels: DataFrame, held_out: Column) -> DataFrame:
    """``doc_id, held_out, score, predicted`` for every row; labels of ``held_out`` documents aren't used."""
    docs = documents_of(docs)
    model = fit(docs, labels, ~F.coalesce(held_out, F.lit(False)))

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            if isinstance(model, float):
                score = np.full(batch.num_rows, model)
            else:
                ratios, weights, slope, offset = model
                margins = np.array([margin(row, ratios, weights) for row in feature_sets(batch.column(1))])
                score = 1 / (1 + np.exp(-np.clip(slope * margins + offset, -30, 30)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(score)], ["doc_id", "score"])

    scored = tune(docs).mapInArrow(apply, "doc_id long, score double")
    return scored.select("doc_id", F.coalesce(held_out, F.lit(False)).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
