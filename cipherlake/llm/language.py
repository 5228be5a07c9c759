"""Language identification by a bidirectional gated recurrent network over bytes.

The network reads a text in stretches of ``STRETCH`` bytes, from both ends of
each, and gives every byte position a probability of each language; a text's
probabilities are the means over all its positions.  It is trained in numpy by
backpropagation through time on stretches of at most about ``DOCUMENTS`` texts
of each language, within one task of bounded size.

Cases: a null text, and one without a letter, is ``und`` with score 0; a null
or empty language is no training row; without training rows every text is
``und``; repeated rows get equal results; a null ``doc_id`` isn't held out; an
empty table gives an empty result; further columns take no part.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cipherlake.llm.text import fresh, slices, text_bytes, tune
from cipherlake.plans.scratch import materialize

#: Bytes of a stretch, hidden units of each direction.
STRETCH, HIDDEN = 128, 8
#: Training texts of a language, stretches of one text, stretches of a step, steps.
DOCUMENTS, EACH, BATCH, STEPS, RATE = 400, 8, 256, 300, 0.02
#: What makes a letter, for training and prediction alike: Unicode category L.
LETTER = r"\p{L}"


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * np.tanh(0.5 * x) + 0.5


def start(classes: int, seed: int = 3) -> dict[str, np.ndarray]:
    """Parameters: of each direction the input's, the state's and the candidate's; then the output layer."""
    random, h = np.random.default_rng(seed), HIDDEN
    out = {"o": random.normal(0, 0.3, (2 * h, classes)), "c": np.zeros(classes)}
    for way in "fb":
        out |= {f"{way}x": random.normal(0, 0.3, (256, 3 * h)), f"{way}g": random.normal(0, 0.3, (h, 2 * h)), f"{way}n": random.normal(0, 0.3, (h, h))}
    return {k: v.astype(np.float32) for k, v in out.items()}


def run(x: np.ndarray, p: dict[str, np.ndarray], way: str, keep: list | None = None) -> np.ndarray:
    """States of one direction at each step of ``x (steps, stretches)``; ``keep`` gets what the way back needs."""
    h = HIDDEN
    states = np.empty((*x.shape, h), np.float32)
    state = np.zeros((x.shape[1], h), np.float32)
    inputs, gates, new = p[f"{way}x"], p[f"{way}g"], p[f"{way}n"]
    for t in range(len(x)) if way == "f" else range(len(x) - 1, -1, -1):
        a = inputs[x[t]]
        g = sigmoid(a[:, : 2 * h] + state @ gates)
        z, r = g[:, :h], g[:, h:]
        rs = r * state
        n = np.tanh(a[:, 2 * h :] + rs @ new)
        if keep is not None:
            keep.append((t, state, z, r, rs, n))
        state = n + z * (state - n)
        states[t] = state
    return states


def back(x: np.ndarray, slope: np.ndarray, keep: list, p: dict[str, np.ndarray], way: str) -> dict[str, np.ndarray]:
    """Gradients of one direction's parameters from those of its states."""
    h = HIDDEN
    out = {k: np.zeros_like(p[k]) for k in (f"{way}x", f"{way}g", f"{way}n")}
    carried = np.zeros(slope.shape[1:], np.float32)
    for t, state, z, r, rs, n in reversed(keep):
        d = slope[t] + carried
        dn = d * (1 - z) * (1 - n * n)
        drs = dn @ p[f"{way}n"].T
        dg = np.concatenate([d * (state - n) * z * (1 - z), drs * state * r * (1 - r)], axis=1)
        out[f"{way}n"] += rs.T @ dn
        out[f"{way}g"] += state.T @ dg
        np.add.at(out[f"{way}x"], x[t], np.concatenate([dg, dn], axis=1))
        carried = d * z + drs * r + dg @ p[f"{way}g"].T
    return out


def probabilities(x: np.ndarray, p: dict[str, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    states = np.concatenate([run(x, p, "f"), run(x, p, "b")], axis=2)
    logits = states @ p["o"] + p["c"]
    logits -= logits.max(axis=2, keepdims=True)
    np.exp(logits, out=logits)
    return states, logits / logits.sum(axis=2, keepdims=True)


def train(stretches: np.ndarray, lengths: np.ndarray, y: np.ndarray, classes: int) -> dict[str, np.ndarray]:
    """Parameters after ``STEPS`` steps of Adam on the cross entropy of every position; each language weighs the same."""
    random, p = np.random.default_rng(5), start(classes)
    first, second = ({k: np.zeros_like(v) for k, v in p.items()} for _ in range(2))
    share = 1 / np.bincount(y, minlength=classes)[y]
    share /= share.sum()
    for step in range(1, STEPS + 1):
        pick = random.choice(len(y), min(BATCH, len(y)), p=share)
        x = stretches[pick].T.astype(np.int64)
        keeps: dict[str, list] = {"f": [], "b": []}
        states = np.concatenate([run(x, p, w, keeps[w]) for w in "fb"], axis=2)
        logits = states @ p["o"] + p["c"]
        logits -= logits.max(axis=2, keepdims=True)
        slope = np.exp(logits)
        slope /= slope.sum(axis=2, keepdims=True)
        slope[:, np.arange(len(pick)), y[pick]] -= 1
        slope *= (np.arange(len(x))[:, None] < lengths[pick])[:, :, None] / np.float32(lengths[pick].sum())
        grads = {"o": np.tensordot(states, slope, ([0, 1], [0, 1])), "c": slope.sum(axis=(0, 1))}
        down = slope @ p["o"].T
        grads |= back(x, down[:, :, :HIDDEN], keeps["f"], p, "f") | back(x, down[:, :, HIDDEN:], keeps["b"], p, "b")
        rate = RATE * min(1.0, 2 * (1 - step / (STEPS + 1)))
        for k, g in grads.items():
            first[k] = 0.9 * first[k] + 0.1 * g
            second[k] = 0.999 * second[k] + 0.001 * g * g
            p[k] = (p[k] - rate * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-8)).astype(np.float32)
    return p


def cut(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All stretches of all texts, filled up with zeros; their lengths and texts."""
    sizes = np.diff(at)
    counts = -(-sizes // STRETCH)
    owner = np.repeat(np.arange(len(sizes)), counts)
    nth = np.arange(len(owner)) - np.repeat(np.cumsum(counts) - counts, counts)
    begin = at[:-1][owner] + nth * STRETCH
    length = np.minimum(STRETCH, at[1:][owner] - begin)
    place = begin[:, None] + np.arange(STRETCH)
    inside = np.arange(STRETCH) < length[:, None]
    return np.where(inside, data[np.minimum(place, len(data) - 1)] if len(data) else 0, 0), length, owner


def fit(docs: DataFrame, usable: Column) -> tuple[list[str], dict[str, np.ndarray]] | None:
    """The languages of ``docs (doc_id, text, lang)`` and the network's parameters; None without training rows."""
    known = docs.where(usable & F.col("text").rlike(LETTER) & (F.col("lang") != ""))
    of = {r["lang"]: r["n"] for r in known.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not of:
        return None
    languages = sorted(of)
    table = docs.sparkSession.createDataFrame([(k, i, int(1_000_000 * min(1.0, DOCUMENTS / of[k]))) for i, k in enumerate(languages)], "lang string, y int, share int")
    sample = known.join(F.broadcast(table), "lang").where(F.pmod(F.xxhash64("doc_id", "text"), F.lit(1_000_000)) < F.col("share"))

    def shorten(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            stretches, length, owner = cut(*text_bytes(batch.column(1)))
            # EACH stretches of every text, evenly spread.
            total = np.bincount(owner, minlength=batch.num_rows)
            nth = np.arange(len(owner)) - (np.cumsum(total) - total)[owner]
            keep = np.flatnonzero(nth * np.minimum(EACH, total[owner]) // np.maximum(total[owner], 1) > (nth - 1) * np.minimum(EACH, total[owner]) // np.maximum(total[owner], 1))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(owner[keep])), batch.column(2).take(pa.array(owner[keep])), pa.array([s[:n].tobytes() for s, n in zip(stretches[keep], length[keep], strict=True)], pa.binary())], ["doc_id", "y", "part"])

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = pa.Table.from_batches(list(batches)).sort_by([("doc_id", "ascending"), ("part", "ascending")])
        parts = rows.column("part").to_pylist()
        lengths = np.array([len(x) for x in parts])
        stretches = np.frombuffer(b"".join(x.ljust(STRETCH, b"\0") for x in parts), np.uint8).reshape(-1, STRETCH)
        p = train(stretches, lengths, rows.column("y").to_numpy(), len(languages))
        yield pa.RecordBatch.from_arrays([pa.array(list(p)), pa.array([v.tobytes() for v in p.values()], pa.binary())], ["name", "value"])

    parts = materialize(tune(sample.select("doc_id", "text", "y")).mapInArrow(shorten, "doc_id long, y int, part binary"))
    got = {r["name"]: r["value"] for r in parts.coalesce(1).mapInArrow(learn, "name string, value binary").collect()}
    return languages, {k: np.frombuffer(got[k], np.float32).reshape(v.shape) for k, v in start(len(languages)).items()}


def identified(docs: DataFrame, held_out: Column) -> tuple[DataFrame, list[str]]:
    """Every row of ``docs`` with all its columns and three more: whether it has a letter, its language and that one's probability; and their names."""
    lettered_as, lang_as, score_as, text_as = fresh(docs, "lettered", "language", "probability", "its_text")
    named = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
    model = fit(named, ~F.coalesce(held_out, F.lit(False)))
    # The text comes second, where `slices` looks for it.
    plain = docs.select(F.coalesce(F.col("text").cast("string").rlike(LETTER), F.lit(False)).alias(lettered_as), F.col("text").cast("string").alias(text_as), *docs.columns)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema) + f", {lettered_as} boolean, {lang_as} string, {score_as} double"

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 1 << 18):
            lettered = batch.column(0).to_numpy(zero_copy_only=False).astype(bool)
            names, score = ["und"] * batch.num_rows, np.zeros(batch.num_rows)
            if model and lettered.any():
                languages, p = model
                total = np.zeros((batch.num_rows, len(languages)))
                stretches, length, owner = cut(*text_bytes(batch.column(1)))
                for a in range(0, len(owner), 2048):
                    x = np.ascontiguousarray(stretches[a : a + 2048].T)
                    _, each = probabilities(x, p)
                    each *= (np.arange(STRETCH)[:, None] < length[a : a + 2048])[:, :, None]
                    np.add.at(total, owner[a : a + 2048], each.sum(axis=0))
                total /= np.maximum(total.sum(axis=1, keepdims=True), 1e-9)
                best = total.argmax(axis=1)
                names = [languages[k] if ok else "und" for k, ok in zip(best, lettered, strict=True)]
                score = np.where(lettered, np.minimum(total.max(axis=1), 1.0), 0.0)
            yield pa.RecordBatch.from_arrays([*batch.columns[2:], batch.column(0), pa.array(names), pa.array(score)], [*batch.schema.names[2:], lettered_as, lang_as, score_as])

    return tune(plain).mapInArrow(apply, schema), [lettered_as, lang_as, score_as]


def predict(docs: DataFrame, held_out: Column) -> DataFrame:
    """``doc_id, held_out, lang_pred, score`` for every row of ``docs (doc_id, text, lang)``."""
    named = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
    found, (_, lang, score) = identified(named, held_out)
    return found.select("doc_id", F.coalesce(held_out, F.lit(False)).alias("held_out"), F.col(lang).alias("lang_pred"), F.col(score).alias("score"))


def drop_unidentified(docs: DataFrame, held_out: Column, sure: float) -> DataFrame:
    """The rows of ``docs`` whose language is told with probability ``sure``; all columns stay.

    Each row is decided on its own text, whatever its ``doc_id``.  Texts without
    a letter go; where nothing is labelled, so that no language is known, all
    others stay.
    """
    found, (lettered, lang, score) = identified(docs, held_out)
    return found.where(F.col(lettered) & ((F.col(lang) == "und") | (F.col(score) >= sure))).select(*docs.columns)
