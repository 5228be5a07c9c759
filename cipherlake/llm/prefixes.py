"""Exact links between sets of different components, by prefix filtering.

Order all elements rarest first.  Two sets of ``x`` and ``y`` elements with at
least ``o`` in common share one that stands in either at a place of at most its
size less ``o`` (from 0), so only the first elements of a set make buckets, and
only pairs whose places allow the needed overlap are confirmed.  The order
decides about time alone: no pair is lost.  What a whole family shares comes
last and seldom makes a bucket.

A row brings the parities of its set's elements by residue of their hash: two
sets differ in at least as many elements as these differ in, so a pair that
differs in more than its sizes and the overlap allow is no candidate.

Of every two components that share buckets the nearest pair is confirmed
first, again and again while this joins many.  Most components that belong
together are one then; the remaining candidates across components are all
confirmed.

Cases: no sets, or sets of one component, give no link; an empty set is in no
bucket; repeated elements of a set aren't allowed.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cipherlake.llm.text import mix
from cipherlake.operators.components import connected_components
from cipherlake.plans.scratch import drop_table, materialize, small

#: Most elements whose frequency is sent to the tasks, the most frequent ones; those beyond count as rarer, in order of their hash.
KNOWN = 1_000_000
#: Rows of a bucket that meet in one task at once; a larger bucket is cut into parts, and every two parts meet.
PART = 1 << 14
#: Rows of pairs in a batch, pairs looked at together, and largest bucket that is compared step by step.
BATCH, TOGETHER, STEPPED = 1 << 18, 1 << 20, 64
#: Numbers of 64 parities that a row brings, as one binary value.
PARITIES = 16
#: Share of nearest pairs that must be confirmed for another round of them.
SETTLED = 0.1


def column_values(column: pa.Array) -> np.ndarray:
    """A column as an array; binary values, which are all of one length, as rows of 64-bit numbers."""
    if pa.types.is_binary(column.type):
        at = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1]
        return np.frombuffer(column.buffers()[2], np.uint8)[at[0] : at[-1]].view(np.int64).reshape(len(column), -1)
    return column.to_numpy(zero_copy_only=False)


def runs(batches: Iterator[pa.RecordBatch], least: int = 1 << 18) -> Iterator[list[np.ndarray]]:
    """The columns of sorted batches, cut only where the first column changes."""
    held, rows = [], 0
    for batch in batches:
        held.append([column_values(c) for c in batch.columns])
        rows += batch.num_rows
        if rows >= least:
            columns = [np.concatenate(c) for c in zip(*held, strict=True)]
            cut = int(np.searchsorted(columns[0], columns[0][-1]))
            if cut:
                yield [c[:cut] for c in columns]
            held, rows = [[c[cut:] for c in columns]], rows - cut
            least = max(least, 2 * rows)
    if rows:
        yield [np.concatenate(c) for c in zip(*held, strict=True)]


def frequencies(sets: DataFrame) -> tuple[np.ndarray, np.ndarray, int]:
    """The elements that stand in ``least`` sets or more, sorted, in how many they stand, and ``least``: a power of two from 2 on."""
    counted = materialize(sets.select(F.explode("shingles").alias("t")).groupBy("t").agg(F.count("*").alias("n")).where("n > 1"))
    steps = {r["k"]: r["count"] for r in counted.groupBy(F.floor(F.log2("n")).cast("int").alias("k")).count().collect()}
    lowest = 1
    while sum(n for k, n in steps.items() if k >= lowest) > KNOWN:
        lowest += 1
    known = counted.where(F.col("n") >= 2**lowest).toArrow()
    drop_table(counted)
    t, n = (known.column(k).to_numpy() for k in (0, 1))
    order = np.argsort(t)
    return t[order], n[order], 2**lowest


def parities(elements: np.ndarray, owner: np.ndarray, rows: int) -> np.ndarray:
    """For each set, whether it has an odd number of the elements of each residue, as 64 bits a number."""
    bits = 64 * PARITIES
    odd = np.bincount(owner * bits + (mix(elements.view(np.uint64)) % np.uint64(bits)).astype(np.int64), minlength=rows * bits).astype(np.uint8) & 1
    return np.packbits(odd.reshape(rows, bits), axis=1, bitorder="little").view(np.int64)


def heads(sets: DataFrame, threshold: int) -> DataFrame:
    """``cell, node, component, n, place, sketch, part, parity``: the bucket rows of each set's first elements."""
    elements, often, least = frequencies(sets)
    sent = sets.sparkSession.sparkContext.broadcast((elements, often))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        elements, often = sent.value
        for batch in batches:
            offsets = batch.column(3).offsets.to_numpy().astype(np.int64)
            t = batch.column(3).values.to_numpy(zero_copy_only=False)[offsets[0] : offsets[-1]]
            size = np.diff(offsets)
            owner = np.repeat(np.arange(len(size)), size)
            many = np.ones(len(t), np.int64)
            if len(elements) and len(t):
                at = np.minimum(np.searchsorted(elements, t), len(elements) - 1)
                many = np.where(elements[at] == t, often[at], 1)
            parity = parities(t, owner, len(size))
            order = np.lexsort((mix(t.view(np.uint64)), many, owner))
            t, many = t[order], many[order]
            place = np.arange(len(t)) - (offsets[:-1] - offsets[0])[owner]
            # A partner as short as may be leaves this much of the set; where all frequencies are known, an element of one set has no bucket.
            keep = np.flatnonzero((place <= size[owner] + (-threshold * size[owner] // 100)) & ((many > 1) | (least > 2)))
            t, many, place, owner = t[keep], many[keep], place[keep], owner[keep]
            parts = -(-many // PART)
            node = batch.column(0).to_numpy()[owner]
            own = (mix(node.view(np.uint64)) % parts.astype(np.uint64)).astype(np.int64)
            row = np.repeat(np.arange(len(t)), parts)
            other = np.arange(len(row)) - np.repeat(np.cumsum(parts) - parts, parts)
            low, high = np.minimum(own[row], other).astype(np.uint64), np.maximum(own[row], other).astype(np.uint64)
            cell = np.where(parts[row] == 1, t[row], mix(mix(t[row].view(np.uint64) + low) + high).view(np.int64))
            columns = (cell, node[row], batch.column(1).to_numpy()[owner][row], size[owner][row].astype(np.int32), place[row].astype(np.int32), batch.column(2).to_numpy()[owner][row], own[row].astype(np.int32))
            ends = np.arange(len(row) + 1, dtype=np.int32) * np.int32(8 * PARITIES)
            parity = pa.Array.from_buffers(pa.binary(), len(row), [None, pa.py_buffer(ends), pa.py_buffer(np.ascontiguousarray(parity[owner[row]]))])
            yield pa.RecordBatch.from_arrays([*map(pa.array, columns), parity], ["cell", "node", "component", "n", "place", "sketch", "part", "parity"])

    return sets.select("node", "component", "sketch", "shingles").mapInArrow(cut, "cell long, node long, component long, n int, place int, sketch long, part int, parity binary")


def pairs(rows: DataFrame, threshold: int, different: int, nearest: bool) -> DataFrame:
    """``src, dst, a, b``: candidates of different components ``a < b``; of every two components one nearest pair, or all."""

    def fits(i: np.ndarray, j: np.ndarray, component: np.ndarray, n: np.ndarray, place: np.ndarray, sketch: np.ndarray, parity: np.ndarray, part: np.ndarray | None) -> np.ndarray:
        need = -(-threshold * (n[i] + n[j]) // (100 + threshold))
        ok = (component[i] != component[j]) & (place[i] <= n[i] - need) & (place[j] <= n[j] - need)
        ok &= np.bitwise_count(sketch[i] ^ sketch[j]) <= different
        if part is not None:
            ok &= part[i] != part[j]
        left = np.flatnonzero(ok)
        i, j, need = i[left], j[left], need[left]
        apart = np.bitwise_count(parity[i] ^ parity[j]).sum(axis=1, dtype=np.int64)
        ok[left] = apart <= n[i] + n[j] - 2 * need
        return ok

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for cell, node, component, n, place, sketch, part, parity in runs(batches):
            # Bits of negative numbers aren't counted as they stand.
            sketch, parity = sketch.view(np.uint64), parity.view(np.uint64)
            begins = np.flatnonzero(np.append(True, cell[1:] != cell[:-1]))
            mixed = np.minimum.reduceat(component, begins) < np.maximum.reduceat(component, begins)
            size, split = np.diff(np.append(begins, len(cell))), np.minimum.reduceat(part, begins) < np.maximum.reduceat(part, begins)
            least = np.zeros((0, 5), np.int64)
            held: list[np.ndarray] = []

            def merged(more: list[np.ndarray], least: np.ndarray) -> np.ndarray:
                """The pairs so far as rows (a, b, distance, src, dst), one of a kind."""
                table = np.concatenate([least, *more])
                order = np.lexsort(table.T[::-1]) if nearest else np.lexsort((table[:, 4], table[:, 3]))
                table, kind = table[order], (0, 1) if nearest else (3, 4)
                fresh = np.ones(len(table), bool)
                fresh[1:] = (table[1:, kind[0]] != table[:-1, kind[0]]) | (table[1:, kind[1]] != table[:-1, kind[1]])
                return table[fresh]

            def found(i: np.ndarray, j: np.ndarray, component=component, node=node, sketch=sketch) -> np.ndarray:
                a, b = component[i], component[j]
                return np.stack([np.minimum(a, b), np.maximum(a, b), np.bitwise_count(sketch[i] ^ sketch[j]).astype(np.int64), np.minimum(node[i], node[j]), np.maximum(node[i], node[j])], axis=1)

            columns = (component, n.astype(np.int64), place, sketch, parity)
            # Small buckets all at once: each row with the one after it, then with the next but one, and so on.
            some = np.flatnonzero(mixed & (size <= STEPPED))
            at = np.concatenate([np.arange(a, a + m) for a, m in zip(begins[some].tolist(), size[some].tolist(), strict=True)] or [np.zeros(0, np.int64)])
            end, apart = np.repeat(begins[some] + size[some], size[some]), np.repeat(split[some], size[some])
            for step in range(1, int(size[some].max(initial=1))):
                inside = at + step < end
                at, end, apart = at[inside], end[inside], apart[inside]
                ok = fits(at, at + step, *columns, None) & (~apart | (part[at] != part[at + step]))
                if ok.any():
                    held.append(found(at[ok], at[ok] + step))
                if sum(map(len, held)) >= BATCH:
                    least, held = merged(held, least), []
            for k in np.flatnonzero(mixed & (size > STEPPED)).tolist():
                own = np.arange(begins[k], begins[k] + size[k])
                # The largest component last, since its rows needn't meet.
                names, nth, many = np.unique(component[own], return_inverse=True, return_counts=True)
                own = own[np.lexsort((nth, nth == many.argmax()))]
                probes = size[k] - many.max()
                width = max(1, TOGETHER // int(size[k]))
                for a in range(0, int(probes), width):
                    i, j = np.meshgrid(np.arange(a, min(a + width, probes)), np.arange(a + 1, size[k]), indexing="ij")
                    after = j > i
                    i, j = own[i[after]], own[j[after]]
                    ok = fits(i, j, *columns, part if split[k] else None)
                    if ok.any():
                        held.append(found(i[ok], j[ok]))
                if sum(map(len, held)) >= BATCH:
                    least, held = merged(held, least), []
                    if len(least) >= BATCH:
                        yield pa.RecordBatch.from_arrays([pa.array(least[:, c]) for c in (3, 4, 0, 1, 2)], ["src", "dst", "a", "b", "far"])
                        least = least[:0]
            least = merged(held, least)
            if len(least):
                yield pa.RecordBatch.from_arrays([pa.array(least[:, c]) for c in (3, 4, 0, 1, 2)], ["src", "dst", "a", "b", "far"])

    made = rows.repartition("cell").sortWithinPartitions("cell").mapInArrow(join, "src long, dst long, a long, b long, far long")
    if nearest:
        return made.groupBy("a", "b").agg(F.min(F.struct("far", "src", "dst")).alias("m")).select("m.src", "m.dst", "a", "b")
    return made.groupBy("src", "dst").agg(F.first("a").alias("a"), F.first("b").alias("b"))


def links_across(sets: DataFrame, threshold: int, different: int, confirmed: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Links ``(src, dst)`` that join all components between whose sets a pair reaches ``threshold`` percent similarity.

    ``sets`` has ``node, component, sketch, shingles``; pairs whose sketches
    differ in more than ``different`` bits don't reach it.  ``confirmed`` tells
    which of the candidates ``(src, dst)`` do.
    """
    sets = materialize(sets)
    rows = materialize(heads(sets, threshold))
    links = None
    while True:
        near = materialize(pairs(rows, threshold, different, True))
        told = materialize(near.join(confirmed(near.select("src", "dst")), ["src", "dst"]))
        links = told.select("src", "dst") if links is None else links.union(told.select("src", "dst"))
        asked, joined = near.count(), told.count()
        if joined:
            to = connected_components(told, "a", "b").select(F.col("node").alias("component"), F.col("component").alias("to"))
            rows = rows.join(small(to), "component", "left").withColumn("component", F.coalesce("to", "component")).drop("to")
            rows = rows.select("cell", "node", "component", "n", "place", "sketch", "part", "parity")
        if joined < SETTLED * asked or not joined:
            break
    rest = materialize(pairs(rows, threshold, different, False).select("src", "dst"))
    return materialize(links.union(confirmed(rest)))
