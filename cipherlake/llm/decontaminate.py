"""Benchmark decontamination: SimHash of item-sized windows, Hamming blocks, exact check.

Every document is compared with every benchmark item at every word position.
Two multisets of ``g`` and ``h`` shingles reach the least similarity ``s`` only
with ``s (g + h) / (1 + s)`` shingles in common, so only windows with that many
shingles of one item of their size can match; each gets a 64-bit SimHash.  The
index splits fingerprints into ``RADIUS + 1`` blocks: two fingerprints within
the radius agree in one block at least, so the lookup misses none of them.
What it finds is decided by the exact similarity of the shingle multisets, sum
of least counts over sum of largest counts.

Fingerprints of texts just at similarity 0.75 differ in a sixth of their bits
and more, so the radius that misses none of them leaves blocks of two or three
bits, which nearly all items of a size share; the distance over all 64 bits
then leaves one in forty unrelated items.

Cases: null or wordless texts and items match nothing; an item or text of
fewer words than a shingle is one shingle; a document shorter than an item is
one window; repeated rows give repeated results; an empty table on either side
gives an empty result; further columns take no part.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator
from functools import reduce
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import DoubleType, IntegerType, LongType, StructField, StructType

from cipherlake.llm.text import documents_of, fresh, lower_ascii, mix, shingles, slices, text_bytes, tune, word_hashes, word_spans
from cipherlake.plans.scratch import materialize

WIDTH, SIMILARITY = 5, 0.75
#: At similarity 0.75 fingerprints differ in 11 of 64 bits on average, with a deviation of 3.
RADIUS = 24
#: Items that one pass over the documents handles; a larger benchmark takes more passes.
BLOCK = 20_000
#: Bits of the bitmap over shingle hashes, and windows whose fingerprints are made at once.
BITMAP, STRETCH = 22, 4096


def gram(words: np.ndarray, width: int) -> np.ndarray:
    """Shingle hashes; those shorter than the usual width are salted with theirs."""
    return shingles(words, width) if width >= WIDTH else mix(shingles(words, width) + np.uint64(width))


def fingerprint(values: np.ndarray) -> int:
    """64-bit SimHash of a multiset of shingle hashes."""
    bits = np.unpackbits(values.view(np.uint8).reshape(-1, 8), axis=1)
    return int.from_bytes(np.packbits(bits.sum(axis=0, dtype=np.int64) * 2 > len(values)).tobytes(), "big")


def blocks(codes: np.ndarray) -> np.ndarray:
    """The ``RADIUS + 1`` blocks of bits of each fingerprint, a row for each block."""
    edges = [64 * k // (RADIUS + 1) for k in range(RADIUS + 2)]
    return np.stack([codes >> np.uint64(a) & np.uint64((1 << b - a) - 1) for a, b in zip(edges, edges[1:], strict=False)])


class Items:
    """Lookup tables of one block of benchmark items."""

    def __init__(self, rows: list[tuple]):
        self.ids = [r[0] for r in rows]
        self.grams: list[np.ndarray] = []
        self.codes = np.zeros(len(rows), np.uint64)
        of_size: dict[int, list[int]] = defaultdict(list)
        of_width: dict[int, list[int]] = defaultdict(list)
        for item, (_, text) in enumerate(rows):
            data = lower_ascii(np.frombuffer((text or "").encode("utf-8", "surrogatepass"), np.uint8))
            words = word_hashes(data, *word_spans(data, np.zeros(1, np.int64))) if len(data) else np.zeros(0, np.uint64)
            self.grams.append(np.sort(gram(words, min(WIDTH, len(words)))) if len(words) else words)
            if len(words):
                self.codes[item] = fingerprint(self.grams[item])
                of_size[len(words)].append(item)
                of_width[min(WIDTH, len(words))].append(item)
        self.words = np.zeros(len(rows), np.int64)
        for size, items in of_size.items():
            self.words[items] = size
        #: By shingle width: all shingles of items, sorted, in which items each stands, and a bitmap over bits of the hash.
        self.known = {}
        for width, items in of_width.items():
            pairs = np.unique(np.array([(g, item) for item in items for g in self.grams[item].tolist()], np.uint64), axis=0)
            values, first = np.unique(pairs[:, 0], return_index=True)
            seen = np.zeros(1 << BITMAP, bool)
            seen[(values & np.uint64((1 << BITMAP) - 1)).astype(np.int64)] = True
            self.known[width] = values, seen, np.append(first, len(pairs)), pairs[:, 1].astype(np.int64)
        #: Of each item size its items and, for each block, their order by the block's value.
        self.sizes = {}
        for size, items in sorted(of_size.items()):
            own = np.array(items)
            parts = blocks(self.codes[own])
            order = np.argsort(parts, axis=1, kind="stable")
            self.sizes[size] = own, order, np.take_along_axis(parts, order, axis=1)

    def marked(self, words: np.ndarray) -> dict[int, tuple[np.ndarray, np.ndarray]]:
        """By shingle width, at which words a shingle of an item begins, and which one."""
        out = {}
        for width, (values, seen, _, _) in self.known.items():
            own = gram(words, width)
            some = np.flatnonzero(seen[(own & np.uint64((1 << BITMAP) - 1)).astype(np.int64)])
            which = np.minimum(np.searchsorted(values, own[some]), len(values) - 1)
            ok = values[which] == own[some]
            out[width] = some[ok], which[ok]
        return out

    def candidates(self, size: int, code: np.uint64) -> tuple[np.ndarray, np.ndarray]:
        """Items of a size whose fingerprints share a block with ``code`` and lie within the radius, and how far."""
        own, order, values = self.sizes[size]
        found = [order[k, np.searchsorted(values[k], v) : np.searchsorted(values[k], v, "right")] for k, v in enumerate(blocks(np.array([code]))[:, 0])]
        near = own[np.unique(np.concatenate(found))]
        far = np.bitwise_count(self.codes[near] ^ code)
        return near[far <= RADIUS], far[far <= RADIUS]

    def hits(self, words: np.ndarray, marked: dict[int, tuple[np.ndarray, np.ndarray]]) -> dict[int, tuple]:
        """Of each matching item its best window: (similarity, -start, words, Hamming distance)."""
        best: dict[int, tuple] = {}
        starts: dict[int, list[np.ndarray]] = defaultdict(list)
        for width, (at, which) in marked.items():
            _, _, first, items = self.known[width]
            many = first[which + 1] - first[which]
            nth = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
            item, place = items[np.repeat(first[which], many) + nth], np.repeat(at, many)
            order = np.lexsort((place, item))
            item, place = item[order], place[order]
            edges = [0, *(np.flatnonzero(np.diff(item)) + 1).tolist(), len(item)] if len(item) else []
            for a, b in pairwise(edges):
                size = int(self.words[item[a]])
                length = min(size, len(words))
                mine = length - width + 1
                need = SIMILARITY * (mine + size - width + 1) / (1 + SIMILARITY) - 1e-9
                if mine < 1 or b - a < need:
                    continue
                # A window with enough of the item's shingles begins at most a window before one of them.
                own = place[a:b]
                enough = max(1, int(np.ceil(need)))
                ends = own[enough - 1 :]
                low = np.maximum(ends - mine + 1, 0)
                high = np.minimum(own[: len(own) - enough + 1], len(words) - length)
                for x, y in zip(low[low <= high].tolist(), high[low <= high].tolist(), strict=True):
                    starts[size].append(np.arange(x, y + 1))
        for size, some in starts.items():
            some = np.unique(np.concatenate(some))
            for part in np.split(some, np.flatnonzero(np.diff(some) > size) + 1):
                for a in range(0, len(part), STRETCH):
                    self.compare(words, size, min(size, len(words)), part[a : a + STRETCH], best)
        return best

    def compare(self, words: np.ndarray, size: int, length: int, starts: np.ndarray, best: dict[int, tuple]) -> None:
        width = min(WIDTH, size)
        first, mine = int(starts[0]), length - width + 1
        own = gram(words[first : int(starts[-1]) + length], width)
        counted = np.zeros((len(own) + 1, 64), np.int32)
        np.cumsum(np.unpackbits(own.view(np.uint8).reshape(-1, 8), axis=1), axis=0, out=counted[1:])
        bits = (counted[starts - first + mine] - counted[starts - first]) * 2 > mine
        codes = np.packbits(bits, axis=1).view(">u8").ravel().astype(np.uint64)
        for start, code in zip(starts.tolist(), codes, strict=True):
            items, far = self.candidates(size, code)
            if len(items):
                part = Counter(own[start - first : start - first + mine].tolist())
                for item, distance in zip(items.tolist(), far.tolist(), strict=True):
                    its = Counter(self.grams[item].tolist())
                    similarity = (part & its).total() / (part | its).total()
                    if similarity >= SIMILARITY:
                        best[item] = max(best.get(item, (-1,)), (similarity, -start, length, distance))


def found_in(known: Items, batch: pa.RecordBatch) -> list[tuple[int, dict[int, tuple]]]:
    """The rows of a batch whose second column holds items, and what they hold."""
    data, at = text_bytes(batch.column(1))
    data = lower_ascii(data)
    begins, ends = word_spans(data, at[:-1])
    words, cut = word_hashes(data, begins, ends), np.searchsorted(begins, at)
    # Marked words anywhere in the slice, before any document is looked at on its own.
    marked = known.marked(words)
    rows = np.unique(np.concatenate([np.searchsorted(cut, at, "right") - 1 for at, _ in marked.values()] or [np.zeros(0, np.int64)]))
    out = []
    for i in rows.tolist():
        a, b = int(cut[i]), int(cut[i + 1])
        inside = {width: slice(np.searchsorted(at, a), np.searchsorted(at, b - width + 1)) for width, (at, _) in marked.items()}
        own = {width: (at[inside[width]] - a, which[inside[width]]) for width, (at, which) in marked.items()}
        if hits := known.hits(words[a:b], own):
            out.append((i, hits))
    return out


def item_blocks(benchmark: DataFrame, item: str, text: str) -> Iterator[Items]:
    """The benchmark in blocks of about ``BLOCK`` items, each of bounded size on the driver."""
    items = benchmark.select(F.col(item).alias("item_id"), F.col(text).cast("string").alias("text"))
    passes = max(1, -(-items.count() // BLOCK))
    for k in range(passes):
        yield Items([tuple(r) for r in items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(passes)) == k).collect()])


def leaks(docs: DataFrame, benchmark: DataFrame, item: str = "item_id", text: str = "text") -> DataFrame:
    """``doc_id, item_id, start_word, n_words, similarity, hamming``: each contaminated document with each item it holds."""
    docs = documents_of(docs)
    kind = benchmark.select(item).schema[0].dataType
    arrow = to_arrow_schema(StructType([StructField("doc_id", LongType()), StructField("item_id", kind), StructField("start_word", IntegerType()), StructField("n_words", IntegerType()), StructField("similarity", DoubleType()), StructField("hamming", IntegerType())]))
    schema = f"doc_id long, item_id {kind.simpleString()}, start_word int, n_words int, similarity double, hamming int"

    def one_pass(known: Items) -> DataFrame:
        def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in slices(batches):
                ids = batch.column(0).to_pylist()
                out = [(ids[i], known.ids[k], -s, n, sim, d) for i, hits in found_in(known, batch) for k, (sim, s, n, d) in sorted(hits.items())]
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), arrow.types, strict=True)], schema=arrow)

        return tune(docs).mapInArrow(search, schema)

    found = [one_pass(known) for known in item_blocks(benchmark, item, text)]
    if len(found) == 1:
        return found[0]
    return reduce(DataFrame.union, [materialize(part) for part in found])


def decontaminate(docs: DataFrame, benchmark: DataFrame, item: str = "item_id", text: str = "text") -> DataFrame:
    """The rows of ``docs`` whose text holds no benchmark item, whatever their ``doc_id``; all columns stay."""
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)

    def one_pass(docs: DataFrame, known: Items) -> DataFrame:
        # The text comes second, where `slices` looks for it.
        none, its_text = fresh(docs, "none", "its_text")
        plain = docs.select(F.lit(0).alias(none), F.col("text").cast("string").alias(its_text), *docs.columns)

        def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in slices(batches):
                clean = np.ones(batch.num_rows, bool)
                clean[[i for i, _ in found_in(known, batch)]] = False
                kept = batch.filter(pa.array(clean))
                yield pa.RecordBatch.from_arrays(kept.columns[2:], kept.schema.names[2:])

        return tune(plain).mapInArrow(keep, schema)

    for known in item_blocks(benchmark, item, text):
        docs = one_pass(docs, known)
    return docs
