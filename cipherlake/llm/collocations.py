"""Phrase collocations by direct-address tiling of frequency-ranked ids.

Words that are frequent enough get ids in order of their frequency, over all
languages, and texts become sequences of ids with gaps where a piece ends or a
rarer word stands.  The table of neighbouring ids is split into square tiles.
Inside a task a tile that many pairs fall into, which ranking makes the ones
near the origin, is a dense array counted with ``numpy.bincount``; the others
are sorted coordinates with counts.  Both go in equal parts, dealt by a hash
of the pair, to the tasks that merge them.  Frequent pairs are ranked again and
take the words' place: neighbouring pairs are phrases of three words, and
neighbours among these phrases of four.  Each phrase brings the counts of all
its beginnings and ends along, so cuts need no further counting.

Word ids are found by a 64-bit hash of language and word.  It is proven to be
one-to-one over all words of the corpus, inside tasks by comparing bytes and
between them on the counted words; otherwise another seed is taken.  Ids are
looked up in a table that is sent to the tasks up to ``KNOWN`` entries; beyond,
positions are joined with the table by a shuffle.

Cases: a null text counts as empty, a null language as ``und``; repeated rows
count each; a text without words, and an empty table, give nothing; further
columns take no part; texts of any length are read whole.  More than 2**32 - 1
frequent phrases of one length are an error.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cipherlake.llm.prefixes import runs
from cipherlake.llm.text import mix, slices, text_bytes, tune, word_hashes, word_spans
from cipherlake.operators.ranking import dense_numbers
from cipherlake.plans.scratch import drop_table, materialize, small

#: Bytes that end a piece; blanks between words are space and tab.
ENDS = b".,;:!?\n\x0b\x0c\r"
#: Bytes of text handled at once, and most ids that are sent to the tasks.
SLICE, KNOWN = 4 << 20, 2_000_000
#: A tile has 2**SIDE ids a side; of the first CORNER tiles a side, DENSE may be dense arrays, from FULL pairs of a buffer on.
SIDE, CORNER, DENSE, FULL = 10, 64, 8, 1 << 13
#: Pairs counted together, entries that a task merges at once, and occurrences of words to a part of the pairs.
BUFFER, MERGE, PART = 1 << 19, 1 << 19, 1 << 21
#: Documents, and long binary rows, in an Arrow batch; words whose bytes are compared together.
DOCUMENTS, LONG, COMPARED = 1024, 16, 1 << 16
#: No id at this place, and no key.
GAP, NO_KEY = np.uint32(0xFFFFFFFF), np.int64(-(2**63))
#: Shares of a language's phrases ranked apart before they are ranked together.
SHARES = 32

Keys = Callable[[Iterator[pa.RecordBatch]], Iterator[np.ndarray]]


def letters() -> np.ndarray:
    """Lower case for A-Z, and one byte for all that end a piece."""
    table = np.arange(256, dtype=np.uint8)
    table[65:91] += 32
    table[list(ENDS)] = 10
    return table


def words_of(batch: pa.RecordBatch, seed: int) -> tuple[np.ndarray, ...]:
    """Bytes, first byte, end, row, piece and hash of each word of ``lang, text``."""
    data, at = text_bytes(batch.column(1))
    data = letters()[data]
    begins, ends = word_spans(data, at[:-1])
    row = np.searchsorted(at, begins, "right") - 1
    piece = np.cumsum(data == 10, dtype=np.int32)[begins] + row if len(begins) else row
    kinds = batch.column(0).dictionary_encode()
    names, name_at = text_bytes(kinds.dictionary)
    kind = mix(word_hashes(names, name_at[:-1], name_at[1:]) + np.uint64(seed))[kinds.indices.to_numpy()] if batch.num_rows else np.zeros(0, np.uint64)
    h = mix(word_hashes(data + np.uint8(seed), begins, ends) + kind[row])
    return data, begins, ends, row, piece, h


def strings(data: np.ndarray, begins: np.ndarray, ends: np.ndarray) -> pa.Array:
    sizes = ends - begins
    at = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
    flat = data[np.arange(at[-1]) + np.repeat(begins - at[:-1], sizes)]
    return pa.StringArray.from_buffers(len(sizes), pa.py_buffer(at.tobytes()), pa.py_buffer(flat.tobytes()))


def unlike(data: np.ndarray, begins: np.ndarray, ends: np.ndarray, same: np.ndarray) -> bool:
    """Whether the bytes of any word differ from those of the word that ``same`` gives for it."""
    sizes = ends - begins
    if (sizes != sizes[same]).any():
        return True
    for a in range(0, len(sizes), COMPARED):
        some = sizes[a : a + COMPARED]
        inner = np.arange(some.sum()) - np.repeat(np.cumsum(some) - some, some)
        if (data[np.repeat(begins[a : a + COMPARED], some) + inner] != data[np.repeat(begins[same[a : a + COMPARED]], some) + inner]).any():
            return True
    return False


def counted_words(docs: DataFrame, seed: int) -> DataFrame:
    """``lang, word, h, n`` of all words."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, SLICE):
            data, begins, ends, row, _, h = words_of(batch, seed)
            if not len(h):
                continue
            kinds = batch.column(0).dictionary_encode().indices.to_numpy()[row]
            order = np.argsort(h, kind="stable")
            fresh = np.append(True, h[order][1:] != h[order][:-1])
            first = np.flatnonzero(fresh)
            one = order[first]
            same = np.empty(len(h), np.int64)
            same[order] = one[np.cumsum(fresh) - 1]
            if (kinds != kinds[same]).any() or unlike(data, begins, ends, same):
                # Two words of one hash: shown to the caller as the key that no word may have.
                yield pa.RecordBatch.from_arrays([pa.array([""]), pa.array([""]), pa.array([NO_KEY]), pa.array([0], pa.int64())], ["lang", "word", "h", "n"])
                continue
            n = np.diff(np.append(first, len(h)))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(row[one])), strings(data, begins[one], ends[one]), pa.array(h[one].view(np.int64)), pa.array(n)], ["lang", "word", "h", "n"])

    return tune(docs, DOCUMENTS).mapInArrow(count, "lang string, word string, h long, n long").groupBy("lang", "word", "h").agg(F.sum("n").alias("n"))


def word_keys(seed: int) -> Keys:
    """The hashes of texts' words in order, with ``NO_KEY`` between pieces."""

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[np.ndarray]:
        for batch in slices(batches, SLICE):
            *_, piece, h = words_of(batch, seed)
            yield np.insert(h.view(np.int64), np.flatnonzero(np.diff(piece)) + 1, NO_KEY)

    return keys


def pair_keys(batches: Iterator[pa.RecordBatch]) -> Iterator[np.ndarray]:
    """Of sequences of ids, the key of each two neighbours."""
    for batch in batches:
        for row in batch.column(0):
            ids = np.frombuffer(row.as_buffer(), np.uint32)
            pair = (ids[:-1].astype(np.uint64) << np.uint64(32)) | ids[1:].astype(np.uint64)
            yield np.where((ids[:-1] == GAP) | (ids[1:] == GAP), NO_KEY, pair.view(np.int64))


def packed(ids: np.ndarray) -> np.ndarray:
    """A sequence without ids that have no neighbour, and with one gap for several."""
    there = ids != GAP
    near = np.zeros(len(ids), bool)
    near[:-1] |= there[1:]
    near[1:] |= there[:-1]
    ids = np.where(there & near, ids, GAP)
    keep = np.ones(len(ids), bool)
    keep[1:] = (ids[1:] != GAP) | (ids[:-1] != GAP)
    return ids[keep]


def rows_of(sequences: list[np.ndarray]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([s.tobytes() for s in sequences], pa.binary())], ["ids"])


def numbered(rows: DataFrame, keys: Keys, table: DataFrame, batch: int) -> DataFrame:
    """``ids``: the sequences of ``rows``, each key replaced by its id in ``table (key, id)``, a gap where it has none.

    ``batch`` is the number of rows that a task takes at once.
    """
    spark = rows.sparkSession
    if table.limit(KNOWN + 1).count() <= KNOWN:
        known = table.select("key", "id").toArrow()
        have, ids = (known.column(k).to_numpy() for k in (0, 1))
        order = np.argsort(have)
        sent = spark.sparkContext.broadcast((have[order], ids[order].astype(np.uint32)))

        def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            have, ids = sent.value
            for wanted in keys(batches):
                if len(have) and len(wanted):
                    at = np.minimum(np.searchsorted(have, wanted), len(have) - 1)
                    found = packed(np.where(have[at] == wanted, ids[at], GAP))
                    if (found != GAP).any():
                        yield rows_of([found])

        return materialize(tune(rows, batch).mapInArrow(look, "ids binary"))

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = TaskContext.get().partitionId() << 40
        for nth, wanted in enumerate(keys(batches)):
            at = np.flatnonzero(wanted != NO_KEY)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), first + nth)), pa.array(at), pa.array(wanted[at])], ["sequence", "pos", "key"])

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for sequence, pos, ids in runs(batches):
            apart = np.flatnonzero((np.diff(pos) > 1) | (sequence[1:] != sequence[:-1])) + 1
            yield rows_of([packed(np.insert(ids.astype(np.uint32), apart, GAP))])

    found = tune(rows, max(batch, DOCUMENTS)).mapInArrow(spread, "sequence long, pos long, key long").join(table.select("key", "id"), "key")
    # Sorted, not gathered into arrays, so that rows can spill.
    ordered = found.select("sequence", "pos", "id").repartition("sequence").sortWithinPartitions("sequence", "pos")
    return materialize(ordered.mapInArrow(gather, "ids binary"))


class Tiles:
    """Counts of pairs of ids inside a task."""

    def __init__(self, parts: int):
        self.parts = parts
        self.dense: dict[int, int] = {}
        self.counts = np.zeros(0, np.int64)

    def add(self, pairs: np.ndarray) -> Iterator[pa.RecordBatch]:
        """Counts a buffer of pairs; those in sparse tiles come out as sorted coordinates."""
        a, b = (pairs.view(np.uint64) >> np.uint64(32)).astype(np.int64), pairs & np.int64(0xFFFFFFFF)
        row, column = a >> SIDE, b >> SIDE
        corner = (row < CORNER) & (column < CORNER)
        tile = np.where(corner, row * CORNER + column, CORNER * CORNER).astype(np.int64)
        often = np.bincount(tile, minlength=CORNER * CORNER + 1)[:-1]
        for t in np.argsort(-often)[: DENSE - len(self.dense)].tolist():
            if often[t] >= FULL and t not in self.dense:
                self.dense[t] = len(self.dense)
        if more := (len(self.dense) << 2 * SIDE) - len(self.counts):
            self.counts = np.concatenate([self.counts, np.zeros(more, np.int64)])
        dense = np.zeros(CORNER * CORNER + 1, bool)
        dense[list(self.dense)] = True
        low = (1 << SIDE) - 1
        for t, k in self.dense.items():
            # One tile at a time, so that no second copy of all is held.
            here = tile == t
            cell = (a[here] & low) << SIDE | (b[here] & low)
            self.counts[k << 2 * SIDE : (k + 1) << 2 * SIDE] += np.bincount(cell, minlength=1 << 2 * SIDE)
        keys, n = np.unique(pairs[~dense[tile]], return_counts=True)
        yield from self.dealt(keys, n)

    def rest(self) -> Iterator[pa.RecordBatch]:
        """What the dense tiles hold."""
        for t, k in self.dense.items():
            counts = self.counts[k << 2 * SIDE : (k + 1) << 2 * SIDE]
            cell = np.flatnonzero(counts)
            a, b = (t // CORNER << SIDE) + (cell >> SIDE), (t % CORNER << SIDE) + (cell & ((1 << SIDE) - 1))
            yield from self.dealt(a << 32 | b, counts[cell])

    def dealt(self, keys: np.ndarray, n: np.ndarray) -> Iterator[pa.RecordBatch]:
        part = (mix(keys.view(np.uint64)) % np.uint64(self.parts)).astype(np.int64)
        order = np.argsort(part, kind="stable")
        keys, n, part = keys[order], n[order], part[order]
        cuts = np.append(np.flatnonzero(np.append(True, part[1:] != part[:-1])), len(part)) if len(part) else np.zeros(1, np.int64)
        spans = list(zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True))
        columns = [pa.array(part[cuts[:-1]].astype(np.int32)), pa.array([keys[x:y].tobytes() for x, y in spans], pa.binary()), pa.array([n[x:y].astype(np.int64).tobytes() for x, y in spans], pa.binary())]
        yield pa.RecordBatch.from_arrays(columns, ["part", "keys", "n"])


def merged(keys: list[np.ndarray], n: list[np.ndarray]) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """One entry a key."""
    every, counts = np.concatenate(keys), np.concatenate(n)
    order = np.argsort(every, kind="stable")
    every, counts = every[order], counts[order]
    first = np.flatnonzero(np.append(True, every[1:] != every[:-1]))
    return [every[first]], [np.add.reduceat(counts, first)]


def counted_pairs(sequences: DataFrame, least: int, parts: int) -> DataFrame:
    """``key, n`` of all pairs of neighbouring ids that stand at least ``least`` times."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tiles, held, many = Tiles(parts), [], 0
        for every in pair_keys(batches):
            every = every[every != NO_KEY]
            for pair in np.split(every, range(BUFFER, len(every), BUFFER)):
                held.append(pair)
                many += len(pair)
                if many >= BUFFER:
                    yield from tiles.add(np.concatenate(held))
                    held, many = [], 0
        if many:
            yield from tiles.add(np.concatenate(held))
        yield from tiles.rest()

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # One part a partition.
        keys, n, many, most = [], [], 0, MERGE
        for batch in batches:
            for k, c in zip(batch.column(1), batch.column(2), strict=True):
                keys.append(np.frombuffer(k.as_buffer(), np.int64))
                n.append(np.frombuffer(c.as_buffer(), np.int64))
                many += len(keys[-1])
                if many >= most:
                    keys, n = merged(keys, n)
                    many = len(keys[0])
                    most = max(MERGE, 2 * many)
        if many:
            (every,), (counts,) = merged(keys, n)
            keep = counts >= least
            yield pa.RecordBatch.from_arrays([pa.array(every[keep]), pa.array(counts[keep])], ["key", "n"])

    made = sequences.mapInArrow(count, "part int, keys binary, n binary")
    return made.repartitionById(parts, "part").mapInArrow(merge, "key long, n long")


def ranked(table: DataFrame, ties: list[str]) -> DataFrame:
    """Adds ``id``: the place in order of frequency."""
    return dense_numbers(table.withColumn("_often", -F.col("n")), ["_often", *ties], "id").drop("_often")


def frequent_phrases(docs: DataFrame, least: int, longest: int) -> tuple[list[DataFrame], DataFrame]:
    """Tables of phrases of 1 to ``longest`` words, and ``lang, n``.

    A table has ``id, lang, phrase, last, pre, suf`` and, beyond one word, ``a``
    and ``b``, the ids of its first and last words' phrases.  ``pre`` and ``suf``
    hold the counts of its beginnings and ends by their number of words.
    """
    spark = docs.sparkSession
    docs = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    seed = 0
    while True:
        words = materialize(counted_words(docs, seed))
        if not words.groupBy("h").count().where(f"count > 1 or h = {NO_KEY}").take(1):
            break
        drop_table(words)
        seed += 1
    totals = materialize(words.groupBy("lang").agg(F.sum("n").alias("n")))
    every = totals.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-every // PART))
    known = materialize(ranked(words.where(F.col("n") >= least), ["lang", "word"]))
    drop_table(words)
    own = F.array("n")
    tables = [known.select("id", "lang", F.col("word").alias("phrase"), F.col("word").alias("last"), own.alias("pre"), own.alias("suf"))]
    sequences = numbered(docs, word_keys(seed), known.select(F.col("h").alias("key"), "id"), DOCUMENTS)
    for size in range(2, longest + 1):
        pairs = materialize(ranked(materialize(counted_pairs(tune(sequences, LONG), least, parts)), ["key"]))
        if (pairs.agg(F.max("id")).first()[0] or 0) >= int(GAP):
            raise ValueError("too many frequent phrases for 32-bit ids")
        a, b = F.shiftrightunsigned("key", 32), F.col("key").bitwiseAND(0xFFFFFFFF)
        left = tables[-1].select(F.col("id").alias("a"), "lang", "phrase", "pre")
        right = tables[-1].select(F.col("id").alias("b"), "last", "suf")
        both = pairs.select("id", "n", a.alias("a"), b.alias("b")).join(left, "a").join(right, "b")
        grown = lambda c: F.concat(c, F.array("n")).alias(c)
        tables.append(materialize(both.select("id", "a", "b", "lang", F.concat_ws(" ", "phrase", "last").alias("phrase"), "last", grown("pre"), grown("suf"))))
        if size < longest:
            shorter = sequences
            sequences = numbered(shorter, pair_keys, pairs.select("key", "id"), LONG)
            drop_table(shorter)
    drop_table(sequences)
    return tables, totals


#: Of all cuts the one of the lowest score, the first of several; exact, since decimals hold all products.
CUT = """array_min(transform(sequence(1, size(pre) - 1), k -> struct(
    (2000000 * cast(pre[size(pre) - 1] as decimal(20, 0))) div (cast(pre[k - 1] as decimal(20, 0)) + cast(suf[size(pre) - k - 1] as decimal(20, 0))) as score,
    k as k, pre[k - 1] as l, suf[size(pre) - k - 1] as r)))"""


def collocations(docs: DataFrame, least: int = 30, first: int = 2000, inside: int = 80, longest: int = 4) -> DataFrame:
    """``lang, rank, phrase, a, l, r, n, score``: the ``first`` phrases of each language of ``docs (lang, text)``.

    Candidates have 2 to ``longest`` words and stand at least ``least`` times;
    those within a longer one that is at least ``inside`` percent as frequent are
    left out.  It is enough to look at phrases longer by one word, since any
    longer one holds such a phrase that is at least as frequent.
    """
    tables, totals = frequent_phrases(docs, least, longest)
    kept = None
    for size in range(2, longest + 1):
        own = tables[size - 1].withColumn("a_", F.element_at("pre", -1))
        if size < longest:
            longer = tables[size].select(F.explode(F.array("a", "b")).alias("id"), F.element_at("pre", -1).alias("f"))
            longer = longer.groupBy("id").agg(F.max("f").alias("f"))
            covered = f"cast(f as decimal(20, 0)) * 100 >= cast(a_ as decimal(20, 0)) * {inside}"
            own = own.join(longer, "id", "left").where(f"not coalesce({covered}, false)")
        own = own.select("lang", "phrase", F.col("a_").alias("a"), F.expr(CUT).alias("c"))
        kept = own if kept is None else kept.union(own)
    kept = kept.select("lang", "phrase", "a", "c.l", "c.r", F.col("c.score").cast("long").alias("score"))
    order = (F.desc("score"), F.desc("a"), F.col("phrase"))
    share = F.pmod(F.xxhash64("phrase"), F.lit(SHARES))
    # A language's phrases are ranked in shares first, so that few of them meet in one task.
    some = kept.withColumn("s", F.row_number().over(Window.partitionBy("lang", share).orderBy(*order))).where(F.col("s") <= first)
    out = some.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order))).where(F.col("rank") <= first)
    return out.join(small(totals), "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
