"""Best-fit packing of token pieces by minimum bin slack.

The bin contents are planned on the histogram of piece lengths, which has at
most ``capacity`` entries whatever the number of pieces.  A planned combination
is used for as many bins as the histogram allows, so the plan is short too.
Spark then numbers the pieces of each length and looks their places up.

Cases: a null or empty text is one piece that holds the end id alone; rows that
share a ``doc_id`` are packed each on its own; a null ``doc_id`` is carried
along; an empty table gives an empty result; further columns take no part.
"""

from __future__ import annotations

import base64
import json
import os
import re
import struct
import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cipherlake.llm.text import documents_of, slices, tune
from cipherlake.plans.scratch import materialize

CAPACITY, END_ID = 1024, 2
TOKENIZER, RANKS = "byte_bpe_50k.json", "byte_bpe_50k.tiktoken"
#: Pieces that share one numbering group; a length shared by more pieces is dealt over several groups.
GROUP = 100_000
#: Distinct words whose ids a task remembers.
REMEMBERED = 200_000

# The tokenizer's split rule, for texts of printable ASCII and extended Latin letters.
# Other texts go through the tokenizer whole.
LATIN = "A-Za-zÀ-ÖØ-öø-ɏ"


class Encoder:
    """Token ids of texts as packed little-endian 32-bit numbers.

    Byte-pair merges never cross the words that the tokenizer splits a text
    into, so each distinct word is encoded once and remembered.  Words are
    merged by tiktoken over the same vocabulary (``ranks``), which takes a
    quarter of the time.  Both give the same ids for texts of printable ASCII,
    tab, line feed, return and ``LATIN``, since there the split rule below is the
    tokenizer's own; a text with another character, or with the content of one
    of the tokenizer's added tokens, goes through the tokenizer file itself.
    """

    def __init__(self, path: str, ranks: str):
        import tiktoken

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        with open(ranks, "rb") as lines:
            table = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
        self.path, self.model = path, None
        with open(path, encoding="utf-8") as file:
            added = [token["content"] for token in json.load(file).get("added_tokens", [])]
        self.added = re.compile("|".join(map(re.escape, added)) or r"(?!)")
        self.merge = tiktoken.Encoding("words", pat_str=r"[\s\S]+", mergeable_ranks=table, special_tokens={}).encode_ordinary
        self.plain = re.compile(rf"[\t\n\r -~{LATIN}]*")
        self.words = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d| ?[{LATIN}]+| ?[0-9]+| ?[^\s{LATIN}0-9]+|\s+(?!\S)|\s+")
        self.known: dict[str, bytes] = {}

    def whole(self, text: str) -> bytes:
        if self.model is None:
            from tokenizers import Tokenizer

            self.model = Tokenizer.from_file(self.path)
        return np.array(self.model.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def ids(self, texts: list[str]) -> list[bytes]:
        split = [self.words.findall(t) if self.plain.fullmatch(t) and not self.added.search(t) else None for t in texts]
        if len(self.known) > REMEMBERED:
            self.known.clear()
        for word in set().union(*(s for s in split if s)) - self.known.keys():
            ids = self.merge(word)
            self.known[word] = struct.pack(f"<{len(ids)}I", *ids)
        get = self.known.__getitem__
        return [self.whole(t) if s is None else b"".join(map(get, s)) for t, s in zip(texts, split, strict=True)]


def pieces(docs: DataFrame, tokenizer: str, ranks: str, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """``doc_id, piece, start, length, ids_crc32``: each document's ids and the end id, cut only if longer than ``capacity``."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, end = Encoder(tokenizer, ranks), np.array([end_id], "<u4").tobytes()
        for batch in slices(batches):
            rows: list[tuple] = []
            texts = [t or "" for t in batch.column(1).to_pylist()]
            for doc, ids in zip(batch.column(0).to_pylist(), encoder.ids(texts), strict=True):
                ids += end
                n = len(ids) // 4
                edges = [0, *range((n - 1) % capacity + 1, n + 1, capacity)]
                rows += [(doc, k, a, b - a, zlib.crc32(ids[4 * a : 4 * b])) for k, (a, b) in enumerate(zip(edges, edges[1:], strict=False))]
            columns = list(zip(*rows, strict=True))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()), strict=True)], ["doc_id", "piece", "start", "length", "ids_crc32"])

    return tune(documents_of(docs)).mapInArrow(cut, "doc_id long, piece int, start long, length long, ids_crc32 long")


def fullest(left: dict[int, int], capacity: int) -> dict[int, int]:
    """The fullest bin that holds the longest length left: a subset-sum over a bitset of reachable fills."""
    longest = max(left)
    room = capacity - longest
    mask = (1 << (room + 1)) - 1
    reach, layers = 1, []
    for length in sorted(left, reverse=True):
        most = min(left[length] - (length == longest), room // length)
        step = 1
        while most > 0 and not reach >> room & 1:
            copies = min(step, most)
            layers.append((length, copies, reach))
            reach |= reach << length * copies & mask
            most -= copies
            step *= 2
    fill = reach.bit_length() - 1
    combination: dict[int, int] = defaultdict(int)
    combination[longest] = 1
    for length, copies, before in reversed(layers):
        if not before >> fill & 1:
            combination[length] += copies
            fill -= length * copies
    return combination


def minimum_bin_slack(counts: dict[int, int], capacity: int) -> list[tuple[dict[int, int], int]]:
    """Bins as ``(copies of each length, number of such bins)`` that use up ``counts``."""
    left = {length: n for length, n in counts.items() if n}
    plan = []
    while left:
        combination = fullest(left, capacity)
        times = min(left[length] // copies for length, copies in combination.items())
        plan.append((dict(combination), times))
        for length, copies in combination.items():
            left[length] -= copies * times
            if not left[length]:
                del left[length]
    return plan


def vocabulary(name: str) -> str:
    """The path of a public tokenizer's file, where that package is installed."""
    import public_tokenizers

    return public_tokenizers.path(name)


def pack(docs: DataFrame, tokenizer: str | None = None, ranks: str | None = None, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """All pieces of ``docs (doc_id, text)`` with ``sequence_id`` and ``offset`` in their sequence."""
    cut = materialize(pieces(docs, tokenizer or vocabulary(TOKENIZER), ranks or vocabulary(RANKS), capacity, end_id))
    counts = {r["length"]: r["n"] for r in cut.groupBy("length").agg(F.count("*").alias("n")).collect()}
    places: dict[int, list[tuple[int, ...]]] = defaultdict(list)  # of a length: (number of its first piece, first sequence, copies in a bin, offset of the first copy)
    used: dict[int, int] = defaultdict(int)
    sequence = 0
    for combination, times in minimum_bin_slack(counts, capacity):
        offset = 0
        for length, copies in combination.items():
            places[length].append((used[length], sequence, copies, offset))
            used[length] += copies * times
            offset += copies * length
        sequence += times
    table = {length: np.array(rows, np.int64).T for length, rows in places.items()}

    groups = 64 + sum(counts.values()) // GROUP
    numbered = cut.withColumn("g", F.pmod(F.xxhash64("doc_id"), F.lit(groups)))
    before = numbered.groupBy("length", "g").agg(F.count("*").alias("n"))
    earlier = Window.partitionBy("length").orderBy("g").rowsBetween(Window.unboundedPreceding, -1)
    before = before.select("length", "g", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"))
    within = Window.partitionBy("length", "g").orderBy("doc_id", "piece", "start", "ids_crc32")
    numbered = numbered.withColumn("number", F.row_number().over(within)).join(before, ["length", "g"]).withColumn("number", F.col("number") - 1 + F.col("before")).drop("g", "before")

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, number = (batch.column(c).to_numpy() for c in ("length", "number"))
            where = np.zeros((2, len(length)), np.int64)
            for one in np.unique(length):
                mine = np.flatnonzero(length == one)
                first, base, copies, offset = table[int(one)]
                k = np.searchsorted(first, number[mine], "right") - 1
                ordinal = number[mine] - first[k]
                where[0, mine] = base[k] + ordinal // copies[k]
                where[1, mine] = offset[k] + ordinal % copies[k] * one
            kept = [batch.column(c) for c in ("doc_id", "piece", "start", "length", "ids_crc32")]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(where[0]), pa.array(where[1])], ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    return numbered.mapInArrow(place, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
