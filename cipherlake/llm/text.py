"""Vectorised word, shingle and signature arithmetic shared by the operators.

All functions work on whole texts.  They run inside ``mapInArrow`` tasks, in
slices of about one megabyte, so memory follows the longest single text and
not the number of rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bytes of text handled at once.
SLICE = 1 << 20

U = np.uint64


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (xor-shift and multiply), so that sums of results don't cancel."""
    x = x ^ (x >> U(30))
    x = x * U(0xBF58476D1CE4E5B9)
    x ^= x >> U(27)
    x *= U(0x94D049BB133111EB)
    x ^= x >> U(31)
    return x


def tune(df: DataFrame, rows: int = 512) -> DataFrame:
    """Ask for small Arrow batches, since one row holds a whole text."""
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    return df


def slices(batches: Iterator[pa.RecordBatch], size: int = SLICE) -> Iterator[pa.RecordBatch]:
    """The same rows in batches whose second column holds about ``size`` bytes."""
    for batch in batches:
        lengths = np.diff(offsets(batch.column(1)))
        start, total = 0, 0
        for i, n in enumerate(lengths):
            if total and total + n > size:
                yield batch.slice(start, i - start)
                start, total = i, 0
            total += int(n)
        if start < batch.num_rows:
            yield batch.slice(start)


def offsets(column: pa.Array) -> np.ndarray:
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    raw = np.frombuffer(column.buffers()[1], np.int64 if wide else np.int32)
    return raw[column.offset : column.offset + len(column) + 1].astype(np.int64)


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All texts of a string column end to end, and where each one starts."""
    at = offsets(column)
    data = column.buffers()[2]
    data = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None else np.zeros(0, np.uint8)
    return data, at - at[0]


def lower_ascii(data: np.ndarray) -> np.ndarray:
    table = np.arange(256, dtype=np.uint8)
    table[65:91] += 32
    return table[data]


def word_spans(data: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First byte and end of each word: bytes other than space and 0x09-0x0D, cut at text starts."""
    inside = np.ones(256, bool)
    inside[[9, 10, 11, 12, 13, 32]] = False
    word = inside[data]
    first = word.copy()
    first[1:] &= ~word[:-1]
    own = starts[starts < len(data)]
    first[own] = word[own]
    begins = np.flatnonzero(first)
    last = word.copy()
    last[:-1] &= ~word[1:]
    ends_text = own[own > 0] - 1
    last[ends_text] = word[ends_text]
    return begins, np.flatnonzero(last) + 1


@lru_cache(1)
def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first ``n`` powers of an odd number and of its inverse."""
    return tuple(np.cumprod(np.append(U(1), np.full(n - 1, U(x)))) for x in (0x9E3779B97F4A7C15, 0xF1DE83E19937733D))


def word_hashes(data: np.ndarray, begins: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word's bytes, equal for equal words anywhere."""
    out = np.empty(len(begins), np.uint64)
    letters = mix(np.arange(1, 257, dtype=np.uint64) * U(0x9E3779B97F4A7C15))
    i = 0
    while i < len(begins):
        j = max(i + 1, int(np.searchsorted(ends, begins[i] + SLICE // 4)))
        a, b = int(begins[i]), int(ends[j - 1])
        up, down = powers(1 << max(18, (b - a).bit_length()))
        total = np.zeros(b - a + 1, np.uint64)
        np.cumsum(letters[data[a:b]] * up[: b - a], out=total[1:])
        s, e = begins[i:j] - a, ends[i:j] - a
        out[i:j] = mix((total[e] - total[s]) * down[s] + (e - s).astype(np.uint64))
        i = j
    return out


def shingles(words: np.ndarray, width: int) -> np.ndarray:
    """Hashes of all runs of ``width`` words."""
    n = max(0, len(words) - width + 1)
    out = np.zeros(n, np.uint64)
    for k in range(width):
        out = out * U(0xD6E8FEB86659FD93) + words[k : k + n]
    return mix(out)


def shingle_sets(column: pa.Array, width: int = 5) -> list[np.ndarray]:
    """For each text, the sorted distinct hashes of its lower-cased word shingles.

    Fewer words than ``width`` give the whole sequence as one shingle; no word
    (or null) gives an empty set.
    """
    data, at = text_bytes(column)
    data = lower_ascii(data)
    begins, ends = word_spans(data, at[:-1])
    words = word_hashes(data, begins, ends)
    cut = np.searchsorted(begins, at)
    every = shingles(words, width)
    out = []
    for i in range(len(at) - 1):
        a, b = int(cut[i]), int(cut[i + 1])
        if b - a >= width:
            out.append(np.unique(every[a : b - width + 1]))
        elif b > a:
            out.append(mix(shingles(words[a:b], b - a) + U(b - a)))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def densify(table: np.ndarray, empty: np.uint64) -> np.ndarray:
    """Optimal densification: an empty bin copies the first filled one on its own random walk.

    The walk depends on the bin alone, so equal filled bins give equal copies.
    Rows without any filled bin stay empty.
    """
    bins = table.shape[1]
    filled = table != empty
    rows, cols = np.nonzero(~filled & filled.any(axis=1)[:, None])
    out = table.copy()
    step = 0
    while len(rows):
        step += 1
        to = (mix(cols.astype(np.uint64) * U(0x9E3779B97F4A7C15) + U(step)) % U(bins)).astype(np.int64)
        hit = filled[rows, to]
        out[rows[hit], cols[hit]] = table[rows[hit], to[hit]]
        rows, cols = rows[~hit], cols[~hit]
    return out


def band_keys(table: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """One 64-bit key for each band of ``rows`` bins, different between bands."""
    keys = np.zeros((len(table), bands), np.uint64)
    for k in range(rows):
        keys = keys * U(0xD6E8FEB86659FD93) + table[:, k : bands * rows : rows]
    return mix(keys + mix(np.arange(1, bands + 1, dtype=np.uint64))[None, :]).view(np.int64)


def lists(values: np.ndarray) -> pa.Array:
    """Rows of a matrix as an Arrow list column."""
    n, width = values.shape
    return pa.ListArray.from_arrays(np.arange(n + 1, dtype=np.int32) * np.int32(width), pa.array(values.ravel()))


def ragged(rows: list[np.ndarray], kind: pa.DataType) -> pa.Array:
    flat = np.concatenate(rows) if rows else np.zeros(0)
    ends = np.concatenate([[0], np.cumsum([len(r) for r in rows])]).astype(np.int32)
    return pa.ListArray.from_arrays(ends, pa.array(flat, kind))


def documents_of(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The two columns that most operators need, under fixed names and types."""
    return df.select(F.col(key).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Names like these that no column of ``df`` has, whatever its case."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out
