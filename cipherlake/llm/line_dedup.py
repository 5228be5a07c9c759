"""Fuzzy line deduplication: character-shingle MinHash, bands, exact Jaccard, union-find.

A line is what stands between line feeds, lower-cased and with runs of white
space as one space.  Of all near-equal lines of the corpus the one with the
smallest ``(doc_id, line number)`` stays.

Cases: blank lines are always kept and take no part; a line shorter than a
shingle is one shingle; null and empty texts come back unchanged; rows that
share a ``doc_id`` are one document, so the same line number of each is treated
alike; rows without ``doc_id`` come back unchanged; an empty table gives an
empty result; further columns stay as they are.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cipherlake.llm.prefixes import links_across, runs
from cipherlake.llm.text import band_keys, densify, documents_of, fresh, mix, ragged, slices, tune
from cipherlake.operators.components import connected_components
from cipherlake.plans.scratch import materialize, small

#: Characters of a shingle, and least similarity of two lines.
WIDTH, SIMILARITY = 8, 0.8
#: 10 bands of 3 of the 64 bins: of pairs just at 0.8 similarity 0.08 % share no bucket, at 0.85 0.007 %.
BINS, BANDS, ROWS = 64, 10, 3
KEYS = [f"key{k}" for k in range(BANDS)]
#: A bucket of about ``HOT`` nodes, told by a sample of one node in ``RATE``, is split into parts of about so many.
HOT, RATE = 4096, 64
#: Pairs that differ in more of the 64 one-bit samples aren't compared: five deviations above what 0.8 gives.
DIFFERENT = 21
#: Near pairs a node from which a bucket is dense.
DENSE = 4
#: Different lines that a task remembers, so as to tell those it has seen.
SEEN = 1 << 18


def canonical(line: str) -> str:
    return " ".join(line.lower().split())


def line_hash(line: str) -> bytes:
    return hashlib.blake2b(line.encode("utf-8", "surrogatepass"), digest_size=8).digest()


def line_node(line: str) -> int:
    return int.from_bytes(line_hash(line), "little", signed=True)


def line_shingles(lines: list[str], width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of ``width`` characters of canonical lines, and the line of each; a shorter line is one run."""
    step = [np.uint64(pow(0xD6E8FEB86659FD93, 1 << k, 1 << 64)) for k in range(width.bit_length())]
    points = np.frombuffer("".join(lines).encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
    sizes = np.array([len(x) for x in lines])
    begins = np.cumsum(sizes) - sizes
    # Built from runs of 1, 2, 4, ... characters.
    whole, covered, power = np.zeros(len(points) + width, np.uint64), 0, np.concatenate([points * np.uint64(0x9E3779B97F4A7C15), np.zeros(width, np.uint64)])
    for k in range(width.bit_length()):
        if width >> k & 1:
            whole[: len(points)] = whole[: len(points)] * step[k] + power[covered : covered + len(points)] if covered else power[: len(points)]
            covered += 1 << k
        if 2 << k <= width:
            power[: len(points)] = power[: len(points)] * step[k] + power[1 << k : (1 << k) + len(points)]
    owner = np.repeat(np.arange(len(lines)), sizes)
    # No run begins at a line's last characters.
    inside = np.ones(len(points), bool)
    for k in range(1, width):
        inside[(begins + sizes - k)[sizes >= k]] = False
    short = np.flatnonzero(sizes < width)
    single = np.frombuffer(b"".join(line_hash(lines[k]) for k in short), "<u8")
    return np.concatenate([mix(whole[: len(points)][inside]), mix(single)]), np.concatenate([owner[inside], short])


def shingle_rows(lines: list[str], width: int) -> list[np.ndarray]:
    """Of each canonical line the sorted distinct hashes of its shingles."""
    value, owner = line_shingles(lines, width)
    # Shorter lines come last, so a line's hashes stand together.
    order = np.argsort(owner, kind="stable") if len(owner) and (owner[1:] < owner[:-1]).any() else slice(None)
    value, owner, out = value[order], owner[order], []
    ends = np.searchsorted(owner, np.arange(len(lines) + 1))
    for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True):
        row = np.sort(value[a:b])
        out.append(row[np.append(True, row[1:] != row[:-1])])
    return out


def line_signatures(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """``doc_id, line, node, sketch, again`` and a key of each band of every line that isn't blank; ``node`` hashes the canonical line.

    ``again`` tells a line that the task has seen, so most copies are known
    without a shuffle; a copy that it doesn't tell costs time alone.
    """

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        empty, one = np.uint64(2**64 - 1), np.uint64(1)
        seen: set[int] = set()
        for batch in slices(batches, 1 << 18):
            docs_, numbers, lines = [], [], []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if text is not None and doc is not None:
                    for k, line in enumerate(text.split("\n")):
                        if line := canonical(line):
                            docs_.append(doc)
                            numbers.append(k)
                            lines.append(line)
            if not lines:
                continue
            nodes = np.frombuffer(b"".join(map(line_hash, lines)), "<i8")
            again = np.ones(len(nodes), bool)
            values, first = np.unique(nodes, return_index=True)
            fresh_ = np.array([x not in seen for x in values.tolist()], bool)
            again[first[fresh_]] = False
            if len(seen) > SEEN:
                seen.clear()
            seen.update(values[fresh_].tolist())
            value, owner = line_shingles(lines, width)
            cells = np.full(len(lines) * BINS, empty)
            np.minimum.at(cells, owner * BINS + (value >> np.uint64(58)).astype(np.int64), value & np.uint64(2**58 - 1))
            cells = densify(cells.reshape(-1, BINS), empty)
            keys = band_keys(cells, BANDS, ROWS)
            sketch = ((mix(cells + np.arange(BINS, dtype=np.uint64)) & one) << np.arange(BINS, dtype=np.uint64)).sum(axis=1, dtype=np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(docs_, pa.int64()), pa.array(numbers, pa.int32()), pa.array(nodes), pa.array(sketch), pa.array(again), *(pa.array(k) for k in np.ascontiguousarray(keys.T))], ["doc_id", "line", "node", "sketch", "again", *KEYS])

    return tune(docs).mapInArrow(sign, "doc_id long, line int, node long, sketch long, again boolean, " + ", ".join(f"{k} long" for k in KEYS))


def one_each(lines: DataFrame) -> DataFrame:
    """``node, sketch`` and the band keys, once for each node."""
    return lines.groupBy("node").agg(F.first("sketch").alias("sketch"), *(F.first(k).alias(k) for k in KEYS))


def exploded(nodes: DataFrame) -> DataFrame:
    """``node, sketch, key`` for each band."""
    return nodes.select("node", "sketch", F.explode(F.array(*KEYS)).alias("key"))


def alike(a: np.ndarray, b: np.ndarray) -> float:
    """Similarity of two sets of sorted distinct hashes."""
    common = np.count_nonzero(b[np.minimum(np.searchsorted(b, a), len(b) - 1)] == a)
    return common / (len(a) + len(b) - common)


def compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``src, dst, key`` of the pairs to confirm in each bucket of ``key, node, sketch, head``, sorted by ``key``; ``key`` only for dense buckets.

    Nodes of a bucket are taken once each, its head first and the others in an
    order of their own.  A bucket with at most ``DENSE`` near pairs a node gives them all.  In a
    dense one every node is near some hub, and each hub meets the whole bucket.
    """
    for key, node, sketch, head in runs(batches):
        # Most keys have one row; only the others are put in order.
        same = key[1:] == key[:-1]
        some = np.flatnonzero(np.append(False, same) | np.append(same, False))
        key, node, sketch, head = key[some], node[some], sketch[some], head[some].astype(bool)
        order = np.lexsort((node, mix(node.view(np.uint64) + mix(key.view(np.uint64))), ~head, key))
        key, node, sketch, head = key[order], node[order], sketch[order], head[order]
        once = np.append(True, (key[1:] != key[:-1]) | (node[1:] != node[:-1]) | (head[1:] != head[:-1]))[: len(key)]
        key, node, sketch = key[once], node[once], sketch[once]
        if not len(key):
            continue
        sketch = sketch.view(np.uint64)  # bits of negative numbers aren't counted as they stand
        bucket = np.cumsum(np.append(False, key[1:] != key[:-1]))
        size, many = np.bincount(bucket), np.zeros(bucket[-1] + 1, np.int64)
        at, step, found = np.arange(len(key)), 0, []
        while len(at):
            step += 1
            at = at[at + step < len(key)]
            at = at[bucket[at] == bucket[at + step]]
            hit = at[np.bitwise_count(sketch[at] ^ sketch[at + step]) <= DIFFERENT]
            np.add.at(many, bucket[hit], 1)
            found.append((hit, hit + step))
            # A dense bucket is left to its hubs.
            if step & step - 1 == 0 or step % 64 == 0:
                at = at[many[bucket[at]] <= DENSE * size[bucket[at]]]
        src, dst = (np.concatenate([f[k] for f in found] or [np.zeros(0, np.int64)]) for k in (0, 1))
        dense = many > DENSE * size
        keep = ~dense[bucket[src]] & (node[src] != node[dst])
        out = [(node[src[keep]], node[dst[keep]], np.zeros(keep.sum(), np.int64), np.ones(keep.sum(), bool))]
        begins = np.cumsum(size) - size
        for k in np.flatnonzero(dense).tolist():
            part = slice(begins[k], begins[k] + size[k])
            own, bits, free = node[part], sketch[part], np.ones(size[k], bool)
            while free.any():
                hub = int(free.argmax())
                close = np.bitwise_count(bits ^ bits[hub]) <= DIFFERENT
                free &= ~close
                other = own[close & (own != own[hub])]
                out.append((np.full(len(other), own[hub]), other, np.full(len(other), key[part.start]), np.zeros(len(other), bool)))
        src, dst, of, sparse = (np.concatenate(c) for c in zip(*out, strict=True))
        yield pa.RecordBatch.from_arrays([pa.array(src), pa.array(dst), pa.array(of, mask=sparse)], ["src", "dst", "key"])


def crowded(lines: DataFrame) -> DataFrame:
    """``key, head, parts`` of the buckets with about ``HOT`` nodes or more: one node of each, another one in each bucket, and how many parts it needs."""
    some = one_each(lines.where(F.pmod(F.xxhash64("node", F.lit(RATE)), F.lit(RATE)) == 0))
    counted = exploded(some).groupBy("key").agg(F.count("*").alias("n"), F.min(F.struct(F.xxhash64("node", "key").alias("order"), "node", "sketch")).alias("head"))
    return counted.where(F.col("n") >= HOT // RATE).select("key", F.struct("head.node", "head.sketch").alias("head"), F.ceil(F.col("n") * RATE / HOT + 1).cast("int").alias("parts"))


def similar_lines(docs: DataFrame, lines: DataFrame, similarity: float = SIMILARITY, width: int = WIDTH) -> DataFrame:
    """Confirmed links ``(src, dst)`` between different canonical lines.

    Lines with the same canonical text are one node.  In each bucket of each
    band all pairs with near sketches are compared, or in a dense bucket each
    node with hubs.  Where confirmed links leave a dense bucket in several
    components, all pairs of its nodes across components are found by prefix
    filtering, which loses none.  The nodes of a crowded bucket are dealt over
    parts that share one hub.
    """
    keyed = exploded(lines.where("not again"))
    full = materialize(crowded(lines))
    part = F.xxhash64("key", "salt")
    heads = full.withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).select(part.alias("key"), "head.node", "head.sketch", F.lit(True).alias("head"))
    salt = F.pmod(F.xxhash64("node", F.lit(HOT)), F.coalesce("parts", F.lit(1))).cast("int")
    dealt = keyed.join(small(full.select("key", "parts")), "key", "left").withColumn("salt", salt)
    dealt = dealt.select(F.when(F.col("parts").isNotNull(), part).otherwise(F.col("key")).alias("key"), "node", "sketch", F.lit(False).alias("head")).union(heads)
    sorted_ = dealt.repartition("key").sortWithinPartitions("key")
    near = materialize(sorted_.select("key", "node", "sketch", "head").mapInArrow(compared, "src long, dst long, key long").distinct())
    pairs = materialize(near.select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst")).distinct())

    # Nodes of a split bucket don't all meet, and those of a dense one meet hubs only.
    split = exploded(lines).join(small(full.select("key")), "key", "left_semi").select("key", "node")
    dense = materialize(near.where("key is not null").select("key", F.explode(F.array("src", "dst")).alias("node")).union(split).distinct())
    ends = materialize(pairs.select(F.col("src").alias("node")).union(pairs.select("dst")).union(dense.select("node")).distinct())
    at = lines.join(small(ends), "node", "left_semi").groupBy("node").agg(F.min(F.struct("doc_id", "line")).alias("at"), F.first("sketch").alias("sketch"))
    wanted = materialize(at.groupBy("at.doc_id").agg(F.collect_list(F.struct("at.line", "node", "sketch")).alias("wanted")))

    def lookup(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            found = []
            for text, rows in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                parts = (text or "").split("\n")
                # Of rows that share an id the one with the line counts, whichever it is.
                found += [(r["node"], r["sketch"], parts[r["line"]]) for r in rows if r["line"] < len(parts) and line_node(canonical(parts[r["line"]])) == r["node"]]
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*found, strict=True)], ["node", "sketch", "text"])

    texts = tune(docs.join(small(wanted), "doc_id").select("doc_id", "text", "wanted")).mapInArrow(lookup, "node long, sketch long, text string")
    known = materialize(texts.dropDuplicates(["node"]))

    def confirm(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [c.to_pylist() for c in batch.columns[2:]]
            # A line's set is built once a batch.
            names = list({*texts[0], *texts[1]})
            sets = dict(zip(names, shingle_rows([canonical(x) for x in names], width), strict=True))
            keep = [alike(sets[a], sets[b]) >= similarity for a, b in zip(*texts, strict=True)]
            yield batch.filter(pa.array(keep, pa.bool_())).select([0, 1])

    def confirmed(pairs: DataFrame) -> DataFrame:
        """Those of ``pairs``, which should be materialized, that are alike; only their lines are moved."""
        ends = small(materialize(pairs.select(F.explode(F.array("src", "dst")).alias("node")).distinct()))
        texts = known.join(ends, "node", "left_semi")
        both = pairs.join(texts.select(F.col("node").alias("src"), F.col("text").alias("a")), "src").join(texts.select(F.col("node").alias("dst"), F.col("text").alias("b")), "dst")
        return both.select("src", "dst", "a", "b").mapInArrow(confirm, "src long, dst long")

    links = materialize(confirmed(pairs))
    if dense.isEmpty():
        return links
    # Where these are left in several components, they are joined exactly.
    found = dense.join(connected_components(links), "node", "left").withColumn("component", F.coalesce("component", "node"))
    found = materialize(found)
    mixed = found.groupBy("key").agg(F.min("component").alias("a"), F.max("component").alias("b")).where("a < b")
    left = found.join(mixed, "key", "left_semi").select("node", "component").distinct().join(known, "node")

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = shingle_rows([canonical(x) for x in batch.column(3).to_pylist()], width)
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], ragged([x.view(np.int64) for x in sets], pa.int64())], ["node", "component", "sketch", "shingles"])

    sets = left.select("node", "component", "sketch", "text").mapInArrow(build, "node long, component long, sketch long, shingles array<long>")
    return links.union(links_across(sets, int(100 * similarity + 1e-9), DIFFERENT, confirmed))


def repeated_lines(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """``doc_id, removed``: the numbers (from 0) of the lines that go, for the documents that lose any."""
    docs = documents_of(docs)
    lines = materialize(line_signatures(docs))
    joined = connected_components(similar_lines(docs, lines, similarity))
    first = lines.groupBy("node").agg(F.count("*").alias("n"), F.min(F.struct("doc_id", "line")).alias("keep"))
    first = materialize(first.join(joined, "node", "left").where("n > 1 or component is not null"))
    # A table of its own, so that the join may split a large component.
    least = materialize(first.where("component is not null").groupBy("component").agg(F.min("keep").alias("least")))
    first = materialize(first.join(least, "component", "left").select("node", F.coalesce("least", "keep").alias("keep")))
    gone = lines.select("doc_id", "line", "node").join(first, "node").where("doc_id <> keep.doc_id or line <> keep.line")
    return gone.groupBy("doc_id").agg(F.array_sort(F.collect_set("line")).alias("removed"))


def dedup_lines(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """``docs`` without repeated lines, plus ``lines_removed``, which takes the place of a column of that name.

    A document that loses all lines it had goes; one that had none stays.
    """
    gone_id, numbers, emptied = fresh(docs, "gone", "numbers", "emptied")
    gone = small(materialize(repeated_lines(docs, similarity).withColumnsRenamed({"doc_id": gone_id, "removed": numbers})))
    joined = docs.join(gone, docs["doc_id"].cast("long") == gone[gone_id], "left")
    lost = F.col(numbers).isNotNull()
    left = F.filter(F.split("text", "\n"), lambda line, k: ~F.array_contains(F.col(numbers), k))
    joined = joined.withColumn(emptied, lost & ~F.exists(left, lambda line: F.trim(F.regexp_replace(line, r"\s+", " ")) != ""))
    text, removed = F.when(lost, F.array_join(left, "\n")).otherwise(F.col("text")), F.when(lost, F.size(numbers)).otherwise(0)
    kept = joined.where(~F.col(emptied)).select(*(text.alias(c) if c == "text" else F.col(c) for c in docs.columns if c.lower() != "lines_removed"), removed.alias("lines_removed"))
    return kept
