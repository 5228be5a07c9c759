"""Near-duplicate documents: one-permutation hashing, bands, star-shaped candidates.

Cases: a null or wordless text has no shingles and is linked with nothing;
rows that share a ``doc_id`` are one document and get one component; a row
without ``doc_id`` is linked with nothing and kept; an empty table gives an
empty result; further columns of the input take no part.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cipherlake.llm.prefixes import links_across
from cipherlake.llm.text import band_keys, densify, documents_of, fresh, lists, mix, ragged, shingle_sets, slices, tune
from cipherlake.operators.components import connected_components
from cipherlake.plans.scratch import materialize, small

#: Bins of a signature; 32 bands of 4 bins miss a pair of similarity 0.75 with probability 5e-6.
BINS, BANDS, ROWS = 128, 32, 4
#: Pairs that differ in more of the 64 one-bit samples aren't compared: five deviations above what 0.75 gives.
DIFFERENT = 22


def signatures(docs: DataFrame) -> DataFrame:
    """``doc_id, n_shingles, h1, h2, sketch`` and the band keys of each text; (n, h1, h2) stands for the set itself."""

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        empty = np.uint64(2**64 - 1)
        for batch in slices(batches):
            sets = shingle_sets(batch.column(1))
            sizes = np.array([len(s) for s in sets], np.int64)
            flat = np.concatenate(sets)
            owner = np.repeat(np.arange(len(sets)), sizes)
            cell = owner * BINS + (flat >> np.uint64(57)).astype(np.int64)
            first = np.flatnonzero(np.diff(cell, prepend=-1))
            table = np.full((len(sets), BINS), empty)
            table.ravel()[cell[first]] = flat[first]
            table = densify(table, empty)
            keys, bit = band_keys(table, BANDS, ROWS), np.arange(64, dtype=np.uint64)
            sketch = ((mix(table[:, :64] + bit) & np.uint64(1)) << bit).sum(axis=1, dtype=np.uint64).view(np.int64)
            sums = []
            for salt in (1, 2):
                total = np.zeros(len(flat) + 1, np.uint64)
                np.cumsum(mix(flat + np.uint64(salt)), out=total[1:])
                ends = np.cumsum(sizes)
                sums.append((total[ends] - total[ends - sizes]).view(np.int64))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes), pa.array(sums[0]), pa.array(sums[1]), pa.array(sketch), lists(keys)], ["doc_id", "n_shingles", "h1", "h2", "sketch", "bands"])

    return tune(docs).mapInArrow(sign, "doc_id long, n_shingles long, h1 long, h2 long, sketch long, bands array<long>")


def full_sets(docs: DataFrame) -> DataFrame:
    """``doc_id`` and the sorted distinct shingle hashes of the whole text."""

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            sets = [s.view(np.int64) for s in shingle_sets(batch.column(1))]
            yield pa.RecordBatch.from_arrays([batch.column(0), ragged(sets, pa.int64())], ["doc_id", "shingles"])

    return tune(docs).mapInArrow(build, "doc_id long, shingles array<long>")


def verified(pairs: DataFrame, sets: DataFrame, threshold: int) -> DataFrame:
    """The pairs ``(src, dst)`` whose full sets reach ``threshold`` percent similarity."""
    a = sets.select(F.col("doc_id").alias("src"), F.col("shingles").alias("s"))
    b = sets.select(F.col("doc_id").alias("dst"), F.col("shingles").alias("t"))
    both = pairs.join(a, "src").join(b, "dst")
    low, high = F.least(F.size("s"), F.size("t")), F.greatest(F.size("s"), F.size("t"))
    both = both.where(low * 100 >= high * threshold).withColumn("common", F.size(F.array_intersect("s", "t")))
    return both.where((F.size("s") + F.size("t") - F.col("common")) * threshold <= F.col("common") * 100).select("src", "dst")


def components(docs: DataFrame, threshold: int = 75) -> DataFrame:
    """``doc_id, n_shingles, component_id, kept`` for every row of ``docs (doc_id, text)``.

    Texts with equal shingle sets become one class, whose smallest ``doc_id``
    stands for it.  In every band each bucket's members are linked to single
    members only (stars), never with each other: first to the one that shares
    most buckets with others, which is the likely centre of a group of copies;
    then, where this left one bucket's members in different components, also
    to the smallest, the largest and a random one.  Members of buckets that are
    still in different components are joined across components by prefix
    filtering, which loses no pair.  Every link is confirmed on the full sets.
    """
    docs = documents_of(docs)
    rows = materialize(signatures(docs))
    known = rows.where("n_shingles > 0 and doc_id is not null")
    classes = materialize(known.groupBy("h1", "h2", "n_shingles").agg(F.min("doc_id").alias("node"), F.first("sketch").alias("sketch"), F.first("bands").alias("bands")))
    copies = known.join(classes.select("h1", "h2", "n_shingles", "node"), ["h1", "h2", "n_shingles"]).where("doc_id <> node").select(F.col("doc_id").alias("src"), F.col("node").alias("dst"))

    keyed = classes.select("node", F.explode("bands").alias("key"))
    buckets = keyed.groupBy("key").agg(F.count("*").alias("n"), F.min("node").alias("lo"), F.max("node").alias("hi")).where("lo < hi")
    # A table of its own, so that the join may split a crowded bucket.
    buckets = materialize(buckets)
    members = materialize(keyed.join(buckets, "key"))
    weight = members.groupBy("node").agg(F.sum("n").alias("weight"))
    ranked = members.join(weight, "node").groupBy("key").agg(F.max(F.struct("weight", "node"))["node"].alias("centre"), F.max(F.struct(F.xxhash64("key", "node"), F.col("node")))["node"].alias("other"))
    members = materialize(members.join(ranked, "key"))
    wanted = materialize(weight.select(F.col("node").alias("doc_id")))
    sets = materialize(full_sets(docs.join(small(wanted), "doc_id", "left_semi")).dropDuplicates(["doc_id"]))

    star = lambda hub: members.select(F.col("node").alias("src"), F.col(hub).alias("dst")).where("src <> dst")
    links = materialize(verified(star("centre").distinct(), sets, threshold))
    found = connected_components(links)
    more = star("other").union(star("lo")).union(star("hi")).distinct()
    for end in ("src", "dst"):
        more = more.join(found.select(F.col("node").alias(end), F.col("component").alias(f"{end}_in")), end, "left")
    more = more.where(F.coalesce("src_in", "src") != F.coalesce("dst_in", "dst")).select("src", "dst")
    links = materialize(links.union(verified(more, sets, threshold)))
    # Buckets that these hubs leave in several components: all pairs across components, exactly.
    found = members.where("n > 2").select("key", "node").join(connected_components(links), "node", "left").withColumn("component", F.coalesce("component", "node"))
    found = materialize(found)
    mixed = found.groupBy("key").agg(F.min("component").alias("a"), F.max("component").alias("b")).where("a < b")
    left = found.join(mixed, "key", "left_semi").select("node", "component").distinct()
    left = left.join(classes.select("node", "sketch"), "node").join(sets.withColumnRenamed("doc_id", "node"), "node")
    links = links.union(links_across(left, threshold, DIFFERENT, lambda pairs: verified(pairs, sets, threshold))).union(copies)
    found = connected_components(links).withColumnRenamed("node", "doc_id")
    out = rows.select("doc_id", "n_shingles").join(found, "doc_id", "left").withColumn("component_id", F.coalesce("component", "doc_id"))
    return out.select("doc_id", "n_shingles", "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)).alias("kept"))


def drop_near_duplicates(docs: DataFrame, threshold: int = 75) -> DataFrame:
    """The rows of ``docs`` whose document is the first of its group; all columns stay."""
    (gone_id,) = fresh(docs, "gone")
    gone = small(materialize(components(docs, threshold).where("not kept").select(F.col("doc_id").alias(gone_id)).distinct()))
    return docs.join(gone, docs["doc_id"].cast("long") == gone[gone_id], "left_anti")
