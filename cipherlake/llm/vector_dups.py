"""Near-duplicate vectors: random-hyperplane sign hashing, exact cosines, connected components.

Several tables hash each vector to the signs of its products with random
hyperplanes.  Two vectors of the least similarity share a table's bucket with a
known probability, so the number of tables follows from the number of bits and
from ``MISS``; the number of bits follows from the number of vectors, so that a
bucket holds about ``PER_BUCKET`` unrelated ones at any size.  Vectors that share
a bucket are compared by their exact cosines, and a pair counts in the first
table in which it shares one.  Rows carry their vectors into the buckets: links
are counted and joined to spanning forests where they are found, and no pairs
are shuffled.

A large group of near copies would cost the square of its size.  So crowded
buckets of long hashes give pivots, the mean directions of some of their
members; vectors within half the linking angle of a pivot form its core.  Any
two of a core are linked by the triangle inequality of angles, without being
compared.  A bucket beyond ``PART`` rows is dealt to cells in which every two of
its parts meet, but those of its largest core needn't meet each other.

Cases: vectors that are null, zero, or hold null or non-finite components link
with nothing; shorter vectors are filled up with zeros; of rows that share a
``vec_id`` the smallest usable vector counts, and they give one row; rows without
``vec_id`` link with nothing and give one row without numbers of vectors; an
empty table gives an empty result; further columns take no part.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cipherlake.llm.text import lists
from cipherlake.llm.topk import dense
from cipherlake.operators.components import connected_components
from cipherlake.plans.scratch import drop_table, materialize, small

#: Unrelated vectors of a bucket, and chance that a pair of the least similarity shares none.
PER_BUCKET, MISS = 512, 1e-4
#: A key holds its table's number above this many bits.
KEY_BITS = 40
#: Members from which a long bucket counts as crowded, members whose mean is its pivot, and tables that lead to pivots.
CROWD, MEMBERS, TO_PIVOT = 32, 32, 6
#: Rows of a bucket, or of a part of one, that meet at once, and rows compared together.
PART, TOGETHER = 4096, 512
SEED = 20


def usable_vectors(table: DataFrame, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """``vec_id, x``: one row for each id; ``x`` is null where no row of it has a finite vector."""
    rows = table.select(F.col(key).cast("long").alias("vec_id"), F.col(vector).cast("array<double>").alias("x"))
    finite = F.forall("x", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return rows.groupBy("vec_id").agg(F.min(F.when(F.coalesce(finite, F.lit(False)), F.col("x"))).alias("x"))


def shape(n: int, threshold: float) -> tuple[int, int]:
    """Bits of a hash and number of tables for ``n`` vectors."""
    bits = min(max(1, round(math.log2(max(n, 1) / PER_BUCKET))), KEY_BITS)
    share = (1 - math.acos(threshold) / math.pi) ** bits
    return bits, math.ceil(math.log(MISS) / math.log1p(-share))


def signed(vectors: DataFrame, width: int, bits: int, tables: int, long: int) -> DataFrame:
    """``node, u, keys, bits, bucket`` of the vectors that aren't zero: unit vector, bucket of each table, all signs, long hash."""

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        planes = np.random.default_rng(SEED).normal(size=(width, bits * tables + long))
        powers = 1 << np.arange(max(bits, long), dtype=np.int64)
        for batch in batches:
            x = dense(batch.column(1), width)
            most = np.abs(x).max(axis=1, initial=0)
            keep = np.flatnonzero(most > 0)
            x = x[keep] / most[keep, None]
            x /= np.sqrt((x**2).sum(axis=1))[:, None]
            above = x @ planes > 0
            short = above[:, : bits * tables]
            keys = (short.reshape(-1, tables, bits) * powers[:bits]).sum(axis=2) + (np.arange(tables, dtype=np.int64) << KEY_BITS)
            packed = np.packbits(short, axis=1)
            columns = [pa.array(batch.column(0).to_numpy()[keep]), lists(x), lists(keys), pa.array([r.tobytes() for r in packed], pa.binary()), pa.array((above[:, bits * tables :] * powers[:long]).sum(axis=1))]
            yield pa.RecordBatch.from_arrays(columns, ["node", "u", "keys", "bits", "bucket"])

    return vectors.mapInArrow(sign, "node long, u array<double>, keys array<long>, bits binary, bucket long")


def inner(a: str, b: str):  # noqa: ANN201
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def cores(rows: DataFrame, width: int, bits: int, tables: int, long: int, threshold: float) -> DataFrame | None:
    """``node, core, size``: vectors within half the linking angle of one pivot; None if no long bucket is crowded."""
    crowded = materialize(rows.groupBy("bucket").agg(F.count("*").alias("weight")).where(F.col("weight") >= CROWD))
    if not crowded.take(1):
        return None
    some = Window.partitionBy("bucket").orderBy(F.xxhash64("node"), "node")
    members = rows.select("bucket", "node", "u").join(small(crowded), "bucket").withColumn("r", F.row_number().over(some)).where(F.col("r") <= MEMBERS)
    means = members.select("bucket", F.posexplode("u")).groupBy("bucket", "pos").agg(F.avg("col").alias("m"))
    means = means.groupBy("bucket").agg(F.array_sort(F.collect_list(F.struct("pos", "m"))).alias("m")).select("bucket", F.col("m.m").alias("x"))
    pivots = materialize(signed(means, width, bits, tables, long).select(F.col("node").alias("core"), F.col("u").alias("v"), "keys").join(crowded.withColumnRenamed("bucket", "core"), "core"))
    first = F.slice("keys", 1, TO_PIVOT)
    heaviest = pivots.select(F.explode(first).alias("key"), "core", "weight").groupBy("key").agg(F.max(F.struct("weight", "core")).alias("p")).select("key", "p.*")
    asked = rows.select("node", F.explode(first).alias("key")).join(small(materialize(heaviest)), "key").select("node", "core", "weight").distinct()
    # Of two within this of a pivot, the cosine is the threshold at least; the margin is for rounding.
    near = math.sqrt((1 + threshold) / 2) + 1e-6
    told = asked.join(rows.select("node", "u"), "node").join(small(pivots.select("core", "v")), "core").where(inner("u", "v") >= near)
    told = materialize(told.groupBy("node").agg(F.max(F.struct("weight", "core"))["core"].alias("core")))
    sizes = materialize(told.groupBy("core").agg(F.count("*").alias("size"), F.min("node").alias("least")))
    return materialize(told.join(small(sizes), "core").select("node", "core", "size", "least"))


def dealt(rows: DataFrame) -> DataFrame:
    """``key, i, j, side, node, core, bits, u``: each row in all cells of its buckets; it meets the other side's rows, or on side 2 all."""
    keyed = rows.select(F.explode("keys").alias("key"), "node", "core", "bits", "u")
    counts = keyed.groupBy("key", "core").agg(F.count("*").alias("c")).groupBy("key")
    large = materialize(counts.agg(F.sum("c").alias("n"), F.max(F.when(F.col("core").isNotNull(), F.struct("c", "core"))).alias("m")).where(F.col("n") > PART))
    if not large.take(1):
        return keyed.select("key", F.lit(0).alias("i"), F.lit(0).alias("j"), F.lit(2).alias("side"), "node", "core", "bits", "u")
    up = lambda n: F.ceil(n / PART).cast("int")
    mass = F.coalesce("m.c", F.lit(0))
    large = large.select("key", F.col("m.core").alias("mass"), up(mass).alias("mass_parts"), F.greatest(up(F.col("n") - mass), F.lit(1)).alias("rest_parts"))
    all_rows = keyed.join(small(large), "key", "left").withColumn("in_mass", F.coalesce(F.col("core") == F.col("mass"), F.lit(False)))
    own = F.pmod(F.xxhash64("node"), F.when(F.col("in_mass"), F.col("mass_parts")).otherwise(F.coalesce("rest_parts", F.lit(1)))).cast("int")
    cell = lambda i, j, side: F.struct(i.cast("int").alias("i"), j.cast("int").alias("j"), side.cast("int").alias("side"))
    rest = F.sequence(F.lit(0), F.coalesce("rest_parts", F.lit(1)) - 1)
    as_mass = F.transform(rest, lambda i: cell(i, -1 - F.col("own"), F.lit(1)))
    met = F.transform(rest, lambda j: cell(F.least("own", j), F.greatest("own", j), F.when(j == F.col("own"), 2).otherwise((j < F.col("own")).cast("int"))))
    masses = F.transform(F.sequence(F.lit(0), F.coalesce("mass_parts", F.lit(0))), lambda k: cell(F.col("own"), -k, F.lit(0)))
    as_rest = F.concat(met, F.slice(masses, F.lit(2), F.coalesce("mass_parts", F.lit(0))))
    return all_rows.withColumn("own", own).select("key", F.explode(F.when(F.col("in_mass"), as_mass).otherwise(as_rest)).alias("c"), "node", "core", "bits", "u").select("key", "c.*", "node", "core", "bits", "u")


def cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted batches, cut to one cell ``(key, i, j)`` each."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        held.append(batch)
        three = np.stack([batch.column(k).to_numpy().astype(np.int64) for k in range(3)])
        edges = [*(np.flatnonzero((np.diff(three) != 0).any(axis=0)) + 1).tolist()]
        before = held[-2] if len(held) > 1 else None
        if before is not None and any(before.column(k)[-1].as_py() != three[k, 0] for k in range(3)):
            edges = [0, *edges]
        at = 0
        for edge in edges:
            yield whole([*held[:-1], batch.slice(at, edge - at)])
            held, at = [batch.slice(edge)], edge
    if held:
        yield whole(held)


def whole(parts: list[pa.RecordBatch]) -> pa.RecordBatch:
    return pa.concat_batches([p for p in parts if p.num_rows]) if len(parts) > 1 else parts[0]


def forest(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """For each of ``n`` rows the first row of its component by the links ``(i, j)``."""
    label = np.arange(n)
    while True:
        least = np.minimum(label[i], label[j])
        fresh = label.copy()
        for end in (i, j):
            np.minimum.at(fresh, label[end], least)
        fresh = fresh[fresh]
        if (fresh == label).all():
            return label
        label = fresh


def counted(rows: DataFrame, width: int, bits: int, tables: int, threshold: float) -> DataFrame:
    """``src, dst, n``: numbers of links found at ``src`` outside its core, and forest edges where ``dst`` isn't null."""

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for cell in cells(batches):
            table = cell.column(0)[0].as_py() >> KEY_BITS
            side, node = cell.column(3).to_numpy(), cell.column(4).to_numpy()
            core = cell.column(5).fill_null(-1).to_numpy()
            u = dense(cell.column(7), width)
            if side[0] == 2:
                # The largest core last, since its rows needn't meet.
                names, nth, many = np.unique(core, return_inverse=True, return_counts=True)
                many = np.where(names < 0, 0, many)
                order = np.argsort(nth == many.argmax(), kind="stable") if many.max() else np.arange(len(node))
                left, right = order[: len(order) - many.max()], order
            else:
                left, right = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
            found_i, found_j = [], []
            for a in range(0, len(left), TOGETHER):
                some = left[a : a + TOGETHER]
                against = right[a + 1 :] if side[0] == 2 else right
                i, j = np.nonzero(u[some] @ u[against].T >= threshold)
                if side[0] == 2:
                    later = j >= i
                    i, j = i[later], j[later]
                i, j = some[i], against[j]
                apart = (core[i] != core[j]) | (core[i] < 0)
                i, j = i[apart], j[apart]
                if table and len(i):
                    ends, where = np.unique(np.concatenate([i, j]), return_inverse=True)
                    signs = np.frombuffer(b"".join(cell.column(6).take(pa.array(ends)).to_pylist()), np.uint8).reshape(len(ends), -1)
                    signs = np.unpackbits(signs, axis=1)[:, : bits * table].reshape(len(ends), table, bits)
                    fresh = np.ones(len(i), bool)
                    p, q = where[: len(i)], where[len(i) :]
                    for t in range(table):
                        left_over = np.flatnonzero(fresh)
                        fresh[left_over] = (signs[p[left_over], t] != signs[q[left_over], t]).any(axis=1)
                    i, j = i[fresh], j[fresh]
                found_i.append(i)
                found_j.append(j)
            i, j = (np.concatenate(f) if f else np.zeros(0, np.int64) for f in (found_i, found_j))
            if len(i):
                ends, where = np.unique(np.concatenate([i, j]), return_inverse=True)
                label = forest(len(ends), where[: len(i)], where[len(i) :])
                moved = np.flatnonzero(label != np.arange(len(ends)))
                ids = node[ends]
                src, dst = np.concatenate([ids, ids[moved]]), np.concatenate([np.zeros(len(ids), np.int64), ids[label[moved]]])
                n = np.concatenate([np.bincount(where, minlength=len(ends)), np.zeros(len(moved), np.int64)])
                yield pa.RecordBatch.from_arrays([pa.array(src), pa.array(dst, mask=np.arange(len(src)) < len(ids)), pa.array(n)], ["src", "dst", "n"])

    met = dealt(rows).repartition("key", "i", "j").sortWithinPartitions("key", "i", "j")
    return met.mapInArrow(compare, "src long, dst long, n long")


def linked(table: DataFrame, threshold: float = 0.95) -> DataFrame:
    """``vec_id, n_links, component_id, kept`` for each ``vec_id`` of ``table (vec_id, embedding)``."""
    vectors = materialize(usable_vectors(table))
    there = vectors.where("vec_id is not null and x is not null")
    n, width = there.agg(F.count("*"), F.coalesce(F.max(F.size("x")), F.lit(0))).first()
    width = max(width, 1)
    bits, tables = shape(n, threshold)
    long = min(bits + round(math.log2(PER_BUCKET)), KEY_BITS)
    rows = materialize(signed(there, width, bits, tables, long))
    core = cores(rows, width, bits, tables, long, threshold)
    joined = rows.withColumn("core", F.lit(None).cast("long")) if core is None else rows.join(core.select("node", "core"), "node", "left")
    found = materialize(counted(joined, width, bits, tables, threshold))
    links = found.where("dst is null").groupBy("src").agg(F.sum("n").alias("n"))
    edges = found.where("dst is not null").select("src", "dst")
    if core is not None:
        links = links.union(core.select("node", F.col("size") - 1)).groupBy("src").agg(F.sum("n").alias("n"))
        edges = edges.union(core.where("node <> least").select("node", "least"))
    groups = connected_components(edges)
    out = vectors.select("vec_id").join(links.withColumnRenamed("src", "vec_id"), "vec_id", "left").join(groups.withColumnRenamed("node", "vec_id"), "vec_id", "left")
    out = out.select("vec_id", F.coalesce("n", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component", "vec_id").alias("component_id"))
    out = materialize(out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True))))
    for spent in (vectors, rows, found, groups):
        drop_table(spent)
    return out
