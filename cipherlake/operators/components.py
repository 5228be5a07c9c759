"""Connected components of an edge table by randomised contraction."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cipherlake.plans.scratch import drop_table, materialize

#: Edges up to which a contracted graph is finished in one task.
FINISH = 50_000


def finished(live: DataFrame) -> DataFrame:
    """``node, to`` of a graph of at most ``FINISH`` edges, by union-find; ``to`` is the smallest node."""
    kind = live.schema["a"].dataType.simpleString()

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        up: dict = {}

        def root(x):  # noqa: ANN001, ANN202
            up.setdefault(x, x)
            while up[x] != x:
                up[x] = up[up[x]]
                x = up[x]
            return x

        schema = None
        for batch in batches:
            schema = pa.schema([("node", batch.schema.field(0).type), ("to", batch.schema.field(0).type)])
            for a, b in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                a, b = root(a), root(b)
                if a != b:
                    up[max(a, b)] = min(a, b)
        if up:
            yield pa.RecordBatch.from_arrays([pa.array(list(up), schema.field(0).type), pa.array([root(x) for x in up], schema.field(0).type)], schema=schema)

    return live.coalesce(1).mapInArrow(join, f"node {kind}, to {kind}")


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    """One row ``(node, component)`` per node; component is the smallest node.

    In each round every node moves to that one of its neighbours and itself
    that comes first in a fresh random order; edges are then rewritten between
    the chosen nodes.  A constant share of the nodes goes away each round
    whatever the graph's shape, so chains and stars both need few rounds.  A
    round aggregates and joins on node ids: no neighbour list is gathered, and
    a hub is pre-aggregated on the map side.  What is left once the graph has
    shrunk to ``FINISH`` edges is joined by union-find in one task of that size.

    Nulls at either end are ignored, loops give a component of one node,
    repeated edges change nothing, and an empty table gives an empty result.
    """
    current = edges.select(F.col(src).alias("a"), F.col(dst).alias("b")).where("a is not null and b is not null")
    current = materialize(current.distinct())
    loops = current.where("a = b").select(F.col("a").alias("node")).distinct()
    maps: list[DataFrame] = []
    seed = 0
    live = current.where("a <> b")
    spent = [current]
    while left := live.limit(FINISH + 1).count():
        if left <= FINISH:
            maps.append(materialize(finished(live)))
            break
        both = live.union(live.select("b", "a"))
        order = lambda c: F.struct(F.xxhash64(c, F.lit(seed)).alias("h"), c.alias("n"))  # noqa: B023, E731
        chosen = both.groupBy(F.col("a").alias("node")).agg(F.min(order(F.col("b"))).alias("m"))
        chosen = materialize(chosen.select("node", F.least("m", order(F.col("node")))["n"].alias("to")))
        maps.append(chosen)
        ends = [chosen.select(F.col("node").alias(k), F.col("to").alias(f"{k}_to")) for k in ("a", "b")]
        moved = live.join(ends[0], "a").join(ends[1], "b").where("a_to <> b_to")
        moved = moved.select(F.least("a_to", "b_to").alias("a"), F.greatest("a_to", "b_to").alias("b")).distinct()
        live = materialize(moved)
        spent.append(live)
        seed += 1
    if not maps:
        return loops.select("node", F.col("node").alias("component"))
    label = maps[-1]
    for earlier in reversed(maps[:-1]):
        later = label.select(F.col("node").alias("to"), F.col("to").alias("end"))
        label = earlier.join(later, "to", "left").select("node", F.coalesce("end", "to").alias("to"))
    label = materialize(label)
    # A table of its own, so that the join may split a large component.
    least = materialize(label.groupBy("to").agg(F.min("node").alias("component")))
    out = label.join(least, "to").select("node", "component")
    alone = loops.join(label.select("node"), "node", "left_anti").select("node", F.col("node").alias("component"))
    out = materialize(out.union(alone))
    for table in [*spent, *maps, label, least]:
        drop_table(table)
    return out
