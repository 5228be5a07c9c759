"""Numbers and running sums over a whole table without a window in one task.

Rows are dealt by ranges of the whole order, in as many partitions as the
session shuffles into, so their size follows the session's settings and not a
number fixed here.  The ranges are written once: their borders come from a
sample, and a partition must hold the same rows each time it is read.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cipherlake.plans.scratch import materialize

#: Spark's row ids hold the partition's number above this many bits, and the row's number in it below.
ROW_BITS = 33


def dense_numbers(rows: DataFrame, order: Sequence[str], name: str) -> DataFrame:
    """Adds the number (from 0) of each row in an order whose columns together are unique.

    A row's place in its sorted partition is added to the count of rows in
    those before it, a table of one row a partition.
    """
    ordered = materialize(rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_i", F.monotonically_increasing_id()))
    part, place = F.shiftright("_i", ROW_BITS), F.col("_i").bitwiseAND((1 << ROW_BITS) - 1)
    counts = ordered.groupBy(part.alias("_p")).agg(F.count("*").alias("_c"))
    before = counts.select("_p", F.coalesce(F.sum("_c").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_b"))
    return ordered.withColumn("_p", part).join(F.broadcast(before), "_p").withColumn(name, place + F.col("_b")).drop("_p", "_i", "_b")


def sums_before(rows: DataFrame, order: str | Column, sums: Mapping[str, str]) -> DataFrame:
    """Adds, under each name, the sum of a column over all rows before this one in a unique order."""
    dealt = materialize(rows.repartitionByRange(order).withColumn("_p", F.spark_partition_id()))
    earlier = Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    totals = dealt.groupBy("_p").agg(*(F.sum(c).alias(f"_t_{n}") for n, c in sums.items()))
    totals = totals.select("_p", *(F.coalesce(F.sum(f"_t_{n}").over(earlier), F.lit(0)).alias(f"_b_{n}") for n in sums))
    within = Window.partitionBy("_p").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    own = dealt.withColumns({f"_w_{n}": F.coalesce(F.sum(c).over(within), F.lit(0)) for n, c in sums.items()}).join(F.broadcast(totals), "_p")
    return own.withColumns({n: F.col(f"_w_{n}") + F.col(f"_b_{n}") for n in sums}).drop("_p", *(f"_{k}_{n}" for k in "wb" for n in sums))
