"""Continuous forms: scoring, duplicate suppression, timeline, log matching."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery
from pyspark.sql.types import StructType

from cipherlake.functions.expr import protocol_family
from cipherlake.operators.asof import KEYS, both_orientations
from cipherlake.operators.detect import Rules, apply_rules

LATE = "2 minutes"


def read_flows(spark: SparkSession, folder: str, schema: StructType, per_batch: int | None = None) -> DataFrame:
    """Flows from Parquet files as they arrive."""
    reader = spark.readStream.schema(schema)
    return (reader.option("maxFilesPerTrigger", per_batch) if per_batch else reader).parquet(folder)


def timed(flows: DataFrame, ms: str = "bidirectional_first_seen_ms") -> DataFrame:
    """Adds ``flow_start`` and its watermark."""
    return flows.withColumn("flow_start", F.timestamp_millis(ms)).withWatermark("flow_start", LATE)


def scored(flows: DataFrame, rules: Rules = Rules()) -> DataFrame:  # noqa: B008
    """Family, tiers and alert level of arriving flows that carry scores."""
    return apply_rules(flows.withColumn("protocol_family", protocol_family(flows.columns)), rules)


def without_duplicates(flows: DataFrame, keys: Sequence[str] = (*KEYS, "bidirectional_first_seen_ms")) -> DataFrame:
    """Flows whose key hasn't come before within the watermark."""
    return timed(flows).dropDuplicatesWithinWatermark(list(keys))


def timeline(tiered: DataFrame, size: str = "60 seconds") -> DataFrame:
    """Candidates and alerts per window and capture.

    Windows start at multiples of their size, not at a source's first flow,
    which a stream can't know.
    """
    return timed(tiered).groupBy(F.window("flow_start", size), "capture_id").agg(F.count_if("tier1_pass").alias("candidate_flows"), F.count_if("tier2_pass").alias("suspicious_flows"), F.avg("tier2_consensus_score").alias("mean_score"), F.count_if(F.col("alert_level") == "high").alias("high_alerts"))


def candidate_matches(flows: DataFrame, conn: DataFrame, tolerance_ms: int = 2000, flow_id: str = "event_id") -> DataFrame:
    """Pairs of a flow and a connection with equal keys within the tolerance, from two streams.

    The nearest pair of a flow may come in a later batch, so
    :func:`nearest_matches` picks it from the written pairs.
    """
    left = timed(flows).select(F.col(flow_id).alias("flow_id"), *(F.col(k).cast("string" if k.endswith("ip") else "long").alias(k) for k in KEYS), "flow_start")
    right = both_orientations(conn).withColumn("log_time", F.timestamp_millis("ts_ms")).withWatermark("log_time", LATE).select("uid", "log_time", *(F.col(k).alias(f"_{k}") for k in KEYS))
    near = F.expr(f"log_time between flow_start - interval {tolerance_ms} milliseconds and flow_start + interval {tolerance_ms} milliseconds")
    on = near
    for k in KEYS:
        on = on & (F.col(k) == F.col(f"_{k}"))
    return left.join(right, on).select("flow_id", "flow_start", "uid", "log_time")


def nearest_matches(pairs: DataFrame) -> DataFrame:
    """The nearest connection of each flow; ties go to the earlier, then the smaller uid."""
    distance = F.abs(F.unix_millis("log_time") - F.unix_millis("flow_start"))
    return pairs.groupBy("flow_id").agg(F.min(F.struct(distance.alias("d"), F.col("log_time"), F.col("uid"))).alias("m")).select("flow_id", "m.uid", "m.log_time")


def run_once(stream: DataFrame, path: str, checkpoint: str, mode: str = "append") -> StreamingQuery:
    """Writes everything that is there to Parquet and stops."""
    query = stream.writeStream.format("parquet").outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start(path)
    query.awaitTermination()
    return query


def score_arrivals(flows: DataFrame, score: Callable[[DataFrame], DataFrame], path: str, checkpoint: str, rules: Rules = Rules()) -> StreamingQuery:  # noqa: B008
    """Scores each batch with a batch function and appends it; a repeated batch replaces itself."""

    def write(batch: DataFrame, number: int) -> None:
        apply_rules(score(batch), rules).write.mode("overwrite").parquet(f"{path}/batch={number}")

    query = flows.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return query
