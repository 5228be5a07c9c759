"""Nearest-in-time joins and the enrichment of flows by protocol logs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cipherlake.functions.expr import numeric, protocol_number

KEYS = ("src_ip", "dst_ip", "src_port", "dst_port", "protocol")


def require(df: DataFrame, columns: Sequence[str]) -> None:
    """Fail early if the table lacks a column."""
    if missing := [c for c in columns if c not in df.columns]:
        raise ValueError(f"missing columns: {', '.join(missing)}")


def flow_times(flows: DataFrame) -> DataFrame:
    """Adds ``ts`` in seconds and ``proto_num``, the protocol as a number."""
    require(flows, [*KEYS, "bidirectional_first_seen_ms"])
    return flows.withColumns({"ts": F.col("bidirectional_first_seen_ms") / 1000, "proto_num": numeric(F.col("protocol")).cast("long")})


def both_orientations(conn: DataFrame) -> DataFrame:
    """Each connection once as logged and once with its ends exchanged, in one scan.

    Rows without a known protocol or a time are dropped.
    """
    require(conn, ["uid", "ts_ms", "orig_h", "resp_h", "orig_p", "resp_p", "proto"])
    turn = lambda a, b: F.struct(F.col(f"{a}_h").alias("src_ip"), F.col(f"{b}_h").alias("dst_ip"), F.col(f"{a}_p").cast("long").alias("src_port"), F.col(f"{b}_p").cast("long").alias("dst_port"))
    known = conn.withColumn("protocol", protocol_number(F.col("proto"))).where("protocol is not null and ts_ms is not null")
    return known.select("uid", F.col("ts_ms").cast("long").alias("ts_ms"), F.col("protocol").cast("long").alias("protocol"), F.explode(F.array(turn("orig", "resp"), turn("resp", "orig"))).alias("t")).select("uid", "ts_ms", "t.*", "protocol")


def asof_nearest(left: DataFrame, right: DataFrame, keys: Sequence[str], left_time: str, right_time: str, left_id: str, right_id: str, tolerance: int, bucket: int | None = None) -> DataFrame:
    """Every row of ``left`` with the row of ``right`` nearest in time under equal keys.

    Adds ``right_id`` and ``right_time``, null beyond ``tolerance`` (inclusive).
    Of two at the same distance the earlier wins; of several at one time the
    last is taken from before and the first from after.  Null keys and times
    match nothing; rows that share ``left_id`` are matched each for itself.

    Rows are dealt by keys and by time buckets of ``bucket``, at least twice
    the tolerance: rows of ``right`` go to each bucket whose tolerance zone they
    are in, so a key with any share of the rows is split, and the windows of a
    task stay small.  The left rows go whole through that one exchange and one
    sort; nothing is joined back.
    """
    bucket = max(bucket or 64 * tolerance, 2 * tolerance, 1)
    named = [F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)]
    usable = F.expr(" and ".join([*(f"_k{i} is not null" for i in range(len(keys))), "_t is not null"]))
    l_rows = left.select(*named, F.col(left_time).cast("long").alias("_t"), F.lit(1).alias("_side"), F.lit(None).cast(right.schema[right_id].dataType).alias("_r"), F.struct("*").alias("_row"))
    # Rows that can't match are spread by their ids.
    l_rows = l_rows.withColumn("_b", F.when(usable, F.floor(F.col("_t") / bucket)).otherwise(F.xxhash64(f"_row.{left_id}", "_t")))
    r_rows = right.select(*named, F.col(right_time).cast("long").alias("_t"), F.lit(0).alias("_side"), F.col(right_id).alias("_r"), F.lit(None).cast(l_rows.schema["_row"].dataType).alias("_row")).where(usable)
    zone = F.sequence(F.floor((F.col("_t") - tolerance) / bucket), F.floor((F.col("_t") + tolerance) / bucket))
    u = l_rows.unionByName(r_rows.withColumn("_b", F.explode(zone))).withColumn("_seen", F.when(F.col("_side") == 0, F.struct("_t", "_r")))
    own = f"(partition by {', '.join(f'_k{i}' for i in range(len(keys)))}, _b order by _t, _side, _r)"
    # A row of the same time is found from before, so one order serves both sides.
    before, after = F.expr(f"last_value(_seen) ignore nulls over {own}"), F.expr(f"lead(_seen) ignore nulls over {own}")
    near = u.withColumns({"_p": before, "_n": after}).where("_side = 1")
    back, ahead = F.col("_t") - F.col("_p._t"), F.col("_n._t") - F.col("_t")
    pick = F.when(F.col("_p").isNotNull() & (F.col("_n").isNull() | (back <= ahead)), F.col("_p")).otherwise(F.col("_n"))
    near = near.withColumn("_m", pick).withColumn("_m", F.when(F.abs(F.col("_m._t") - F.col("_t")) <= tolerance, F.col("_m")))
    return near.select("_row.*", F.col("_m._r").alias(right_id), F.col("_m._t").alias(right_time))


def match_connections(flows: DataFrame, conn: DataFrame, tolerance_ms: int = 2000, flow_id: str = "event_id") -> DataFrame:
    """Flows with the ``uid`` and ``ts_ms`` of their nearest connection."""
    require(flows, [*KEYS, "bidirectional_first_seen_ms"])
    return asof_nearest(flows, both_orientations(conn), KEYS, "bidirectional_first_seen_ms", "ts_ms", flow_id, "uid", tolerance_ms)


def match_rate(matched: DataFrame) -> DataFrame:
    """Rows, matched rows and their share."""
    return matched.agg(F.count("*").alias("rows"), F.count("uid").alias("matched"), F.coalesce(F.try_divide(F.count("uid"), F.count("*")), F.lit(0.0)).alias("match_rate"))


def first_per_uid(log: DataFrame, order: Sequence[str]) -> DataFrame:
    """The first row of each uid in the given order, whose last column should be unique; rows without uid go."""
    ranked = Window.partitionBy("uid").orderBy(*order)
    return log.where("uid is not null").withColumn("_n", F.row_number().over(ranked)).where("_n = 1").drop("_n")


def join_log(flows: DataFrame, log: DataFrame, suffix: str, order: Sequence[str]) -> DataFrame:
    """Left join of one log row per uid; columns that both have get the suffix."""
    one = first_per_uid(log, order)
    renamed = one.select("uid", *(F.col(c).alias(c + suffix if c in flows.columns else c) for c in one.columns if c != "uid"))
    return flows.join(renamed, "uid", "left")


def certificate_features(certs: DataFrame, prefix: str = "x509_") -> DataFrame:
    """Per uid: mean, max and min of every column read as a number, mean and max of text lengths, and the number of rows."""
    aggregates = []
    for field in certs.schema:
        if field.name != "uid":
            value = numeric(F.col(field.name))
            aggregates += [f(value).alias(f"{prefix}{field.name}__num_{name}") for name, f in (("mean", F.avg), ("max", F.max), ("min", F.min))]
    for field in certs.schema:
        if field.name != "uid" and isinstance(field.dataType, T.StringType):
            size = F.length(field.name)
            aggregates += [f(size.cast("double")).alias(f"{prefix}{field.name}__len_{name}") for name, f in (("mean", F.avg), ("max", F.max))]
    return certs.where("uid is not null").groupBy("uid").agg(*aggregates, F.count("*").alias(f"{prefix}x509_record_count"))


def enrich(matched: DataFrame, ssl: DataFrame | None = None, quic: DataFrame | None = None, x509: DataFrame | None = None) -> DataFrame:
    """Matched flows with their TLS, QUIC and certificate log fields."""
    out = matched
    for log, suffix in ((ssl, "_zeek_ssl"), (quic, "_zeek_quic")):
        if log is not None:
            out = join_log(out, log, suffix, log.columns)
    return out if x509 is None else out.join(certificate_features(x509), "uid", "left")
