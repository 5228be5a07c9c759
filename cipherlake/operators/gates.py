"""Data-quality gates: metrics in one pass, verdicts on the driver."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cipherlake.functions.expr import encrypted_signal, is_present, is_truncated

FLOW_KEY = ("src_ip", "dst_ip", "src_port", "dst_port", "protocol", "bidirectional_first_seen_ms")


@dataclass(frozen=True)
class Outcome:
    name: str
    status: str
    message: str
    metrics: Mapping[str, float | str] = field(default_factory=dict)


class GateFailure(RuntimeError):
    pass


@dataclass
class Report:
    """Outcomes of the gates of one dataset."""

    dataset: str
    outcomes: list[Outcome] = field(default_factory=list)

    @property
    def failed(self) -> bool:
        return any(o.status == "fail" for o in self.outcomes)

    def raise_if_failed(self) -> None:
        if names := [o.name for o in self.outcomes if o.status == "fail"]:
            raise GateFailure(f"failed gates: {', '.join(names)}")

    def frame(self, spark: SparkSession) -> DataFrame:
        rows = [(self.dataset, self.failed, o.name, o.status, o.message, {k: str(v) for k, v in o.metrics.items()}) for o in self.outcomes]
        return spark.createDataFrame(rows, "dataset_name string, failed boolean, name string, status string, message string, metrics map<string,string>")

    def write(self, spark: SparkSession, path: str) -> None:
        frame = self.frame(spark)
        frame.groupBy("dataset_name", "failed").agg(F.collect_list(F.struct("name", "status", "message", "metrics")).alias("outcomes")).coalesce(1).write.mode("overwrite").json(path)


def duplicate_metrics(flows: DataFrame, keys: Sequence[str] = FLOW_KEY) -> DataFrame:
    """Rows, rows after the first of each key, and their share."""
    per_key = flows.groupBy(*keys).agg(F.count("*").alias("n"))
    return per_key.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("rows"), F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("duplicates")).withColumn("duplicate_rate", F.coalesce(F.try_divide("duplicates", "rows"), F.lit(0.0)))


def gate_duplicates(flows: DataFrame, most: float = 0.0, keys: Sequence[str] = FLOW_KEY) -> Outcome:
    if missing := [k for k in keys if k not in flows.columns]:
        return Outcome("duplicate_flows", "fail", f"missing columns: {', '.join(missing)}")
    m = duplicate_metrics(flows, keys).first().asDict()
    bad = m["duplicate_rate"] > most
    return Outcome("duplicate_flows", "fail" if bad else "pass", "duplicate flow keys" if bad else "flow keys are unique", m)


def gate_logs(present: Sequence[str]) -> Outcome:
    """``conn`` is needed, and one of the logs of encrypted traffic."""
    if "conn" not in present:
        return Outcome("protocol_logs", "fail", "no conn log")
    if not {"ssl", "tls", "quic"} & set(present):
        return Outcome("protocol_logs", "fail", "no ssl, tls or quic log")
    return Outcome("protocol_logs", "pass", "needed logs are present", {"logs": ",".join(sorted(present))})


def merged_metrics(merged: DataFrame) -> DataFrame:
    """Match, leakage and duplicate-uid rates of the joined table in one aggregate."""
    uid = is_present(F.col("uid"))
    rate = lambda a, b: F.coalesce(F.try_divide(a, b), F.lit(0.0))
    counted = merged.agg(
        F.count("*").alias("rows"),
        F.count_if(uid).alias("matched"),
        F.count_if(~encrypted_signal(merged.columns)).alias("not_encrypted"),
        F.count_distinct(F.when(uid, F.col("uid"))).alias("uids"),
    )
    return counted.select(
        "rows",
        "matched",
        "not_encrypted",
        (F.col("matched") - F.col("uids")).alias("duplicate_uids"),
        rate("matched", "rows").alias("match_rate"),
        rate(F.col("rows") - F.col("matched"), F.col("rows")).alias("unmatched_rate"),
        rate("not_encrypted", "rows").alias("not_encrypted_rate"),
        rate(F.col("matched") - F.col("uids"), F.col("matched")).alias("duplicate_uid_rate"),
    )


def gate_merged(merged: DataFrame, match: float = 0.90, unmatched: float = 0.10, not_encrypted: float = 0.05, duplicate_uids: float = 0.0) -> Outcome:
    if "uid" not in merged.columns:
        return Outcome("merged_dataset", "fail", "missing columns: uid")
    m = merged_metrics(merged).first().asDict()
    if not m["rows"]:
        return Outcome("merged_dataset", "fail", "no rows", m)
    rules = {"match_rate": m["match_rate"] < match, "unmatched_rate": m["unmatched_rate"] > unmatched, "not_encrypted_rate": m["not_encrypted_rate"] > not_encrypted, "duplicate_uid_rate": m["duplicate_uid_rate"] > duplicate_uids}
    failed = [name for name, bad in rules.items() if bad]
    return Outcome("merged_dataset", "fail" if failed else "pass", f"out of bounds: {', '.join(failed)}" if failed else "rates are within bounds", m)


def capture_health(tool_output: DataFrame) -> DataFrame:
    """``status`` of each capture from the table ``(capture_id, message, packets)`` of a checking tool's output."""
    status = F.when(F.col("message").isNull() & F.col("packets").isNull(), "warn").when(is_truncated(F.col("message")), "fail").when(F.coalesce(F.col("packets"), F.lit(0)) <= 0, "fail").otherwise("pass")
    return tool_output.withColumn("status", status)
