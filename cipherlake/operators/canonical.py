"""The canonical labelled table: windows, record ids, metadata and the union of sources."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cipherlake.functions.expr import numeric, protocol_family, quality_status, record_id
from cipherlake.operators.ranking import dense_numbers
from cipherlake.plans.scratch import materialize, small

# The canonical metadata columns in their order, and the labels.
METADATA = (
    "record_id",
    "sample_id",
    "label",
    "label_id",
    "attack_family",
    "attack_category",
    "traffic_role",
    "capture_id",
    "protocol_family",
    "window_id",
    "flow_start_ms",
    "flow_end_ms",
    "window_start_ms",
    "window_end_ms",
    "source_dataset",
    "source_name",
    "feature_view",
    "source_row_index",
    "quality_status",
    "quality_failed",
    "quality_report_path",
    "provenance_path",
    "input_csv",
    "is_encrypted",
)
LABELS = {"benign": 0, "malicious": 1}


@dataclass(frozen=True)
class Source:
    """A labelled flow table that goes into the canonical one."""

    name: str
    source_dataset: str
    capture_id: str
    label: str
    attack_family: str = "unknown"
    attack_category: str = "unknown"
    traffic_role: str = "unknown"
    feature_view: str = "flow"
    window_ms: int = 60_000
    encrypted_only: bool = True
    quality_failed: bool | None = None
    quality_report_path: str = ""
    provenance_path: str = ""
    input_path: str = ""
    extra_labels: Mapping[str, str] = field(default_factory=dict)


def anchored_windows(flows: DataFrame, start: str, window_ms: int, source: Sequence[str], capture: str = "capture_id") -> DataFrame:
    """Adds ``window_id, window_start_ms, window_end_ms``: windows of fixed size from each source's first start.

    The anchors, a number for each source, are joined back, broadcast if there
    are few; a window over a whole source would be one task.  A null start gives ``wunknown``; a source without any start ``w000000``.
    """
    anchors = small(materialize(flows.groupBy(*source).agg(F.min(start).alias("_anchor"))))
    keyed = reduce(lambda a, b: a & b, (F.col(f"f.{c}").eqNullSafe(F.col(f"a.{c}")) for c in source))
    joined = flows.alias("f").join(anchors.alias("a"), keyed, "left").select("f.*", "a._anchor")
    index = F.floor((F.col(start) - F.col("_anchor")) / window_ms).cast("long")
    first = F.col("_anchor") + index * window_ms
    number = F.when(F.col("_anchor").isNull(), "000000").when(index.isNull(), "unknown").when(index < 1_000_000, F.lpad(index.cast("string"), 6, "0")).otherwise(index.cast("string"))
    return joined.withColumns({"window_id": F.concat(F.col(capture), F.lit(":w"), number), "window_start_ms": first, "window_end_ms": first + (window_ms - 1)}).drop("_anchor")


def row_index(rows: DataFrame, order: Sequence[str], name: str = "source_row_index") -> DataFrame:
    """Adds the number of each row (from 0) in the given order, whose columns together should be unique."""
    return dense_numbers(rows, order, name)


def canonical_source(flows: DataFrame, source: Source, order: Sequence[str]) -> DataFrame:
    """One source with its metadata columns, extra labels and own columns, in that order."""
    if source.label not in LABELS:
        raise ValueError(f"label must be one of {', '.join(LABELS)}: {source.label}")
    if clash := sorted(set(source.extra_labels) & {*METADATA, *flows.columns}):
        raise ValueError(f"extra labels collide with columns: {', '.join(clash)}")
    own = [c for c in flows.columns if c not in METADATA]
    family = protocol_family(flows.columns)
    rows = flows.withColumn("protocol_family", family).withColumn("is_encrypted", F.col("protocol_family").isin("tls", "quic"))
    rows = row_index(rows.where("is_encrypted") if source.encrypted_only else rows, order)
    missing = F.lit(None).cast("long")
    at = lambda c: numeric(F.col(c)).cast("long") if c in flows.columns else missing
    rows = rows.withColumns({"flow_start_ms": at("bidirectional_first_seen_ms"), "flow_end_ms": at("bidirectional_last_seen_ms"), "capture_id": F.lit(source.capture_id), "source_name": F.lit(source.name)})
    rows = anchored_windows(rows, "flow_start_ms", source.window_ms, ["source_name"])
    key = record_id(F.lit(source.source_dataset), F.lit(source.capture_id), F.lit(source.feature_view), F.col("source_row_index"))
    failed = F.lit(source.quality_failed).cast("boolean")
    constants: dict[str, Column] = {
        "record_id": key,
        "label": F.lit(source.label),
        "label_id": F.lit(LABELS[source.label]),
        **{k: F.lit(getattr(source, k)) for k in ("attack_family", "attack_category", "traffic_role", "source_dataset", "feature_view", "quality_report_path", "provenance_path")},
        "quality_status": quality_status(failed),
        "quality_failed": failed,
        "input_csv": F.lit(source.input_path),
        **{k: F.lit(v) for k, v in sorted(source.extra_labels.items())},
    }
    rows = rows.withColumns(constants).withColumn("sample_id", F.substring("record_id", 1, 16))
    return rows.select(*METADATA, *sorted(source.extra_labels), *own)


def canonical_union(sources: Sequence[tuple[DataFrame, Source]], order: Sequence[str]) -> DataFrame:
    """All sources under one schema: metadata, all extra labels, then the sources' own columns."""
    made = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), (canonical_source(flows, s, order) for flows, s in sources))
    extra = sorted({k for _, s in sources for k in s.extra_labels})
    return made.select(*METADATA, *extra, *(c for c in made.columns if c not in METADATA and c not in extra))


def canonical_order(table: DataFrame) -> DataFrame:
    """Sorted by capture, start (unknown last) and row, for reading; stored tables need only sorted partitions."""
    return table.orderBy("capture_id", F.asc_nulls_last("flow_start_ms"), "source_row_index")


def summary(table: DataFrame, keys: Sequence[str] = ("label", "protocol_family", "source_name", "capture_id", "quality_status")) -> DataFrame:
    """Rows by each of several keys in one pass: ``key, value, rows``; nulls are counted too."""
    pairs = F.explode(F.array(*(F.struct(F.lit(k).alias("key"), F.col(k).cast("string").alias("value")) for k in keys if k in table.columns)))
    return table.select(pairs.alias("p")).groupBy("p.key", "p.value").agg(F.count("*").alias("rows"))


def inference_table(flows: DataFrame, name: str, capture_id: str, order: Sequence[str], source_dataset: str = "inference", feature_view: str = "flow", window_ms: int = 60_000) -> DataFrame:
    """Encrypted flows of one capture with the canonical metadata and no label."""
    made = canonical_source(flows, Source(name, source_dataset, capture_id, "benign", feature_view=feature_view, window_ms=window_ms), order)
    key = record_id(F.lit("inference"), F.lit(name), F.col("source_row_index"))
    return made.withColumns({"record_id": key, "sample_id": F.substring(key, 1, 16), "label": F.lit(""), "label_id": F.lit(None).cast("int"), "attack_family": F.lit("unknown"), "attack_category": F.lit("unknown")})
