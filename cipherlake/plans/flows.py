"""The engine's three ways from end to end: prepare a dataset, score a capture, sum up for a dashboard."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cipherlake.operators import asof, canonical, detect, features, gates, graph, report
from cipherlake.plans.scratch import materialize
from cipherlake.sources.logs import tls_log


@dataclass(frozen=True)
class Prepared:
    merged: DataFrame
    parts: Mapping[str, DataFrame]
    features: DataFrame
    dropped: Mapping[str, Sequence[str]]
    report: gates.Report


def prepare_dataset(name: str, flows: DataFrame, logs: Mapping[str, DataFrame], flow_id: str, tolerance_ms: int = 2000, allow_failures: bool = False) -> Prepared:
    """Gates, as-of match, log joins, gates again, protocol parts, pruned features.

    ``logs`` holds ``conn`` and any of ``ssl, tls, quic, x509`` by name.  The
    joined table is written once; the gates, parts and features read it.
    """
    outcome = gates.Report(name, [gates.gate_duplicates(flows), gates.gate_logs(list(logs))])
    if not allow_failures:
        outcome.raise_if_failed()
    matched = asof.match_connections(flows, logs["conn"], tolerance_ms, flow_id)
    merged = materialize(asof.enrich(matched, tls_log(dict(logs)), logs.get("quic"), logs.get("x509")))
    outcome.outcomes.append(gates.gate_merged(merged))
    if not allow_failures:
        outcome.raise_if_failed()
    parts = features.encrypted_split(merged)
    kept, dropped = features.prune(features.drop_leakage(features.ml_ready(parts["encrypted"])))
    return Prepared(merged, parts, kept, dropped, outcome)


def score_capture(merged: DataFrame, name: str, capture_id: str, order: Sequence[str], first: Callable[[DataFrame], DataFrame], threshold: float, second: Mapping[str, Callable[[DataFrame], DataFrame]], rules: detect.Rules, least: int = 1) -> dict[str, DataFrame]:
    """Scored flows of one capture and the graph of its suspicious ones, under ``scored`` and the graph's names."""
    table = canonical.inference_table(merged, name, capture_id, order)
    scored = materialize(detect.score_tiers(table, first, threshold, second, rules))
    return {"scored": scored, **graph.build(detect.suspicious(scored), least)}


def dashboard(tiered: DataFrame, tables: Mapping[str, DataFrame], key: str, alias_key: bytes | None = None) -> dict[str, DataFrame]:
    """All report tables of a scored table and its graph; ``tiered`` should be materialized, since each part reads it.

    Addresses that have no alias are told by their hash under ``alias_key``.
    """
    shown = graph.view(dict(tables))
    busiest, strongest = materialize(report.top_endpoints(tables["nodes"], 8)), materialize(report.strongest(tiered, key))
    ends = [shown["nodes"].select("endpoint"), busiest.select("endpoint"), *(t.select(F.explode(F.array(*c)).alias("endpoint")) for t, c in ((shown["edges"], ("endpoint_a", "endpoint_b")), (strongest, ("src_ip", "dst_ip"))))]
    catalogue = materialize(report.endpoint_catalogue(tiered, reduce(DataFrame.union, ends)))
    decorated = graph.decorate(shown["nodes"], shown["edges"], catalogue, key=alias_key)
    return {
        "overview": report.overview(tiered),
        "kpis": report.kpi_strip(tiered),
        "funnel": report.stage_funnel(tiered),
        "trend": report.window_order(report.protocol_trend(tiered)),
        "timeline": report.window_order(report.alert_timeline(tiered)),
        "mix": report.service_highlights(report.protocol_breakdown(tiered)).drop("top_requested_server_names"),
        "endpoints": report.decorated_endpoints(busiest, catalogue),
        "spotlight": report.spotlight(tiered, catalogue, key, top=strongest),
        "graph_nodes": decorated["nodes"],
        "graph_edges": decorated["edges"],
    }
