"""The endpoint graph of suspicious flows: edges, clusters, nodes and their tables."""

from __future__ import annotations

import secrets
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cipherlake.functions.expr import endpoints, is_private_address, keyed_hash
from cipherlake.operators.components import connected_components
from cipherlake.operators.detect import top_strings
from cipherlake.operators.ranking import dense_numbers
from cipherlake.plans.scratch import is_small, materialize, small

TOP = 5


def null_safe(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "left") -> DataFrame:
    """Join on equal keys where null equals null; keeps the keys of ``left``."""
    renamed = right.select(*(F.col(k).alias(f"_{k}") for k in keys), *(c for c in right.columns if c not in keys))
    on = reduce(lambda a, b: a & b, (left[k].eqNullSafe(renamed[f"_{k}"]) for k in keys))
    return left.join(renamed, on, how).drop(*(f"_{k}" for k in keys))


def measures() -> list[Column]:
    return [F.count("*").alias("suspicious_flow_count"), F.avg("tier2_consensus_score").alias("mean_consensus_score"), F.max("tier2_consensus_score").alias("max_consensus_score"), F.count_distinct("capture_id").alias("unique_captures"), F.count_distinct("window_id").alias("unique_windows")]


def edges(flows: DataFrame, least: int = 1) -> DataFrame:
    """One row per unordered pair of addresses with at least ``least`` flows."""
    a, b = endpoints(F.col("src_ip"), F.col("dst_ip"))
    paired = flows.withColumns({"endpoint_a": a, "endpoint_b": b})
    keys = ["endpoint_a", "endpoint_b"]
    out = paired.groupBy(*keys).agg(*measures()).where(F.col("suspicious_flow_count") >= least)
    for column, name in (("protocol_family", "top_protocol_families"), ("requested_server_name", "top_requested_server_names")):
        out = null_safe(out, top_strings(paired, keys, column, TOP, name), keys).withColumn(name, F.coalesce(name, F.array().cast("array<string>")))
    return out


def clusters_of(edge_table: DataFrame) -> DataFrame:
    """``endpoint, cluster_id``: components of the graph, numbered by their smallest address."""
    found = connected_components(edge_table, "endpoint_a", "endpoint_b")
    heads = found.select("component").distinct()
    numbered = dense_numbers(heads, ["component"], "_n")
    label = F.concat(F.lit("cluster_"), F.when(F.col("_n") < 10_000, F.lpad(F.col("_n").cast("string"), 4, "0")).otherwise(F.col("_n").cast("string")))
    return found.join(numbered.select("component", label.alias("cluster_id")), "component").select(F.col("node").alias("endpoint"), "cluster_id")


def nodes(edge_table: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per address with the measures of its edges."""
    end = lambda a, b: F.struct(F.col(a).alias("endpoint"), F.col(b).alias("peer"))
    ends = edge_table.select(F.explode(F.array_distinct(F.array(end("endpoint_a", "endpoint_b"), end("endpoint_b", "endpoint_a")))).alias("e"), "suspicious_flow_count", "mean_consensus_score", "max_consensus_score").select("e.*", "suspicious_flow_count", "mean_consensus_score", "max_consensus_score")
    out = ends.groupBy("endpoint").agg(
        F.count("*").alias("edge_count"),
        F.count_distinct("peer").alias("unique_neighbors"),
        F.sum("suspicious_flow_count").alias("suspicious_flow_count"),
        F.avg("mean_consensus_score").alias("mean_incident_score"),
        F.max("max_consensus_score").alias("max_incident_score"),
        F.sum("mean_consensus_score").alias("risk_mass"),
    )
    return out.join(labels, "endpoint", "left").withColumn("is_private", is_private_address(F.col("endpoint")))


def label_flows(flows: DataFrame, labels: DataFrame) -> DataFrame:
    """Adds the cluster of each flow's source; null where its source has no edge left."""
    return flows.join(labels.withColumnRenamed("endpoint", "src_ip"), "src_ip", "left")


def cluster_table(labelled: DataFrame, edge_table: DataFrame, node_table: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per cluster, and one with a null id for flows outside of any."""
    out = labelled.groupBy("cluster_id").agg(*measures())
    of_edges = edge_table.join(labels.withColumnRenamed("endpoint", "endpoint_a"), "endpoint_a").groupBy("cluster_id").agg(F.count("*").alias("edge_count"))
    of_nodes = node_table.groupBy("cluster_id").agg(F.count("*").alias("endpoint_count"), F.count_if(F.coalesce("is_private", F.lit(False))).alias("private_endpoint_count"))
    out = out.join(of_edges, "cluster_id", "left").join(of_nodes, "cluster_id", "left")
    for column, name in (("protocol_family", "top_protocol_families"), ("requested_server_name", "top_requested_server_names")):
        out = null_safe(out, top_strings(labelled, ["cluster_id"], column, TOP, name), ["cluster_id"]).withColumn(name, F.coalesce(name, F.array().cast("array<string>")))
    private = F.coalesce("private_endpoint_count", F.lit(0))
    return out.withColumn("private_endpoint_count", private).withColumn("public_endpoint_count", F.coalesce("endpoint_count", F.lit(0)) - private)


def cluster_windows(labelled: DataFrame) -> DataFrame:
    """Flows, mean score and distinct ends per cluster and window."""
    return labelled.groupBy("cluster_id", "window_id").agg(F.count("*").alias("suspicious_flow_count"), F.avg("tier2_consensus_score").alias("mean_consensus_score"), F.count_distinct("src_ip").alias("unique_src_endpoints"), F.count_distinct("dst_ip").alias("unique_dst_endpoints"))


def backfill(labelled: DataFrame, clusters: DataFrame, node_table: DataFrame, few: bool = False) -> DataFrame:
    """Flows with the measures of their cluster and of both ends.

    ``few`` clusters are broadcast, since nearly all flows may be of one.
    """
    of_cluster = clusters.select("cluster_id", *(F.col(c).alias(f"cluster_{c}") for c in ("endpoint_count", "edge_count", "suspicious_flow_count", "mean_consensus_score", "max_consensus_score")))
    if few:
        of_cluster = F.broadcast(of_cluster)
    out = null_safe(labelled, of_cluster, ["cluster_id"])
    for side in ("src", "dst"):
        mine = node_table.select(F.col("endpoint").alias(f"{side}_ip"), F.col("edge_count").alias(f"{side}_endpoint_degree"), F.col("unique_neighbors").alias(f"{side}_unique_neighbors"), F.col("max_incident_score").alias(f"{side}_max_incident_score"), F.col("is_private").alias(f"{side}_is_private"))
        out = out.join(mine, f"{side}_ip", "left")
    return out


def build(flows: DataFrame, least: int = 1) -> dict[str, DataFrame]:
    """All graph tables of suspicious flows; empty flows give empty tables with their columns."""
    edge_table = materialize(edges(flows, least))
    # Both tables hold a row an address; while small they are broadcast, so that flows of a hub don't meet in one task.
    labels = materialize(clusters_of(edge_table))
    # There are no more clusters than addresses.
    few = is_small(labels)
    labels = F.broadcast(labels) if few else labels
    node_table = small(materialize(nodes(edge_table, labels)))
    labelled = label_flows(flows, labels)
    clusters = cluster_table(labelled, edge_table, node_table, labels)
    with_cluster = edge_table.join(labels.withColumnRenamed("endpoint", "endpoint_a"), "endpoint_a", "left").select(*edge_table.columns, "cluster_id")
    return {"edges": with_cluster, "nodes": node_table, "clusters": clusters, "windows": cluster_windows(labelled), "flows": backfill(labelled, clusters, node_table, few)}


def node_order() -> list[Column]:
    return [F.desc("suspicious_flow_count"), F.desc("unique_neighbors"), F.desc("max_incident_score"), F.asc("endpoint")]


def largest_cluster(clusters: DataFrame) -> DataFrame:
    return clusters.where("cluster_id is not null").orderBy(F.desc("suspicious_flow_count"), F.desc("mean_consensus_score"), F.desc("endpoint_count"), "cluster_id").limit(1).select("cluster_id")


def view(tables: dict[str, DataFrame], cluster_id: str | None = None, most: int = 160) -> dict[str, DataFrame]:
    """Nodes and edges of one cluster (the largest if none is named) for display.

    The ``most`` busiest nodes and the edges among them; if none of its edges
    is among them, its ``2 * most`` busiest edges and their ends.
    """
    chosen = largest_cluster(tables["clusters"]) if cluster_id is None else tables["clusters"].where(F.col("cluster_id") == cluster_id).select("cluster_id").limit(1)
    # What is shown is small and read several times, so it is found once.
    chosen = materialize(chosen)
    mine = tables["nodes"].join(F.broadcast(chosen), "cluster_id", "left_semi")
    own = tables["edges"].join(F.broadcast(chosen), "cluster_id", "left_semi")
    picked = materialize(mine.orderBy(*node_order()).limit(most))
    ends = F.broadcast(picked.select("endpoint"))
    inside = own.join(ends, own["endpoint_a"] == ends["endpoint"], "left_semi").join(ends, F.col("endpoint_b") == ends["endpoint"], "left_semi")
    inside = materialize(inside)
    if inside.isEmpty():
        inside = own.orderBy(F.desc("suspicious_flow_count"), F.desc("mean_consensus_score"), "endpoint_a", "endpoint_b").limit(2 * most)
        inside = materialize(inside)
        shown = inside.select(F.explode(F.array("endpoint_a", "endpoint_b")).alias("endpoint")).distinct()
        picked = mine.join(F.broadcast(shown), "endpoint", "left_semi")
    return {"nodes": picked, "edges": inside, "clusters": tables["clusters"].select("cluster_id", "suspicious_flow_count", "endpoint_count")}


def decorate(nodes_shown: DataFrame, edges_shown: DataFrame, catalogue: DataFrame, labels: int = 8, hub: int = 10, key: bytes | None = None) -> dict[str, DataFrame]:
    """The view with aliases in place of addresses, node sizes, types and labels.

    An address that isn't in the catalogue is told by its hash under ``key``,
    by default one that is drawn anew and kept nowhere.
    """
    key = key or secrets.token_bytes(32)
    hidden = lambda c: keyed_hash(F.col(c), key)
    alias = catalogue.select("endpoint", "alias_id", "display_name", "dominant_family")
    shown = nodes_shown.join(alias, "endpoint", "left")
    # At most as many rows as a view shows.
    everything, busiest = Window.partitionBy(), Window.orderBy(F.desc("suspicious_flow_count"), F.desc("unique_neighbors"), "endpoint")
    largest = F.greatest(F.max("suspicious_flow_count").over(everything), F.lit(1))
    kind = F.when(F.col("is_private") & (F.col("unique_neighbors") > hub), "hub").when(F.col("is_private"), "private").otherwise("public")
    name = F.coalesce("display_name", F.lit("Unlisted Node"))
    out = shown.withColumns({"size": F.round(F.greatest(F.lit(8.0), 12 + 28 * F.sqrt(F.col("suspicious_flow_count") / largest)), 2), "rank": F.row_number().over(busiest), "type": kind})
    out = out.select(F.coalesce("alias_id", hidden("endpoint")).alias("id"), name.alias("name"), "type", F.when((F.col("rank") <= labels) | (F.col("type") != "public"), name).otherwise("").alias("label"), F.coalesce("dominant_family", F.lit("")).alias("service_label"), "suspicious_flow_count", "unique_neighbors", "max_incident_score", "size")
    end = lambda e: alias.select(F.col("endpoint").alias(f"endpoint_{e}"), F.col("alias_id").alias(f"alias_{e}"))
    linked = edges_shown.join(end("a"), "endpoint_a", "left").join(end("b"), "endpoint_b", "left")
    linked = linked.select(F.coalesce("alias_a", hidden("endpoint_a")).alias("source"), F.coalesce("alias_b", hidden("endpoint_b")).alias("target"), F.col("suspicious_flow_count").alias("weight"), F.col("mean_consensus_score").alias("score"))
    return {"nodes": out, "edges": linked}
