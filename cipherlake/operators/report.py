"""Dashboard tables over scored flows and graph tables."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cipherlake.functions import expr
from cipherlake.operators.detect import top_strings
from cipherlake.operators.ranking import dense_numbers
from cipherlake.plans.scratch import drop_table, materialize

# Names of the first internal gateways, and of the models.
GREEK = ("Alpha", "Beta", "Gamma", "Delta", "Epsilon", "Zeta", "Eta", "Theta")
MODEL_NAMES = {"gaussian_nb": "Gaussian Naive Bayes", "random_forest": "Random Forest", "gradient_boosting": "Gradient Boosting"}
SEARCHED = ("record_id", "capture_id", "src_ip", "dst_ip", "requested_server_name", "protocol_family", "alert_level")


def rate(a: str | Column, b: str | Column) -> Column:
    return F.coalesce(F.try_divide(a, b), F.lit(0.0))


def explorer_order(key: str) -> list[Column]:
    return [F.desc("tier2_pass"), F.desc_nulls_last("tier2_consensus_score"), F.desc_nulls_last("tier1_probability"), F.asc(key)]


def overview(tiered: DataFrame) -> DataFrame:
    """Key figures in one aggregate."""
    counted = tiered.agg(
        F.count("*").alias("total_flows"),
        F.count_if("tier1_pass").alias("candidate_flows"),
        F.count_if("tier2_pass").alias("suspicious_flows"),
        F.count_if(F.col("protocol_family") == "tls").alias("tls_flows"),
        F.count_if(F.col("protocol_family") == "quic").alias("quic_flows"),
        F.count_distinct("capture_id").alias("capture_count"),
        F.count_distinct("label_id").alias("label_count"),
        F.count_if(F.col("quality_status") == "fail").alias("quality_failed_rows") if "quality_status" in tiered.columns else F.lit(0).cast("long").alias("quality_failed_rows"),
    )
    return counted.withColumns(
        {
            "suspicious_rate": rate("suspicious_flows", "total_flows"),
            "dataset_mode": F.when(F.col("label_count") >= 2, "benchmark_corpus").otherwise("single_label_corpus"),
            "quality_signal": F.when(F.col("quality_failed_rows") > 0, "quality_caveat_present").otherwise("quality_clear"),
        }
    )


def protocol_trend(tiered: DataFrame) -> DataFrame:
    """TLS and QUIC flows per window, with the share of TLS."""
    out = tiered.where("window_id is not null").groupBy("window_id").agg(F.min("window_start_ms").alias("window_start_ms"), F.count_if(F.col("protocol_family") == "tls").alias("tls"), F.count_if(F.col("protocol_family") == "quic").alias("quic"))
    return out.withColumn("tls_share", rate("tls", F.col("tls") + F.col("quic")))


def alert_timeline(tiered: DataFrame) -> DataFrame:
    """Candidates, alerts and mean score per window."""
    out = tiered.groupBy("window_id").agg(F.min("window_start_ms").alias("window_start_ms"), F.count_if("tier1_pass").alias("candidate_flows"), F.count_if("tier2_pass").alias("suspicious_flows"), F.avg("tier2_consensus_score").alias("mean_score"), F.count_if(F.col("alert_level") == "high").alias("high_alerts"))
    return out.withColumns({"label": expr.window_label(F.col("window_id")), "conversion_rate": rate("suspicious_flows", "candidate_flows")})


def window_order(windows: DataFrame) -> DataFrame:
    return windows.orderBy(F.asc_nulls_last("window_start_ms"), "window_id")


def protocol_breakdown(tiered: DataFrame, k: int = 5) -> DataFrame:
    """Flows, alerts and the commonest host names per protocol family."""
    out = tiered.groupBy("protocol_family").agg(F.count("*").alias("total_flows"), F.count_if("tier1_pass").alias("candidate_flows"), F.count_if("tier2_pass").alias("suspicious_flows"), F.avg("tier2_consensus_score").alias("mean_score")).withColumn("suspicious_rate", rate("suspicious_flows", "total_flows"))
    named = tiered.withColumn("_host", F.when(expr.clean_text(F.col("requested_server_name")) != "", F.trim("requested_server_name")))
    return out.join(top_strings(named, ["protocol_family"], "_host", k, "top_requested_server_names"), "protocol_family", "left").withColumn("top_requested_server_names", F.coalesce("top_requested_server_names", F.array().cast("array<string>")))


def service_highlights(breakdown: DataFrame, k: int = 3) -> DataFrame:
    """The services of the commonest hosts, each once, as a subtitle."""
    hosts = F.col("top_requested_server_names")
    services = F.array_distinct(F.transform(hosts, expr.service_from_domain))
    return breakdown.withColumn("subtitle", F.array_join(F.slice(services, 1, k), " · "))


def top_endpoints(nodes: DataFrame, limit: int = 8) -> DataFrame:
    return nodes.orderBy(F.desc("suspicious_flow_count"), F.desc("unique_neighbors"), F.desc("max_incident_score"), "endpoint").limit(limit)


def top_alerts(tiered: DataFrame, key: str, limit: int = 10) -> DataFrame:
    return tiered.orderBy(*explorer_order(key)).limit(limit)


def flow_explorer(tiered: DataFrame, key: str, search: str | None = None, family: str | None = None, level: str | None = None, only_suspicious: bool = False, limit: int = 100, offset: int = 0, literal: bool = False) -> tuple[DataFrame, DataFrame]:
    """The number of matching flows, and one page of them.

    ``search`` is a regular expression over several columns, or plain text if
    ``literal``.
    """
    out = tiered
    if family:
        out = out.where(F.lower("protocol_family") == family.lower())
    if level:
        out = out.where(F.lower("alert_level") == level.lower())
    if only_suspicious:
        out = out.where("tier2_pass")
    if search:
        hay = F.lower(F.concat_ws(" ", *(F.coalesce(F.col(c).cast("string"), F.lit("")) for c in SEARCHED if c in tiered.columns)))
        out = out.where(hay.contains(search.lower()) if literal else hay.rlike(search.lower()))
    return out.agg(F.count("*").alias("total")), out.orderBy(*explorer_order(key)).offset(offset).limit(limit)


def with_services(flows: DataFrame) -> DataFrame:
    domain, application = F.col("requested_server_name"), F.col("application_name")
    return flows.withColumns({"service_family": expr.service_family(domain, application), "service_name": expr.display_service(domain, application), "protocol_label": expr.protocol_label(F.col("protocol_family"))})


def most_common(rows: DataFrame, key: str, values: Mapping[str, str], weight: str) -> DataFrame:
    """``key, count`` and, under each name, the value of most weight of a column; ties by value."""
    kinds = F.explode(F.array(*(F.struct(F.lit(name).alias("kind"), F.col(c).alias("value")) for name, c in values.items())))
    counts = rows.select(key, weight, kinds.alias("x")).groupBy(key, "x.kind", "x.value").agg(F.sum(weight).alias("c"))
    best = lambda name: F.min(F.when(F.col("kind") == name, F.struct(-F.col("c"), F.col("value"))))["value"].alias(name)
    return counts.groupBy(key).agg(F.sum(F.when(F.col("kind") == next(iter(values)), F.col("c"))).alias("count"), *map(best, values))


def endpoint_catalogue(flows: DataFrame, wanted: DataFrame | None = None) -> DataFrame:
    """Every address with its traffic, its commonest service and protocol, and an alias that doesn't tell it.

    Aliases are numbered by traffic, then address, apart for private and other
    addresses.  Of a few addresses ``wanted (endpoint)`` alone the services are
    told, and no others are returned; their numbers are those among all.
    """
    # Services are told once for each combination, of which there are far fewer than flows.
    told = ["requested_server_name", "application_name", "protocol_family"]
    ends = flows.select(*told, F.explode(F.array("src_ip", "dst_ip")).alias("endpoint")).where(expr.is_present(F.col("endpoint")))
    ends = ends.withColumn("endpoint", F.trim("endpoint"))
    if wanted is not None:
        wanted = materialize(wanted.select("endpoint").distinct())
        traffic = materialize(ends.groupBy("endpoint").agg(F.count("*").alias("count")))
        ends = ends.join(F.broadcast(wanted), "endpoint", "left_semi")
    rows = materialize(with_services(ends.groupBy("endpoint", *told).agg(F.count("*").alias("n"))).drop(*told))
    out = most_common(rows, "endpoint", {"dominant_family": "service_family", "dominant_label": "service_name", "protocol_label": "protocol_label"}, "n")
    common = out
    if wanted is not None:
        out = traffic
    out = out.withColumn("is_private", F.coalesce(expr.is_private_address(F.col("endpoint")), F.lit(False)))
    keyed = out.withColumn("_o", F.struct(~F.col("is_private"), -F.col("count"), F.col("endpoint")))
    numbered = None
    for private in (True, False):
        one = dense_numbers(keyed.where(F.col("is_private") == private), ["_o"], "_n")
        if wanted is not None:
            one = one.join(F.broadcast(common.drop("count")), "endpoint")
        numbered = one if numbered is None else numbered.unionByName(one)
    return aliased(numbered).drop("_o", "_n")


def aliased(numbered: DataFrame) -> DataFrame:
    """Adds the names and the role of addresses by ``is_private`` and their number ``_n``."""
    two = lambda c: F.when(c < 100, F.lpad(c.cast("string"), 2, "0")).otherwise(c.cast("string"))
    greek = F.coalesce(F.get(F.array(*map(F.lit, GREEK)), F.col("_n").cast("int")), F.concat(F.lit("Node "), two(F.col("_n") + 1)))
    name = F.when(F.col("is_private"), F.concat(F.lit("Internal Gateway "), greek)).otherwise(F.concat(F.lit("External Node "), two(F.col("_n") + 1)))
    return numbered.withColumns({"display_name": name, "alias_id": expr.slug(name), "role": F.when(F.col("is_private"), "Internal hub").otherwise("External peer")})


def names_of(flows: DataFrame, wanted: DataFrame) -> DataFrame:
    """The catalogue's ``endpoint, display_name, alias_id, role`` of a few addresses ``wanted (endpoint)``.

    Their numbers are counts of the addresses before them, all made in one
    aggregate, so nothing is sorted or numbered for the others.
    """
    ends = flows.select(F.explode(F.array("src_ip", "dst_ip")).alias("endpoint")).where(expr.is_present(F.col("endpoint")))
    traffic = ends.groupBy(F.trim("endpoint").alias("endpoint")).agg(F.count("*").alias("count"))
    traffic = materialize(traffic.withColumn("is_private", F.coalesce(expr.is_private_address(F.col("endpoint")), F.lit(False))))
    mine = traffic.join(F.broadcast(wanted.select("endpoint").distinct()), "endpoint").collect()
    ahead = lambda r: (F.col("is_private") == r["is_private"]) & ((F.col("count") > r["count"]) | ((F.col("count") == r["count"]) & (F.col("endpoint") < r["endpoint"])))
    numbers = traffic.agg(*(F.count_if(ahead(r)) for r in mine)).first() if mine else ()
    known = [(r["endpoint"], r["is_private"], n) for r, n in zip(mine, numbers, strict=True)]
    return aliased(flows.sparkSession.createDataFrame(known, "endpoint string, is_private boolean, _n long")).drop("_n", "is_private")


def route_label(role: Column, display_name: Column, family: Column) -> Column:
    """How an endpoint is called in a path."""
    return F.when(role == "Internal hub", display_name).when(family == "QUIC Session", "QUIC Peer").otherwise(F.concat(F.coalesce(family, F.lit("Encrypted")), F.lit(" Peer")))


def group_distribution(flows: DataFrame, key: Column, member: Column, limit: int) -> DataFrame:
    """``name, count, share, subtitle``: the commonest keys with their three commonest members; shares are of all rows."""
    rows = flows.select(expr.clean_text(key).alias("name"), F.nullif(expr.clean_text(member), F.lit("")).alias("member"))
    total = F.lit(flows.count())
    groups = rows.where("name <> ''").groupBy("name").agg(F.count("*").alias("count")).orderBy(F.desc("count"), "name").limit(limit)
    tops = top_strings(rows.join(F.broadcast(groups.select("name")), "name", "left_semi"), ["name"], "member", 3, "members")
    return groups.join(tops, "name", "left").select("name", "count", rate("count", total).alias("share"), F.coalesce(F.array_join("members", " · "), F.lit("")).alias("subtitle"))


def top_distribution(rows: DataFrame, column: str, limit: int, total: int) -> DataFrame:
    """``name, count, share`` of the commonest values of a column against a given total."""
    text = F.trim(F.col(column).cast("string"))
    return rows.where(text != "").groupBy(text.alias("name")).agg(F.count("*").alias("count")).orderBy(F.desc("count"), "name").limit(limit).withColumn("share", rate("count", F.lit(total)))


def strongest(tiered: DataFrame, key: str, limit: int = 10) -> DataFrame:
    """The strongest flow of each window, pair of addresses and service; of these the first ``limit``."""
    a, b = expr.endpoints(F.col("src_ip"), F.col("dst_ip"))
    rows = with_services(tiered).withColumns({"_a": a, "_b": b})
    strength = [F.desc_nulls_last("tier2_consensus_score"), F.desc_nulls_last("bidirectional_packets"), F.asc(key)]
    first = rows.withColumn("_n", F.row_number().over(Window.partitionBy("window_id", "_a", "_b", "service_family").orderBy(*strength))).where("_n = 1")
    return first.orderBy(*strength).limit(limit)


def spotlight(tiered: DataFrame, catalogue: DataFrame | None, key: str, limit: int = 10, top: DataFrame | None = None) -> DataFrame:
    """The :func:`strongest` flows, which may be given as ``top``, with their paths.

    Without a catalogue only the addresses of the flows shown are named.
    """
    top = strongest(tiered, key, limit) if top is None else top
    if catalogue is None:
        top = materialize(top)
        catalogue = names_of(tiered, top.select(F.explode(F.array("src_ip", "dst_ip")).alias("endpoint")))
    for side in ("src", "dst"):
        named = catalogue.select(F.col("endpoint").alias(f"{side}_ip"), F.col("role").alias(f"{side}_role"), F.col("display_name").alias(f"{side}_name"))
        top = F.broadcast(top).join(named, f"{side}_ip", "left")
    path = F.concat(route_label(F.col("src_role"), F.col("src_name"), F.col("service_family")), F.lit(" -> "), route_label(F.col("dst_role"), F.col("dst_name"), F.col("service_family")))
    return top.select(key, expr.window_label(F.col("window_id")).alias("window_label"), "capture_id", F.col("service_name").alias("service"), path.alias("path"), F.concat(F.lit("Ports "), F.col("src_port").cast("string"), F.lit(" -> "), F.col("dst_port").cast("string")).alias("path_detail"), F.col("tier2_consensus_score").alias("score"), "alert_level", F.col("bidirectional_packets").alias("packets"))


def stage_funnel(tiered: DataFrame) -> DataFrame:
    """``stage, label, value, share`` of the three stages."""
    counted = tiered.agg(F.count("*").alias("t"), F.count_if("tier1_pass").alias("c"), F.count_if("tier2_pass").alias("s"))
    base = F.greatest("t", F.lit(1))
    step = lambda i, label, value: F.struct(F.lit(i).alias("stage"), F.lit(label).alias("label"), F.col(value).alias("value"), (F.col(value) / base).alias("share"))
    return counted.select(F.explode(F.array(step(1, "Ingested telemetry", "t"), step(2, "Escalation candidates", "c"), step(3, "Prioritized alerts", "s"))).alias("x")).select("x.*")


def decorated_endpoints(nodes: DataFrame, catalogue: DataFrame, limit: int = 8) -> DataFrame:
    """The busiest endpoints under their aliases."""
    top = F.broadcast(top_endpoints(nodes, limit))
    joined = top.join(catalogue.select("endpoint", "display_name", "role", "dominant_family"), "endpoint", "left")
    return joined.select(F.coalesce("display_name", F.lit("Unlisted Node")).alias("endpoint"), "cluster_id", F.coalesce("role", F.lit("External peer")).alias("role"), F.coalesce("dominant_family", F.lit("")).alias("service_label"), "suspicious_flow_count", "unique_neighbors", F.round("risk_mass", 2).alias("risk_mass"))


def kpi_strip(tiered: DataFrame) -> DataFrame:
    """``name, value`` of the headline figures."""
    counted = tiered.agg(F.count("*").alias("flows"), F.count_if("tier1_pass").alias("candidates"), F.count_if("tier2_pass").alias("alerts"), F.count_if(F.col("alert_level") == "high").alias("high_alerts"), F.count_distinct("capture_id").alias("captures"), F.count_distinct("window_id").alias("windows"))
    return counted.select(F.explode(F.array(*(F.struct(F.lit(c).alias("name"), F.col(c).alias("value")) for c in counted.columns))).alias("x")).select("x.*")


def ranked_models(comparison: DataFrame) -> DataFrame:
    """Models by their optimised F1, with shown names; a handful of rows."""
    order = Window.orderBy(F.desc_nulls_last("test_optimized_f1"), "model")
    return comparison.withColumns({"rank": F.row_number().over(order), "display_name": expr.map_values(F.col("model"), MODEL_NAMES)}).withColumn("summary_note", F.when(F.col("rank") == 1, "Primary scoring model").otherwise("Supporting evidence model"))


def job_status(jobs: DataFrame, status: str, batch: str | None = None) -> DataFrame:
    """Jobs by status, of all or of each batch."""
    return jobs.groupBy(*([F.col(batch).alias("batch_id")] if batch else []), F.col(status).alias("status")).agg(F.count("*").alias("jobs"))


def recent_jobs(jobs: DataFrame, created: str, key: str, limit: int) -> DataFrame:
    return jobs.orderBy(F.desc_nulls_last(created), F.desc(key)).limit(limit)


def platform_counts(jobs: DataFrame, batch: str) -> DataFrame:
    return jobs.agg(F.count("*").alias("job_count"), F.count_distinct(batch).alias("batch_count"))


def class_risks(table: DataFrame, label: str = "label", capture: str = "capture_id", imbalance: float = 1.5) -> list[str]:
    """Warnings about a training table: failed sources, classes from one capture, unequal classes."""
    per = {r[label]: r for r in table.groupBy(label).agg(F.count("*").alias("n"), F.count_distinct(capture).alias("captures")).collect()}
    out = []
    if "quality_status" in table.columns and not table.where("quality_status = 'fail'").isEmpty():
        out.append("some rows come from a source that failed its quality gates")
    if any(r["captures"] < 2 for r in per.values()):
        out.append("a class comes from fewer than two captures, so row splits overestimate generalization")
    sizes = [r["n"] for r in per.values()]
    if sizes and max(sizes) / max(min(sizes), 1) > imbalance:
        out.append("classes are unequal, so thresholds and precision-recall figures tell more than accuracy")
    return out


def snapshot(parts: Mapping[str, DataFrame]) -> DataFrame:
    """One row of JSON with each part as a list, for parts of bounded size; :func:`snapshot_rows` takes any."""
    out = None
    for name, part in parts.items():
        one = part.agg(F.to_json(F.collect_list(F.struct(*(F.col(c) for c in part.columns)))).alias("j")).select(F.lit(name).alias("name"), "j")
        out = one if out is None else out.union(one)
    pair = F.concat(F.to_json(F.array("name")).substr(F.lit(2), F.length(F.to_json(F.array("name"))) - 2), F.lit(":"), F.col("j"))
    return out.agg(F.concat(F.lit("{"), F.array_join(F.array_sort(F.collect_list(pair)), ","), F.lit("}")).alias("value"))


#: The order of each part's rows; a minus stands for descending.  Parts of figures alone have one row or are ordered by name.
PART_ORDER = {
    "kpis": ("name",),
    "trend": ("window_start_ms", "window_id"),
    "timeline": ("window_start_ms", "window_id"),
    "endpoints": ("-suspicious_flow_count", "-unique_neighbors", "endpoint"),
    "graph_nodes": ("-suspicious_flow_count", "-unique_neighbors", "id"),
    "graph_edges": ("-weight", "source", "target"),
}


def snapshot_rows(parts: Mapping[str, DataFrame]) -> DataFrame:
    """``part, place, value``: each row of each report table as JSON, with its place in the table's order.

    Parts may have any size: they are numbered by ranges of their order, and no
    task gathers one.  Rows that agree in all columns of ``PART_ORDER`` go by
    their JSON, as do those of parts that it doesn't name.
    """
    out = None
    for name, part in parts.items():
        order = PART_ORDER.get(name, ())
        keys = {}
        for i, c in enumerate(order):
            # Nulls last, whichever way.
            keys |= {f"_n{i}": F.col(c.lstrip("-")).isNull(), f"_o{i}": -F.col(c[1:]) if c.startswith("-") else F.col(c)}
        rows = part.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("value"), *(c.alias(k) for k, c in keys.items()))
        rows = dense_numbers(rows, [*keys, "value"], "place").select(F.lit(name).alias("part"), "place", "value")
        out = rows if out is None else out.union(rows)
    return out


def write_snapshot(parts: Mapping[str, DataFrame], path: str) -> None:
    """A folder for each part with its rows as JSON lines; its files in order of their names hold the rows in their order."""
    rows = materialize(snapshot_rows(parts))
    dealt = rows.repartitionByRange("part", "place").sortWithinPartitions("part", "place")
    dealt.select("part", "value").write.mode("overwrite").partitionBy("part").text(path)
    drop_table(rows)
