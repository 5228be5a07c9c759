"""Operators on small tables with known results."""

import hashlib
import hmac
import json
import random
import re

import pytest
from pyspark.ml import Pipeline
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import functions as F

from cipherlake.functions import expr
from cipherlake.operators import asof, canonical, detect, features, gates, graph, links, metrics, report, train
from cipherlake.operators.components import connected_components
from cipherlake.operators.ranking import sums_before
from cipherlake.plans import catalog
from cipherlake.plans.scratch import materialize


def rows(df, *order):
    return [tuple(r) for r in df.orderBy(*order).collect()]


def test_protocol_family_precedence(spark):
    df = spark.createDataFrame([(1, "TLS.Google", None, None), (2, "quic.YouTube", "TLSv1", None), (3, "HTTP", "", ""), (4, "HTTP", "TLSv13", "x"), (5, None, None, "abc")], "id int, application_name string, version string, client_scid string")
    assert [r[0] for r in df.orderBy("id").select(expr.protocol_family(df.columns)).collect()] == ["tls", "quic", "other", "tls", "quic"]


def test_presence_and_masks(spark):
    df = spark.createDataFrame([(1, " nan ", None), (2, "v", None), (3, None, "c")], "id int, version string, client_scid string")
    got = features.with_masks(df).withColumn("signal", expr.encrypted_signal(df.columns)).orderBy("id").select("is_tls", "is_quic", "signal").collect()
    assert [tuple(r) for r in got] == [(True, False, False), (True, False, True), (False, True, True)]


def test_private_addresses_agree_with_the_registry(spark):
    addresses = ["10.1.2.3", "8.8.8.8", "172.16.0.1", "172.32.0.1", "192.168.1.1", "127.0.0.1", "169.254.3.4", "192.0.2.9", "198.18.1.1", "203.0.113.7", "240.0.0.1", "0.0.0.0", "1.2.3", "a.b.c.d", "256.1.1.1", "45.12.7.3", None]
    df = spark.createDataFrame([(a,) for a in addresses], "a string")
    got = df.select(expr.is_private_v4(F.col("a")).alias("native"), expr.is_private(F.col("a")).alias("registry")).collect()
    assert [r["native"] for r in got] == [r["registry"] for r in got]
    texts = "::1 :: fe80::1 fd00::1 fc00:1::2 2001:db8::1 2001:4860:4860::8888 2a00:1450::5 2002:1::1 2001::1 2001:20::1 2001:3::1 2001:1ff::1 2001:200::1 64:ff9b:1::1 64:ff9b::1 100::1 3ffe::1 ::ffff:10.0.0.1 ::ffff:8.8.8.8 ff02::1 1.2.3.4 10.0.0.1 12:30 x a::b::c 2600::".split()
    texts += "0:0:0:0:0:0:0:1 0:0:0:0:0:0:0:0 0000:0000:0000:0000:0000:0000:0000:0001 0::1 ::0 0:0::1 ::0:2 0:0:0:0:0:0:1:1 2001:0db8:0000::1 2001:0DB8:0:0:0:0:0:1 fd00:0:0:0:0:0:0:1 0100:0:0:0:0:0:0:9 100:0:0:1::9 0064:ff9b:0001::1 2001:0:1:2:3:4:5:6 2001:0000::1 2a00:0:0:0:0:0:0:1 0:0:0:0:0:ffff:10.0.0.1 0:0:0:0:0:ffff:8.8.8.8 1::1 0:1::1".split()
    both = spark.createDataFrame([(x,) for x in texts], "a string").select("a", expr.is_private_address(F.col("a")).alias("native"), expr.is_private("a").alias("registry")).collect()
    assert all(r["native"] == r["registry"] for r in both)
    names = spark.createDataFrame([("s3media",), ("foo_bar",), ("web2print",), ("a-b",)], "a string").select(expr.title_case(F.col("a"))).collect()
    assert [r[0] for r in names] == ["S3Media", "Foo_Bar", "Web2Print", "A-B"]
    six = spark.createDataFrame([("fe80::1",), ("2606:4700::1",)], "a string").select(expr.is_private("a")).collect()
    assert [r[0] for r in six] == [True, False]


def test_services_and_labels(spark):
    df = spark.createDataFrame([("mail.google.com", "TLS"), ("www.my-shop.co", None), ("", "TLS.Some_App"), (None, "QUIC"), (None, None)], "d string, a string")
    got = df.select(expr.service_family(F.col("d"), F.col("a")), expr.display_service(F.col("d"), F.col("a"))).collect()
    assert [tuple(r) for r in got] == [("Google", "Google Mail"), ("My-Shop", "www.my-shop.co"), ("Some App", "Some App"), ("QUIC Session", "QUIC Session"), ("Encrypted Session", "Encrypted Session")]
    windows = spark.createDataFrame([("botnet_1:w000004",), ("lab:w000000",), ("x:wunknown",), ("",)], "w string")
    assert [r[0] for r in windows.select(expr.window_label(F.col("w"))).collect()] == ["Campaign 05", "Baseline 01", "Segment 01", "Window"]
    names = spark.createDataFrame([("a_quality_report.json",), ("b.json",), ("c.PCAPNG",), ("d",)], "p string")
    assert [r[0] for r in names.select(expr.artifact_type(F.col("p"))).collect()] == ["quality_report", "json", "pcap", "artifact"]


def test_weighted_mean_and_levels(spark):
    df = spark.createDataFrame([(0.2, 0.6), (0.8, 0.4)], "rf double, gb double")
    assert [round(r[0], 6) for r in df.select(expr.weighted_mean([F.col("rf"), F.col("gb")], [1, 3])).collect()] == [0.5, 0.5]
    with pytest.raises(ValueError):
        expr.weighted_mean([F.col("rf")], [0])
    flags = spark.createDataFrame([(1, True, True, 2, 0.95), (2, True, False, 0, 0.1), (3, False, False, 0, None)], "id int, a boolean, b boolean, n int, c double")
    got = flags.orderBy("id").select(expr.alert_level(F.col("a"), F.col("b"), F.col("n"), 2, F.col("c"))).collect()
    assert [r[0] for r in got] == ["high", "candidate", "none"]


def test_asof_matches_brute_force(spark):
    rng = random.Random(7)
    left = [(i, rng.choice("abc"), rng.randrange(0, 3000)) for i in range(300)] + [(900, None, 5), (901, "a", None)]
    right = [(1000 + i, rng.choice("abc"), rng.randrange(0, 300) * 10) for i in range(300)] + [(1999, "a", None)]
    got = dict(
        (r["lid"], r["rid"])
        for r in asof.asof_nearest(spark.createDataFrame(left, "lid long, k string, t long"), spark.createDataFrame(right, "rid long, k string, rt long"), ["k"], "t", "rt", "lid", "rid", 40, bucket=100).collect()
    )
    for lid, k, t in left:
        best = None
        if k is not None and t is not None:
            near = [(abs(rt - t), rt, rid) for rid, rk, rt in right if rk == k and rt is not None and abs(rt - t) <= 40]
            if near:
                d, rt, _ = min(near)
                same = [rid for dd, rr, rid in near if rr == rt]
                best = max(same) if rt <= t else min(same)
        assert got[lid] == best, lid


def test_asof_keeps_rows_that_share_an_id(spark):
    """Repeated and missing ids, times and keys: every row stays once, with its own match; the left table is exchanged once."""
    rng = random.Random(17)
    left = [(rng.choice([None, 1, 2, 3]), rng.choice(["a", "b", None]), rng.choice([None, *range(0, 500, 7)]), i) for i in range(200)]
    right = [(i, rng.choice("ab"), rng.randrange(0, 500)) for i in range(60)]
    l_rows, r_rows = spark.createDataFrame(left, "lid long, k string, t long, rid0 long"), spark.createDataFrame(right, "rid long, k string, rt long")
    made = asof.asof_nearest(l_rows, r_rows, ["k"], "t", "rt", "lid", "rid", 6)
    assert made.columns == ["lid", "k", "t", "rid0", "rid", "rt"]
    got = {r["rid0"]: (r["lid"], r["rid"], r["rt"]) for r in made.collect()}
    assert made.count() == len(left) == len(got)
    for lid, k, t, own in left:
        near = [(abs(rt - t), rt, rid) for rid, rk, rt in right if rk == k and abs(rt - t) <= 6] if t is not None else []
        best = min(near)[1] if near else None
        same = [rid for _, rt, rid in near if rt == best]
        assert got[own] == (lid, (max(same) if best <= t else min(same)) if near else None, best)
    plan = made._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[-1]
    assert plan.count("Exchange") == plan.count("Sort [") == 1 and "Join" not in plan


@pytest.mark.parametrize("finish", [0, 50_000])
def test_medians(spark, monkeypatch, finish):
    """Ties, nulls, even and odd numbers, infinities, NaN and very large and small numbers, narrowed or counted at once."""
    monkeypatch.setattr(train, "FINISH", finish)
    rng = random.Random(3)
    inf, nan = float("inf"), float("nan")
    for n in (1, 2, 7, 400):
        columns = {
            "ties": [rng.choice([None, 1.0, 2.0, 3.0]) for _ in range(n)],
            "wide": [rng.gauss(0, 1) * 10.0 ** rng.randrange(-300, 300) for _ in range(n)],
            "odd": [rng.choice([inf, -inf, nan, 1e308, -1e308, 5e-324, 0.0]) for _ in range(n)],
            "none": [None] * n,
            "even": [float(i) for i in range(n)],
        }
        df = spark.createDataFrame(list(zip(*columns.values(), strict=True)), ", ".join(f"{c} double" for c in columns)).repartition(3)
        got = train.medians(df, list(columns))
        for c, values in columns.items():
            known = sorted((v for v in values if v is not None), key=lambda v: (v != v, v))
            want = known[(len(known) - 1) // 2] / 2 + known[len(known) // 2] / 2 if known else 0.0
            assert got[c] == pytest.approx(want, rel=1e-15, nan_ok=True), (n, c)


def test_log_joins(spark):
    certs = spark.createDataFrame([("u", "2048", "CN=a"), ("u", "n/a", None), (None, "1", "x")], "uid string, key_length string, subject string")
    made = asof.certificate_features(certs).first()
    assert (made["x509_key_length__num_mean"], made["x509_key_length__len_max"], made["x509_x509_record_count"]) == (2048.0, 4.0, 2)
    flows = spark.createDataFrame([(1, "u", "f"), (2, None, "g")], "id int, uid string, subject string")
    got = asof.enrich(flows, ssl=certs.select("key_length", "subject", "uid"))
    assert got.columns == ["uid", "id", "subject", "key_length", "subject_zeek_ssl"]
    assert got.count() == 2
    with pytest.raises(ValueError):
        asof.require(flows, ["missing"])


def test_gates(spark):
    key = ("10.0.0.1", "8.8.8.8", 1, 443, 6, 5)
    flows = spark.createDataFrame([key, key], ",".join(f"{c} {t}" for c, t in zip(gates.FLOW_KEY, ("string", "string", "int", "int", "int", "long"), strict=True)))
    report_ = gates.Report("d", [gates.gate_duplicates(flows), gates.gate_logs(["conn", "tls"])])
    assert [o.status for o in report_.outcomes] == ["fail", "pass"] and report_.failed
    with pytest.raises(gates.GateFailure, match="duplicate_flows"):
        report_.raise_if_failed()
    assert report_.frame(spark).count() == 2
    merged = spark.createDataFrame([("u1", "TLSv13", None), ("", "", "")], "uid string, version string, client_scid string")
    out = gates.gate_merged(merged)
    assert out.status == "fail" and out.metrics["match_rate"] == 0.5 and "not_encrypted_rate" in out.message
    assert gates.gate_merged(merged.limit(0)).status == "fail"
    assert gates.gate_duplicates(flows.drop("protocol")).status == "fail"
    assert gates.gate_logs(["ssl"]).status == "fail"
    assert gates.gate_duplicates(flows.limit(0)).status == "pass"


def test_canonical_windows_and_ids(spark):
    flows = spark.createDataFrame([("TLS", 1000, 2000, 1), ("HTTP", 2000, 2500, 2), ("QUIC", 61500, 62000, 3)], "application_name string, bidirectional_first_seen_ms long, bidirectional_last_seen_ms long, bidirectional_packets long")
    source = canonical.Source("s", "ds", "cap", "malicious", quality_failed=True, extra_labels={"environment": "lab"})
    got = canonical.canonical_union([(flows, source)], ["bidirectional_first_seen_ms"]).orderBy("source_row_index").collect()
    assert [r["window_id"] for r in got] == ["cap:w000000", "cap:w000001"]
    assert [r["window_start_ms"] for r in got] == [1000, 61000] and got[0]["window_end_ms"] == 60999
    assert [r["source_row_index"] for r in got] == [0, 1] and got[0]["quality_status"] == "fail" and got[0]["environment"] == "lab"
    import hashlib

    assert got[0]["record_id"] == hashlib.sha256(b"ds|cap|flow|0").hexdigest()
    assert list(got[0].asDict())[:24] == list(canonical.METADATA)
    with pytest.raises(ValueError):
        canonical.canonical_source(flows, canonical.Source("s", "d", "c", "odd"), ["bidirectional_first_seen_ms"])
    with pytest.raises(ValueError):
        canonical.canonical_source(flows, canonical.Source("s", "d", "c", "benign", extra_labels={"label": "x"}), ["bidirectional_first_seen_ms"])
    nulls = spark.createDataFrame([("a", None), ("b", 5), ("b", None)], "capture_id string, t long")
    assert sorted(r["window_id"] for r in canonical.anchored_windows(nulls, "t", 10, ["capture_id"]).collect()) == ["a:w000000", "b:w000000", "b:wunknown"]


def test_row_index_is_dense_over_ranges(spark):
    df = spark.range(1000).select((F.col("id") * 7 % 1000).alias("x"))
    got = {r["x"]: r["source_row_index"] for r in canonical.row_index(df, ["x"]).collect()}
    assert got == {i: i for i in range(1000)}
    # Ties and nulls in the first column are told apart by the second.
    tied = spark.range(600).select(F.when(F.col("id") >= 200, F.lit(5)).alias("t"), "id")
    got = {r["id"]: r["source_row_index"] for r in canonical.row_index(tied.repartition(7), ["t", "id"]).collect()}
    assert got == {i: i for i in range(600)}


def test_running_sums_over_ranges(spark):
    df = spark.range(500).select((F.col("id") * 7 % 500).alias("x"), F.lit(2).alias("n"))
    assert {r["x"]: r["s"] for r in sums_before(df, "x", {"s": "n"}).collect()} == {i: 2 * i for i in range(500)}
    assert {r["x"]: r["s"] for r in sums_before(df, F.desc("x"), {"s": "n"}).collect()} == {i: 2 * (499 - i) for i in range(500)}
    assert sums_before(df.limit(0), "x", {"s": "n"}).count() == 0


def test_class_ranks_leave_out_rows_without_a_class(spark):
    df = spark.range(300).select("id", F.when(F.col("id") < 290, F.col("id") % 3).alias("y"))
    got = train.class_ranks(df, "y", "id", 1).collect()
    assert len(got) == 290 and {(r["y"], r["_size"]) for r in got} == {(0, 97), (1, 97), (2, 96)}
    assert all(sorted(r["_rank"] for r in got if r["y"] == y) == list(range(n)) for y, n in ((0, 97), (1, 97), (2, 96)))


def test_features_and_roles(spark):
    df = spark.createDataFrame([("r", 1, 5, 1.0, 3, "10.0.0.1", float("nan"))], "record_id string, label_id int, flow_start_ms long, duration double, packets int, src_ip string, odd double")
    names, reasons = features.column_roles(df, "label_id")
    assert names == ["duration", "packets", "odd"]
    assert reasons == {"record_id": "metadata", "label_id": "target_column", "flow_start_ms": "metadata", "src_ip": "non_numeric"}
    assert features.ml_ready(df).first().asDict() == {"label_id": 1, "flow_start_ms": 5, "duration": 1.0, "packets": 3, "odd": 0.0}
    assert features.align(df, ["packets", "gone"]).first().asDict() == {"packets": 3.0, "gone": None}
    wide = spark.range(1000).select(F.lit("x").alias("c"), F.when(F.col("id") == 0, 1).otherwise(0).alias("n"), F.col("id").alias("a"), (F.col("id") * 2).alias("b"), F.rand(1).alias("z"))
    kept, dropped = features.prune(wide)
    assert kept.columns == ["a", "z"] and dropped == {"constant": ["c"], "near_constant": ["n"], "correlated": ["b"]}


def test_thresholds_and_metrics(spark):
    df = spark.createDataFrame([(0, 0.1), (0, 0.4), (1, 0.6), (1, 0.9)], "y int, s double")
    sweep = metrics.threshold_sweep(df, "y", "s", 10)
    best = metrics.best_threshold(sweep).first()
    assert round(best["threshold"], 6) == 0.5 and best["f1"] == 1.0
    got = metrics.ranking_metrics(df, "y", "s").first()
    assert (got["roc_auc"], got["average_precision"]) == (1.0, 1.0)
    tied = spark.createDataFrame([(0, 0.5), (1, 0.5)], "y int, s double")
    assert metrics.ranking_metrics(tied, "y", "s").first()["roc_auc"] == 0.5
    empty = metrics.binary_metrics(df.limit(0), "y", F.col("s") > 1).first()
    assert empty["f1"] == 0.0 and empty["tp"] == 0


def components(pairs):
    up = {}

    def root(x):
        up.setdefault(x, x)
        while up[x] != x:
            x = up[x]
        return x

    for a, b in pairs:
        a, b = root(a), root(b)
        up[max(a, b)] = min(a, b)
    return {x: root(x) for x in list(up)}


@pytest.mark.parametrize("finish", [0, 50_000])
def test_components(spark, monkeypatch, finish):
    from cipherlake.operators import components as module

    monkeypatch.setattr(module, "FINISH", finish)
    rng = random.Random(3)
    chain = [(i, i + 1) for i in range(100, 160)]
    star = [(500, i) for i in range(501, 560)]
    some = [(rng.randrange(1000, 1100), rng.randrange(1000, 1100)) for _ in range(60)]
    pairs = [*chain, *star, *some, (7, 7)]
    df = spark.createDataFrame([*pairs, (None, 3), (3, None)], "src long, dst long")
    assert dict(rows(connected_components(df), "node")) == components(pairs)
    assert connected_components(df.limit(0)).count() == 0
    named = spark.createDataFrame([("b", "a"), ("c", "b"), ("x", "y")], "src string, dst string")
    assert dict(rows(connected_components(named), "node")) == {"a": "a", "b": "a", "c": "a", "x": "x", "y": "x"}


def scored(spark):
    data = [(1, "10.0.0.1", "8.8.8.8", True, 0.9, 0.95, "h.evil.example"), (2, "10.0.0.1", "9.9.9.9", True, 0.9, 0.2, None), (3, "10.0.0.2", "7.7.7.7", False, None, None, ""), (4, "10.0.0.3", "6.6.6.6", True, 0.6, 0.7, "a.b")]
    df = spark.createDataFrame(data, "event_id int, src_ip string, dst_ip string, tier1_pass boolean, random_forest_probability double, gradient_boosting_probability double, requested_server_name string")
    return df.withColumns({"tier1_probability": F.lit(0.5), "protocol_family": F.lit("tls"), "application_name": F.lit("TLS"), "capture_id": F.lit("c"), "window_id": F.lit("c:w000000"), "window_start_ms": F.lit(0), "label_id": F.col("event_id") % 2, "src_port": F.lit(1), "dst_port": F.lit(2), "bidirectional_packets": F.lit(3)})


def test_tiers(spark):
    out = detect.apply_rules(scored(spark)).orderBy("event_id").collect()
    assert [r["alert_level"] for r in out] == ["high", "medium", "none", "medium"]
    assert [r["tier2_pass_count"] for r in out] == [2, 1, 0, 2]
    none = detect.apply_rules(scored(spark), detect.Rules(thresholds={})).orderBy("event_id").collect()
    assert [r["alert_level"] for r in none] == ["medium", "medium", "none", "medium"]
    seen = []

    def deep(df):
        seen.append(df.count())
        return df.withColumn("probability", F.lit(0.9))

    base = scored(spark).drop("tier1_pass", "tier1_probability", "random_forest_probability", "gradient_boosting_probability")
    tiers = detect.score_tiers(base, lambda d: d.withColumn("probability", (F.col("event_id") > 2).cast("double")), 0.5, {"random_forest": deep}, detect.Rules(thresholds={"random_forest": 0.5}))
    assert seen == [2] and tiers.where("tier2_pass").count() == 2 and tiers.count() == 4


def test_graph(spark):
    tables = graph.build(detect.suspicious(detect.apply_rules(scored(spark))))
    assert {r["cluster_id"]: r["suspicious_flow_count"] for r in tables["clusters"].collect()} == {"cluster_0000": 2, "cluster_0001": 1}
    hub = tables["nodes"].where("endpoint = '10.0.0.1'").first()
    assert (hub["edge_count"], hub["unique_neighbors"], hub["is_private"]) == (2, 2, True)
    shown = graph.view(tables)
    assert shown["edges"].count() == 2
    assert graph.view(tables, most=1)["edges"].count() == 2
    catalogue = report.endpoint_catalogue(scored(spark))
    made = graph.decorate(shown["nodes"], shown["edges"], catalogue)
    text = "".join(made["nodes"].toJSON().collect() + made["edges"].toJSON().collect())
    assert "10.0.0." not in text and "8.8.8.8" not in text
    # Without a catalogue neither an address nor its plain hash is told.
    hidden = graph.decorate(shown["nodes"], shown["edges"], catalogue.limit(0), key=b"k" * 100)
    told = "".join(hidden["nodes"].toJSON().collect() + hidden["edges"].toJSON().collect())
    for address in [r["endpoint"] for r in shown["nodes"].collect()]:
        assert address not in told and hashlib.sha256(address.encode()).hexdigest() not in told
        assert hmac.new(b"k" * 100, address.encode(), "sha256").hexdigest() in told
    drawn = [graph.decorate(shown["nodes"], shown["edges"], catalogue.limit(0))["nodes"].select("id").collect() for _ in range(2)]
    assert not set(drawn[0]) & set(drawn[1])
    empty = graph.build(detect.suspicious(detect.apply_rules(scored(spark))).limit(0))
    assert all(t.count() == 0 for t in empty.values())
    few = graph.build(detect.suspicious(detect.apply_rules(scored(spark))), least=2)
    assert few["clusters"].first()["cluster_id"] is None


def test_reports(spark):
    tiers = detect.apply_rules(scored(spark))
    assert report.overview(tiers).first()["suspicious_flows"] == 3
    total, page = report.flow_explorer(tiers, "event_id", search="h.evil", only_suspicious=True, limit=1)
    assert total.first()[0] == 1 and page.count() == 1
    assert report.spotlight(tiers, report.endpoint_catalogue(tiers), "event_id").count() == 4
    text = report.snapshot({"kpis": report.kpi_strip(tiers), "funnel": report.stage_funnel(tiers)}).first()[0]
    import json

    assert {k for k in json.loads(text)} == {"kpis", "funnel"}
    rows = report.snapshot_rows({"kpis": report.kpi_strip(tiers), "timeline": report.alert_timeline(tiers)}).collect()
    kpis = {r["place"]: json.loads(r["value"])["name"] for r in rows if r["part"] == "kpis"}
    assert [kpis[i] for i in range(len(kpis))] == sorted(kpis.values()) and len(kpis) == 6
    named = report.names_of(tiers, tiers.select(F.col("src_ip").alias("endpoint")).union(spark.createDataFrame([("10.99.99.99",)], "endpoint string")))
    full = report.endpoint_catalogue(tiers).select(*named.columns)
    assert set(named.collect()) == set(full.join(tiers, F.col("endpoint") == F.col("src_ip"), "left_semi").collect()) and named.count() > 0
    assert report.names_of(tiers, tiers.select(F.lit("x").alias("endpoint"))).count() == 0
    labelled = tiers.withColumn("label", F.when(F.col("event_id") == 1, "benign").otherwise("malicious"))
    assert len(report.class_risks(labelled)) == 2
    models = spark.createDataFrame([("gaussian_nb", 0.7), ("random_forest", 0.9)], "model string, test_optimized_f1 double")
    assert [r["display_name"] for r in report.ranked_models(models).orderBy("rank").collect()] == ["Random Forest", "Gaussian Naive Bayes"]


def test_links(spark):
    pages = spark.createDataFrame([("http://h/d/", '<a href="x.pcap">x</a> <a class="c" href="/top/y.PCAP.gz?q=1">y</a> <a href="../">up</a> <a href="#a">a</a> <a href="sub/">s</a>'), ("http://h/d/sub/", '<a href="z%20z.cap">z</a>')], "url string, html string").withColumn("page_id", F.monotonically_increasing_id())
    found = links.page_links(pages)
    assert [r["link"] for r in found.orderBy("link").collect()] == ["http://h/d/sub/", "http://h/d/sub/z%20z.cap", "http://h/d/x.pcap", "http://h/top/y.PCAP.gz?q=1"]
    assert rows(links.capture_links(found, "http://h/d/"), "link") == [("http://h/d/sub/z%20z.cap", "sub/z z.cap"), ("http://h/d/x.pcap", "x.pcap")]
    start = pages.select("url").limit(1)
    assert links.reachable(found, start).count() == 5
    files = spark.createDataFrame([("a", 5), ("b", 5), ("c", 5)], "f string, n long")
    assert [r["f"] for r in links.byte_budget(files, "n", "f", 8).orderBy("f").collect()] == ["a", "b"]
    manifest = spark.createDataFrame([("http://h/1", "d/x.pcap", "/data/x.pcap", 0), ("http://h/2", "e/x.pcap", "/other/x.pcap", 1)], "url string, rel_path string, local_path string, row int")
    captures = spark.createDataFrame([("/tmp/x.pcap",), ("/none",)], "path string")
    assert rows(links.manifest_match(captures, manifest).select("path", "url"), "path") == [("/none", None), ("/tmp/x.pcap", "http://h/1")]
    dated = spark.createDataFrame([("2020-01-02 from https://other/x see https://h/b/ and\n2019-05-05 x https://h/a",)], "text string")
    assert rows(links.dated_datasets(dated, "https://h/"), "date") == [("2019-05-05", "https://h/a/"), ("2020-01-02", "https://h/b/")]


def test_training_round_trip(spark, tmp_path):
    rng = random.Random(5)
    data = [(i, i % 2, (i % 2) * 2 + rng.random(), rng.random(), None if i % 9 == 0 else 1.0 * (i % 3)) for i in range(240)]
    df = spark.createDataFrame(data, "id long, y int, a double, b double, c double").withColumn("k", F.lit(1.0))
    split = train.stratified_split(df, "y", "id")
    assert {tuple(r) for r in split.groupBy("split", "y").count().collect()} == {("train", 0, 96), ("train", 1, 96), ("test", 0, 24), ("test", 1, 24)}
    models = {k: v for k, v in train.estimators(trees=5, rounds=3).items() if k != "random_forest"}
    out = train.run(df, "y", "id", ["a", "b", "c", "k"], str(tmp_path), models).collect()
    assert len(out) == 2 and all(r["test_optimized_f1"] > 0.9 for r in out)
    score, threshold = train.load(spark, str(tmp_path), "gaussian_nb")
    got = score(df.drop("b"))
    assert got.count() == 240 and "probability" in got.columns and 0 <= threshold <= 1
    values = train.medians(df, ["a", "b", "c"])
    model = train.fit(train.impute(df, values), "y", ["a", "b", "c"], train.estimators()["gaussian_nb"]())
    importance = {r["feature"]: r["importance_mean"] for r in train.permutation_importance(model, train.impute(df, values), "y", "id", ["a", "b", "c"], 2).collect()}
    assert importance["a"] > importance["b"]


def crawl(listed, base, include=None, exclude=None, max_pages=None):
    """A crawl with a queue, as the frontier stands for."""
    queue, visited, depth = [base], {}, {base: 0}
    while queue:
        page = queue.pop(0)
        if page in visited:
            continue
        if max_pages is not None and len(visited) >= max_pages:
            break
        visited[page] = (depth[page], len(visited))
        for _, to in sorted(listed.get(page, [])):
            top = to[len(base) :].split("/")[0] if to.startswith(base) else ""
            if not to.startswith(base) or not to.endswith("/") or (top and ((include and not re.search(include, top)) or (exclude and re.search(exclude, top)))):
                continue
            depth.setdefault(to, depth[page] + 1)
            queue.append(to)
    return visited


@pytest.mark.parametrize("filters", [{}, {"max_pages": 7}, {"max_pages": 1}, {"exclude": "^b"}, {"include": "^[ab]", "max_pages": 12}])
def test_frontier_visits_in_the_order_of_a_queue(spark, filters):
    rng = random.Random(5)
    base = "http://h.example/x/"
    folders = [base, *(f"{base}{rng.choice('abc')}{i}/" for i in range(40)), *(f"{base}a1/deep{i}/" for i in range(5))]
    rows = []
    for page in folders[:-3]:
        for pos in range(rng.randrange(0, 4)):
            rows.append((page, pos, rng.choice([*folders, base + "a1/f.pcap", "http://other.example/x/", "http://h.example/up/"])))
    rows += [(f"{base}a1/", 9, base + "a1/f.pcap"), (base, 10, folders[1]), (base, 11, folders[2]), (None, 1, base), (base, 12, None)]
    rows += rows[:2]
    listed = {}
    for page, pos, to in rows:
        if to is not None:
            listed.setdefault(page, []).append((pos, to))
    table = spark.createDataFrame(rows, "page_url string, pos long, link string")
    made = links.frontier(table, base, **filters)
    assert {r["url"]: (r["depth"], r["place"]) for r in made.collect()} == crawl(listed, base, **filters)
    assert made.count() <= filters.get("max_pages", 1000)


def test_scope_of_links(spark):
    base = "http://h.example/x/"
    rows = [(base + p,) for p in ("a/", "b/c/", "a/f.pcap", "f.cap?x=1", "", "a%20b/")] + [("http://h.example/y/",), (base + "d/" + "z" * 1_100_000 + ".pcap",)]
    df = spark.createDataFrame(rows, "link string")
    path = lambda made: {r["rel_path"] for r in made.collect() if len(r["rel_path"]) < 100}
    assert path(links.in_scope(df, base)) == {"a/", "b/c/", "a/f.pcap", "f.cap", "", "a b/"}
    assert path(links.in_scope(df, base, include="^a$")) == {"a/", "a/f.pcap", "f.cap", ""}
    assert path(links.in_scope(df, base, exclude="^a$")) == {"b/c/", "a/f.pcap", "f.cap", "", "a b/"}
    long = [r["rel_path"] for r in links.capture_links(df, base).collect() if len(r["rel_path"]) > 100]
    assert [len(x) for x in long] == [1_100_007]


def test_written_snapshot_keeps_its_order(spark, tmp_path):
    """Many windows over many files: the lines of a part's files, by their names, are in order."""
    rng = random.Random(2)
    windows = [(None if i % 50 == 0 else rng.randrange(2000), f"w{i:05}", i) for i in range(3000)]
    df = spark.createDataFrame(windows, "window_start_ms long, window_id string, n long").repartition(7)
    report.write_snapshot({"trend": df, "notes": df.limit(1).select("n")}, str(tmp_path / "s"))
    lines = [json.loads(x) for f in sorted((tmp_path / "s/part=trend").glob("*.txt")) for x in f.read_text().splitlines()]
    assert [(x["window_start_ms"], x["window_id"]) for x in lines] == sorted(((t, w) for t, w, _ in windows), key=lambda k: (k[0] is None, k[0] or 0, k[1]))
    assert len(list((tmp_path / "s/part=notes").glob("*.txt"))) == 1


def test_compared_models_and_segments(spark):
    """Segmented running sums equal those of each segment alone, also with ties, one class and empty folds."""
    rng = random.Random(6)
    rows = [(m, i % 3, 1 if m == "one" and i % 3 == 0 else int(rng.random() < 0.4), round(rng.random(), 1)) for m in ("one", "two") for i in range(90)] + [("two", 1, None, 0.5), ("two", 1, 1, None)]
    df = spark.createDataFrame(rows, "model string, fold int, y int, score double")
    got = {(r["model"], r["fold"]): (r["roc_auc"], r["average_precision"]) for r in metrics.ranking_metrics(df, "y", "score", ["model", "fold"]).collect()}
    assert len(got) == 6 and got["one", 0][0] is None
    for (model, fold), values in got.items():
        own = metrics.ranking_metrics(df.where((F.col("model") == model) & (F.col("fold") == fold)), "y", "score").first()
        assert all(a == b or a == pytest.approx(b, rel=1e-12) for a, b in zip(values, own, strict=True))
    thresholds = spark.createDataFrame([("one", "f1", 0.3), ("two", "f1", 0.7)], "model string, threshold_metric string, selected_threshold double")
    made = {r["model"]: r for r in train.comparison(df, df.drop("fold"), thresholds, "y").collect()}
    for model, t in (("one", 0.3), ("two", 0.7)):
        mine = df.where(F.col("model") == model)
        for name, at in (("default", 0.5), ("optimized", t)):
            want = metrics.binary_metrics(mine.where("y is not null"), "y", F.col("score") >= at).first()
            assert all(made[model][f"test_{name}_{m}"] == pytest.approx(want[m]) for m in ("accuracy", "f1", "specificity", "balanced_accuracy"))
        folds = [metrics.binary_metrics(mine.where((F.col("fold") == k) & F.col("y").isNotNull()), "y", F.col("score") >= 0.5).first()["f1"] for k in range(3)]
        assert made[model]["cv_f1_mean"] == pytest.approx(sum(folds) / 3)


def test_boosting_learns_from_combinations_of_bins(spark):
    """With few values a feature the trees are those that Spark learns from all rows, from far fewer rows."""
    rows = spark.range(6000).selectExpr("id", "cast(id % 7 as double) as a", "cast(id * 31 % 20 as double) as b", "5.0 as c", "cast((id % 7 > 3 and id * 31 % 20 > 8) or id % 50 = 0 as int) as y")
    names = ["a", "b", "c"]
    make = train.estimators(rounds=5)["gradient_boosting"]
    model = train.fit(rows, "y", names, make())
    assert type(model.stages[0]).__name__ == "Bucketizer"
    whole = Pipeline(stages=[VectorAssembler(inputCols=names, outputCol="_features"), make()]).fit(train.prepared(rows, "y"))
    own, other = ({r["id"]: r["probability"] for r in train.probability(m, rows).collect()} for m in (model, whole))
    assert max(abs(own[k] - other[k]) for k in own) < 1e-9 and len(set(own.values())) > 3
    odd = spark.createDataFrame([(float("-inf"), 1.0), (0.0, 1.0), (float("inf"), 1.0), (float("nan"), 1.0)] * 2, "v double, k double")
    assert all(x == sorted(set(x)) for x in train.borders(odd, ["v", "k"])) and len(train.borders(odd, ["v", "k"])[0]) == 2


def test_near_constant_columns_without_a_shuffle_of_values(spark, monkeypatch):
    rows = spark.range(2000).selectExpr("id as many", "if(id < 5, id, 7) as one", "if(id < 20, id, 7) as less", "if(id < 5, id, null) as gone", "cast(null as double) as none", "-0.0 as zero")
    want = [r["feature"] for r in features.top_shares(rows).where("top_share > 0.995").collect()]
    monkeypatch.setattr(features, "top_shares", None)
    assert sorted(features.near_constant_features(rows)) == sorted(want) == ["gone", "none", "one", "zero"]
    assert features.near_constant_features(rows.limit(0)) == []


def test_flows_of_one_cluster_stay_where_they_are(spark):
    """Nearly all flows may be of one cluster, so they aren't dealt by cluster."""
    kept = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        made = graph.build(detect.suspicious(catalog.tiered(spark, "/root/testdata/sf0.001")))
        sorts = lambda df: sum("SortMergeJoin" in x and "isnull(cluster_id" in x for x in df._jdf.queryExecution().sparkPlan().toString().splitlines())
        assert sorts(made["flows"]) == sorts(made["clusters"]) == 2
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", kept)


def test_catalogue_of_a_few_addresses(spark):
    rows = materialize(catalog.tiered(spark, "/root/testdata/sf0.001"))
    whole = {r["endpoint"]: r.asDict() for r in report.endpoint_catalogue(rows).collect()}
    some = sorted(whole)[::7]
    few = report.endpoint_catalogue(rows, spark.createDataFrame([(x,) for x in [*some, some[0], "nowhere"]], "endpoint string"))
    assert {r["endpoint"]: r.asDict() for r in few.collect()} == {x: whole[x] for x in some} and len(some) > 5
