import hashlib
import json
import os
import random

import pytest
from pyspark.sql import functions as F

from cipherlake.operators import asof, gates
from cipherlake.sources import inventory, logs
from cipherlake.streaming import arrivals, matching
from cipherlake.streaming import flows as streams


def test_logs(spark, tmp_path):
    (tmp_path / "conn.log").write_text("#separator \\x09\n#fields\tts\tuid\tnote\n1.0\tC1\t-\n2.0\tC2\n3.0\tC3\tx\textra\n#close\n")
    (tmp_path / "ssl.log").write_text('{"uid": "C1", "version": "TLSv13"}\nnot json\n{"uid": "C2", "cipher": "a"}\n')
    (tmp_path / "odd.log").write_text("hello\n")
    folder = str(tmp_path)
    assert {r["log"]: r["format"] for r in logs.sniff(spark, folder).collect()} == {"conn": "tsv", "ssl": "json", "odd": "unknown"}
    read = logs.read_logs(spark, folder)
    assert sorted(read) == ["conn", "ssl"]
    assert [tuple(r) for r in read["conn"].orderBy("ts").collect()] == [("1.0", "C1", None), ("2.0", "C2", None), ("3.0", "C3", "x")]
    assert [tuple(r) for r in read["ssl"].orderBy("uid").collect()] == [(None, "C1", "TLSv13"), ("a", "C2", None)]
    assert logs.tls_log({"tls": 1}) == 1 and logs.tls_log({"tls": 1, "ssl": 2}) == 2 and logs.tls_log({}) is None


def test_rotated_logs_are_one(spark, tmp_path):
    """Files of one log with other fields, separators, orders and formats; the first header of a file counts."""
    (tmp_path / "conn.2024-01-01.log").write_text("#separator \\x09\n#fields\tts\tuid\tnote\n1.0\tA\t-\n2.0\tA2\n#close\n")
    (tmp_path / "conn.2024-01-02.log").write_text("#separator ,\n#fields,uid,extra,ts\nB,x,3.0\nB2,(empty),4.0,more\n\n")
    (tmp_path / "conn.2024-01-03.log").write_text('\n{"uid":"C","more":{"a":1},"ts":5}\nnot\n{"uid":"C2","note":null}\n')
    (tmp_path / "conn.2024-01-04.log").write_text("only words\n")
    (tmp_path / "ssl.log").write_text("#separator \\x09\n#fields uid v\nS\t1\n")
    (tmp_path / "other.log").write_text("#fields\tq\n7\n")
    read = logs.read_logs(spark, str(tmp_path))
    assert sorted(read) == ["conn", "ssl"] and sorted(logs.read_logs(spark, str(tmp_path), every=True)) == ["conn", "other", "ssl"]
    names = ("ts", "uid", "extra", "note", "more")
    assert set(read["conn"].columns) == set(names)
    got = {tuple(r[n] for n in names) for r in read["conn"].collect()}
    assert got == {("1.0", "A", None, None, None), ("2.0", "A2", None, None, None), ("3.0", "B", "x", None, None), ("4.0", "B2", None, None, None), ("5", "C", None, None, '{"a":1}'), (None, "C2", None, None, None)}
    assert [tuple(r) for r in read["ssl"].collect()] == [("S", "1")]
    assert logs.read_logs(spark, str(tmp_path), logs=("http",)) == {}


def test_written_logs_read_alike(spark, tmp_path):
    rows = [(1, "a", None), (2, "tab\tand\nline", 0.5), (3, "", 1.5)]
    df = spark.createDataFrame(rows, "id long, note string, x double").repartition(2)
    logs.write_log(df, str(tmp_path), "http")
    logs.write_log(df.select("x", "id"), str(tmp_path), "http", "json")
    assert all(p.name.startswith("http.") and p.name.endswith(".log") for p in tmp_path.iterdir() if not p.name.startswith("."))
    got = logs.read_logs(spark, str(tmp_path))["http"].select("id", "note", "x").collect()
    text = {1: ("a", None), 2: ("tab\\x09and\\x0aline", "0.5"), 3: ("", "1.5")}
    assert {tuple(r) for r in got} == {(str(i), n, x) for i, (n, x) in text.items()} | {(str(i), None, None if x is None else str(x)) for i, _, x in rows}
    assert len(got) == 6


def test_inventory_and_reports(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.pcap").write_bytes(b"abc")
    got = inventory.artifacts(spark, str(tmp_path / "in")).first()
    assert (got["sha256"], got["size"], got["artifact_type"]) == (hashlib.sha256(b"abc").hexdigest(), 3, "pcap")
    report = {"dataset_name": "d", "failed": True, "outcomes": [{"name": "g", "status": "FAIL"}, {"gate": "h", "status": "fail"}, {"name": "ok", "status": "pass"}]}
    (tmp_path / "q").mkdir()
    (tmp_path / "q/d.json").write_text(json.dumps(report))
    found = inventory.quality_reports(spark, str(tmp_path / "q"))
    assert found.first()["failed_gates"] == ["g", "unknown"]
    sources = spark.createDataFrame([("d",), ("e",)], "dataset_name string")
    assert {r[0]: r[1] for r in inventory.quality_flags(sources, found).collect()} == {"d": True, "e": None}
    gates.Report("x", [gates.Outcome("n", "pass", "m")]).write(spark, str(tmp_path / "r"))
    assert spark.read.json(str(tmp_path / "r")).first()["dataset_name"] == "x"
    inventory.write_json(spark.createDataFrame([(float("nan"), 1)], "a double, b int"), str(tmp_path / "j"))
    assert spark.read.schema("a double, b int").json(str(tmp_path / "j")).first()["a"] is None
    native = spark.createDataFrame([("rf", f"f{i}", float(i)) for i in range(20)], "model string, feature string, importance double")
    other = spark.createDataFrame([("rf", "z", 9.0), ("nb", "z", 1.0)], "model string, feature string, importance_mean double")
    best = inventory.importances(native, other)
    assert best.count() == 13 and best.where("model = 'rf' and feature = 'z'").isEmpty()


def test_files_of_any_size_are_hashed_in_pieces(spark, tmp_path):
    """A sparse file beyond what one row can hold, short ones beside it, and names that need care."""
    size = (2 << 30) + 12_345
    with (tmp_path / "large.bin").open("wb") as f:
        f.truncate(size)
        f.seek(size - 3)
        f.write(b"end")
    (tmp_path / "sub").mkdir()
    (tmp_path / "sub/a b%20c.txt").write_bytes(b"x" * 5000)
    (tmp_path / "empty").write_bytes(b"")
    want = {}
    for path in (p for p in tmp_path.rglob("*") if p.is_file() and p.stat().st_size):
        with path.open("rb") as f:
            want[path.name] = (hashlib.file_digest(f, "sha256").hexdigest(), path.stat().st_size)
    for whole in (inventory.WHOLE, 100):
        got = inventory.files(spark, str(tmp_path), "raw", whole).collect()
        assert {r["path"].rsplit("/", 1)[-1].replace("%2520", "%20"): (r["sha256"], r["size"]) for r in got} == want and {r["stage"] for r in got} == {"raw"}


def test_provenance_tables_and_sinks(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.pcap").write_bytes(b"abc")
    found = inventory.files(spark, str(tmp_path / "in"))
    entries = spark.createDataFrame([("flows.csv", found.first()["path"]), ("other.csv", "gone"), ("raw.csv", None)], "path string, parent_path string")
    parents = {r["path"]: r["parent_sha256"] for r in inventory.with_parents(entries, found).collect()}
    assert parents == {"flows.csv": hashlib.sha256(b"abc").hexdigest(), "other.csv": None, "raw.csv": None}
    df = spark.createDataFrame([(1, 'quo"te, and\nline', ["x", "y"], "a"), (2, None, [], "b")], "id int, note string, tags array<string>, kind string")
    inventory.write_table(df, str(tmp_path / "csv"), format="csv")
    back = spark.read.csv(str(tmp_path / "csv"), header=True, multiLine=True, escape='"').orderBy("id").collect()
    assert [(r["id"], r["note"], r["tags"]) for r in back] == [("1", 'quo"te, and\nline', '["x","y"]'), ("2", None, "[]")]
    inventory.write_table(df, str(tmp_path / "by"), by="kind")
    assert sorted(p.name for p in (tmp_path / "by").glob("kind=*")) == ["kind=a", "kind=b"] and spark.read.parquet(str(tmp_path / "by")).count() == 2
    inventory.write_graph({"nodes": df.select("id"), "edges": df.select("id", "kind"), "clusters": df.limit(0)}, str(tmp_path / "graph"))
    assert spark.read.json(str(tmp_path / "graph/edges")).count() == 2 and (tmp_path / "graph/clusters").is_dir()


def test_arrivals_are_visible_together_or_not_at_all(spark, tmp_path, monkeypatch):
    """A batch that dies between two tables isn't seen; run again it is, once, and repeating it changes nothing."""
    names = "event_id long, src_ip string, dst_ip string, bidirectional_first_seen_ms long, tier1_pass boolean, random_forest_probability double, gradient_boosting_probability double, capture_id string, window_id string, protocol_family string, requested_server_name string"
    rows = [(i, "10.0.0.1", f"8.8.8.{i}", 1000 * i, True, 0.9, 0.9, "c", "c:w0", "tls", "h") for i in range(6)]
    df = spark.createDataFrame(rows, names)
    source, root, state = str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "state")
    tables = arrivals.scored_tables(lambda d: d)
    stream = lambda: streams.read_flows(spark, source, df.schema)
    df.where("event_id < 3").coalesce(1).write.parquet(source)
    arrivals.run_arrivals(stream(), tables, root, state)
    counts = lambda: {n: arrivals.read_arrivals(spark, root, n).count() for n in ("scored", "suspicious", "nodes", "edges", "clusters", "windows")}
    first = counts()
    assert first == {"scored": 3, "suspicious": 3, "nodes": 4, "edges": 3, "clusters": 1, "windows": 1}
    df.where("event_id >= 3").coalesce(1).write.mode("append").parquet(source)

    def dies(batch):
        made = dict(tables(batch))
        made["edges"] = made["edges"].withColumn("boom", F.raise_error(F.lit("killed")))
        return made

    with pytest.raises(Exception, match="killed"):
        arrivals.run_arrivals(stream(), dies, root, state)
    assert counts() == first
    arrivals.run_arrivals(stream(), tables, root, state)
    second = counts()
    assert second == {"scored": 6, "suspicious": 6, "nodes": 8, "edges": 6, "clusters": 2, "windows": 2}
    arrivals.write_arrival(df, 1, tables, root)
    assert counts() == second and arrivals.read_arrivals(spark, root, "scored").where("batch = 1").count() == 3
    with pytest.raises(RuntimeError, match="committed"):
        arrivals.commit(spark, root, 1, "another")
    assert counts() == second
    assert arrivals.clear_attempts(spark, root, "nodes") == 1 and arrivals.clear_attempts(spark, root, "nodes") == 0 and counts() == second


def test_streams_agree_with_batch(spark, tmp_path):
    def flow(i, ms):
        return (i, "10.0.0.1", "8.8.8.8", 1, 443, 6, ms, ms + 5, True, 0.9, 0.9, "c")

    names = "event_id long, src_ip string, dst_ip string, src_port long, dst_port long, protocol long, bidirectional_first_seen_ms long, bidirectional_last_seen_ms long, tier1_pass boolean, random_forest_probability double, gradient_boosting_probability double, capture_id string"
    batch = spark.createDataFrame([flow(1, 1000), flow(2, 1000), flow(3, 61_000), flow(4, 900_000)], names)
    batch.coalesce(1).write.parquet(str(tmp_path / "in"))
    read = lambda: streams.read_flows(spark, str(tmp_path / "in"), batch.schema)
    streams.run_once(streams.without_duplicates(read()).drop("flow_start"), str(tmp_path / "d"), str(tmp_path / "dc"))
    assert spark.read.parquet(str(tmp_path / "d")).count() == 3
    streams.run_once(streams.timeline(streams.scored(read())), str(tmp_path / "t"), str(tmp_path / "tc"))
    assert spark.read.parquet(str(tmp_path / "t")).agg(F.sum("suspicious_flows")).first()[0] == 3  # the last window is still open
    conn = spark.createDataFrame([("C1", 1500, "8.8.8.8", "10.0.0.1", 443, 1, "tcp"), ("C2", 1200, "10.0.0.1", "8.8.8.8", 1, 443, "tcp")], "uid string, ts_ms long, orig_h string, resp_h string, orig_p int, resp_p int, proto string")
    conn.write.parquet(str(tmp_path / "conn"))
    logs_ = spark.readStream.schema(conn.schema).parquet(str(tmp_path / "conn"))
    streams.run_once(streams.candidate_matches(read(), logs_), str(tmp_path / "m"), str(tmp_path / "mc"))
    got = streams.nearest_matches(spark.read.parquet(str(tmp_path / "m")))
    assert {r["flow_id"]: r["uid"] for r in got.collect()} == {1: "C2", 2: "C2"}
    streams.score_arrivals(read(), lambda d: d, str(tmp_path / "s"), str(tmp_path / "sc"))
    assert spark.read.parquet(str(tmp_path / "s")).where("tier2_pass").count() == 4


def arriving(spark, folder, df, parts):
    """Writes ``df`` as files that arrive one after the other: rows of each of ``parts`` (conditions), in that order."""
    seen = set()
    for k, part in enumerate(parts):
        df.where(part).coalesce(1).write.mode("append").parquet(str(folder))
        fresh = set(folder.glob("*.parquet")) - seen
        for file in fresh:
            os.utime(file, (1_700_000_000 + k,) * 2)
        seen |= fresh
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(folder))


def test_nearest_connection_in_keyed_state(spark, tmp_path):
    """Over several micro-batches, with rows that come too late, flows get the match of the batch join once the watermark is past them."""
    own = spark.newSession()
    for k, v in {**matching.STATE_STORE, "spark.sql.shuffle.partitions": "2", "spark.sql.session.timeZone": "UTC"}.items():
        own.conf.set(k, v)
    rng = random.Random(9)
    flows = [(i if i % 5 else None, rng.choice("ab"), rng.choice(["c", "d", None]), 1, rng.choice([2, 3]), rng.choice([6, 17, None]), 1000 + rng.randrange(300) * 1000) for i in range(260)]
    conn = [(f"C{i:04}", 1000 + rng.randrange(600) * 500, rng.choice("cd"), rng.choice("ab"), rng.choice([2, 3]), 1, rng.choice(["tcp", "udp", "gre", None])) for i in range(2000)]
    names = "event_id long, src_ip string, dst_ip string, src_port long, dst_port long, protocol long, bidirectional_first_seen_ms long"
    f = spark.createDataFrame(flows, names)
    c = spark.createDataFrame(conn, "uid string, ts_ms long, orig_h string, resp_h string, orig_p int, resp_p int, proto string")
    start = "bidirectional_first_seen_ms"
    # The second file ends near 150 s and the third carries that on, so rows before 20 s come too late in the fourth.
    late = lambda ms: f"{ms} < 20000 and {ms} % 3000 = 0"
    parts = lambda ms: [f"{ms} < 100000 and not ({late(ms)})", f"{ms} >= 100000 and {ms} <= 150000", f"{ms} > 150000 and {ms} <= 200000", late(ms), f"{ms} > 200000"]
    left, right = arriving(own, tmp_path / "f", f, parts(start)), arriving(own, tmp_path / "c", c, parts("ts_ms"))
    made = matching.nearest_connections(left, right, bucket_ms=20_000)
    streams.run_once(made, str(tmp_path / "o"), str(tmp_path / "k"))
    key = lambda r: tuple(repr(x) for x in r)
    got = sorted(((r["flow_id"], r["flow_ms"], r["uid"], r["ts_ms"]) for r in spark.read.parquet(str(tmp_path / "o")).collect()), key=key)
    on_time = asof.match_connections(f.where(f"not ({late(start)})"), c.where(f"not ({late('ts_ms')})"))
    last = min(max(x[6] for x in flows), max(r["ts_ms"] for r in c.where("proto in ('tcp', 'udp')").collect())) - 120_000
    want = sorted(((r["event_id"], r[start], r["uid"], r["ts_ms"]) for r in on_time.where(F.col(start) + 2000 <= last).collect()), key=key)
    assert got == want
    assert sum(r[2] is not None for r in got) > 20 and sum(r[2] is None for r in got) > 20


def test_keyed_state_takes_many_keys_a_group(spark, monkeypatch):
    """A call to the state costs a millisecond, so it follows shares and stretches and not the flows' keys."""
    seen = {}

    def grouped(self, *keys):
        seen["groups"] = self.select(*keys).distinct()
        raise StopIteration

    names = "event_id long, src_ip string, dst_ip string, src_port long, dst_port long, protocol long, bidirectional_first_seen_ms long"
    f = spark.range(20_000).selectExpr("id as event_id", "cast(id as string) as src_ip", "'d' as dst_ip", "1L as src_port", "2L as dst_port", "6L as protocol", "id * 100 as bidirectional_first_seen_ms")
    assert ", ".join(f"{n} {t.replace('bigint', 'long')}" for n, t in f.dtypes) == names
    c = spark.createDataFrame([("C", 0, "d", "0", 2, 1, "tcp")], "uid string, ts_ms long, orig_h string, resp_h string, orig_p int, resp_p int, proto string")
    monkeypatch.setattr(type(f), "groupBy", grouped)
    with pytest.raises(StopIteration):
        matching.nearest_connections(f, c)
    assert seen["groups"].count() <= 2 * matching.SHARES


def test_files_are_written_listed_and_read_by_tasks(spark, tmp_path, monkeypatch):
    """A file for each row, many to a folder, with the hashes that Spark's reader gives."""
    monkeypatch.setattr(inventory, "FOLDER", 20)
    rows = spark.createDataFrame([(i, None if i == 7 else f"page {i} é\n" * i) for i in range(100)], "page_id long, html string")
    folders = inventory.write_files(rows, f"file://{tmp_path}/pages", "page_id", "html")
    assert 1 < folders.count() <= 5 and len(list(tmp_path.glob("pages/*/*"))) == 100
    found = {r["path"].rsplit("=", 1)[1]: (r["sha256"], r["size"]) for r in inventory.files_of(folders).collect()}
    assert found == {str(i): (hashlib.sha256(t.encode()).hexdigest(), len(t.encode())) for i, t in ((i, ("" if i == 7 else f"page {i} é\n" * i) + "\n") for i in range(100))}
    spark_read = {r["path"].rsplit("=", 1)[1]: (r["sha256"], r["size"]) for r in inventory.files(spark, f"file://{tmp_path}/pages").collect()}
    assert spark_read == found
    assert inventory.files_of(inventory.write_files(rows.limit(0), f"file://{tmp_path}/none", "page_id", "html")).count() == 0
