"""Flow-like views of the given tables, in SQL that Spark and DuckDB both run.

``@MS`` stands for an event's time in milliseconds, which the two spell differently.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

MS = {"spark": "unix_millis(cast(ts as timestamp))", "duckdb": "(epoch_us(ts) // 1000)"}

VIEWS = {
    "flows": """
select event_id,
  @MS as bidirectional_first_seen_ms,
  @MS + cast(floor(value*100) as bigint) as bidirectional_last_seen_ms,
  concat('10.0.', cast(cast(floor(user_id/250) as bigint) as string), '.', cast(user_id % 250 + 1 as string)) as src_ip,
  concat(case when event_id % 10 = 0 then '10.1.0.' else '45.12.7.' end, cast(cast(regexp_extract(props, '([0-9]+)', 1) as int) + 1 as string)) as dst_ip,
  40000 + event_id % 50 as src_port, 443 as dst_port,
  case when event_type = 'view' then 17 else 6 end as protocol,
  case event_type when 'click' then 'TLS.Google' when 'view' then 'QUIC.YouTube' when 'purchase' then 'TLS' when 'signup' then 'HTTP' end as application_name,
  case when event_type = 'error' and event_id % 2 = 0 then 'TLSv13' end as version,
  case when event_type = 'error' and event_id % 6 = 1 then concat('scid', cast(event_id as string)) end as client_scid,
  case event_id % 5 when 0 then 'mail.google.com' when 1 then 'static.qiwi.com' when 2 then concat('h', cast(event_id % 30 as string), '.evil.example') when 3 then '' end as requested_server_name,
  case when (event_id*7919) % 1000 + (event_id*31) % 400 > 900 then 1 else 0 end as label_id,
  concat('cap_', cast(user_id % 4 as string)) as capture_id,
  1 + event_id % 97 as bidirectional_packets
from events""",
    "conn": """
select concat('C', cast(event_id as string)) as uid,
  bidirectional_first_seen_ms + ((event_id % 7) - 3) * 900 as ts_ms,
  case when event_id % 2 = 0 then src_ip else dst_ip end as orig_h,
  case when event_id % 2 = 0 then dst_ip else src_ip end as resp_h,
  case when event_id % 2 = 0 then src_port else dst_port end as orig_p,
  case when event_id % 2 = 0 then dst_port else src_port end as resp_p,
  case when event_id % 101 = 0 then 'unknown_transport' when protocol = 17 then 'udp' else 'TCP' end as proto
from flows where event_id % 11 <> 0""",
    "certs": """
select uid, case when ts_ms % 13 = 0 then 'n/a' else cast(1024 + ts_ms % 3 * 1024 as string) end as key_length, concat('CN=', resp_h) as subject from conn
union all
select uid, '256' as key_length, cast(null as string) as subject from conn where ts_ms % 3 = 0""",
    "scored": """
select f.*, cast((event_id*7919) % 1000 as double)/1000.0 as tier1_probability,
  cast((event_id*7919) % 1000 >= 300 as boolean) as tier1_pass,
  case when (event_id*7919) % 1000 >= 300 then cast((event_id*104729) % 1000 as double)/1000.0 end as random_forest_probability,
  case when (event_id*7919) % 1000 >= 300 then cast((event_id*7907 + 11) % 1000 as double)/1000.0 end as gradient_boosting_probability
from flows f""",
}
#: What each view reads.
NEEDS = {"flows": (), "conn": ("flows",), "certs": ("flows", "conn"), "scored": ("flows",)}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the views over ``events``; the session must be on UTC."""
    made = {"events": table(spark, sf_dir, "events")}
    for each in (*NEEDS[name], name):
        made[each] = spark.sql(VIEWS[each].replace("@MS", MS["spark"]).replace("from events", "from {events}").replace("from flows", "from {flows}").replace("from conn", "from {conn}"), **{k: v for k, v in made.items() if f"from {k}" in VIEWS[each]})
    return made[name]


def with_views(*names: str) -> str:
    """The head of a DuckDB statement that defines views."""
    order = [n for n in VIEWS if n in {m for name in names for m in (*NEEDS[name], name)}]
    return "with " + ",\n".join(f"{n} as ({VIEWS[n].replace('@MS', MS['duckdb'])})" for n in order)
