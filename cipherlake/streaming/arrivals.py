"""Scoring of arriving flows into several tables that become visible together.

Each arrival writes its tables under its batch number and the name of the
attempt, then one small commit record by a rename.  Readers take only the
attempts that a record names, so a half-written arrival isn't seen, and a batch
that is repeated after its record is written changes nothing.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery

from cipherlake.operators import detect, graph
from cipherlake.plans.scratch import drop_table, file_system, materialize, small

Tables = Callable[[DataFrame], Mapping[str, DataFrame]]


def scored_tables(score: Callable[[DataFrame], DataFrame], rules: detect.Rules = detect.Rules(), least: int = 1) -> Tables:  # noqa: B008
    """The tables of a scoring job: all scored flows, the suspicious ones, and the graph of these."""

    def tables(batch: DataFrame) -> dict[str, DataFrame]:
        scored = materialize(detect.apply_rules(score(batch), rules))
        made = graph.build(detect.suspicious(scored), least)
        return {"scored": scored, "suspicious": made["flows"], **{k: made[k] for k in ("nodes", "edges", "clusters", "windows")}}

    return tables


def record_path(root: str, number: int) -> str:
    return f"{root.rstrip('/')}/commits/{number:012}.json"


def is_committed(spark: SparkSession, root: str, number: int) -> bool:
    files, path = file_system(spark, record_path(root, number))
    return files.exists(path)


def commit(spark: SparkSession, root: str, number: int, attempt: str) -> None:
    """Makes one attempt at a batch visible, by a file that appears whole."""
    files, path = file_system(spark, record_path(root, number))
    files.mkdirs(path.getParent())
    _, draft = file_system(spark, f"{root.rstrip('/')}/commits/.{attempt}")
    out = files.create(draft, True)
    out.write(f'{{"batch": {number}, "attempt": "{attempt}"}}\n'.encode())
    out.close()
    if files.exists(path) or not files.rename(draft, path):
        files.delete(draft, False)
        raise RuntimeError(f"batch {number} is committed already")


def write_arrival(batch: DataFrame, number: int, tables: Tables, root: str) -> None:
    """Writes all tables of one batch, then commits them; does nothing if the batch is committed."""
    spark = batch.sparkSession
    if is_committed(spark, root, number):
        return
    attempt = f"a{uuid.uuid4().hex}"
    made = tables(batch)
    for name, table in made.items():
        table.write.parquet(f"{root.rstrip('/')}/{name}/batch={number}/attempt={attempt}")
    commit(spark, root, number, attempt)
    if "scored" in made:
        drop_table(made["scored"])


def committed(spark: SparkSession, root: str) -> DataFrame:
    """``batch, attempt`` of all commits."""
    return spark.read.schema("batch long, attempt string").json(f"{root.rstrip('/')}/commits")


def read_arrivals(spark: SparkSession, root: str, name: str) -> DataFrame:
    """One table of all committed batches, with the number of its ``batch``."""
    rows = spark.read.parquet(f"{root.rstrip('/')}/{name}").withColumn("batch", F.col("batch").cast("long"))
    return rows.join(small(committed(spark, root)), ["batch", "attempt"], "left_semi").drop("attempt")


def clear_attempts(spark: SparkSession, root: str, name: str) -> int:
    """Deletes what attempts without a commit left of one table; not while a batch is being written."""
    there = spark.read.parquet(f"{root.rstrip('/')}/{name}").select(F.col("batch").cast("long").alias("batch"), "attempt").distinct()
    left = there.join(committed(spark, root), ["batch", "attempt"], "left_anti").collect()
    for row in left:
        files, path = file_system(spark, f"{root.rstrip('/')}/{name}/batch={row['batch']}/attempt={row['attempt']}")
        files.delete(path, True)
    return len(left)


def run_arrivals(flows: DataFrame, tables: Tables, root: str, checkpoint: str) -> StreamingQuery:
    """Writes and commits everything that is there, batch by batch, and stops."""
    query = flows.writeStream.foreachBatch(lambda batch, number: write_arrival(batch, number, tables, root)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return query
