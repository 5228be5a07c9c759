"""Protocol logs: TSV with a described header and JSON lines, rotated over any number of files."""

from __future__ import annotations

import uuid
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cipherlake.plans.scratch import file_system, materialize, small

CORE_LOGS = ("conn", "ssl", "tls", "x509", "quic", "http")
UNSET = ("-", "(empty)")
HEAD_LINES = 50


def lines_of(spark: SparkSession, path: str) -> DataFrame:
    """``value, file, log, n`` of all lines of the logs of a folder or file, or all that a pattern names.

    A log's name is its file's up to the first dot, so rotated files are one
    log.  ``n`` grows with a line's place in the part of the file that a task reads.
    """
    text = spark.read.option("pathGlobFilter", "*.{log,log.gz}").text(path)
    place = F.when(F.col("_metadata.file_block_start") == 0, F.monotonically_increasing_id())
    return text.select("value", F.col("_metadata.file_path").alias("file"), F.regexp_extract("_metadata.file_name", r"^([^.]*)", 1).alias("log"), place.alias("n"))


def is_object(value: Column) -> Column:
    return F.trim(value).startswith("{") & F.trim(value).endswith("}")


def heads(lines: DataFrame) -> DataFrame:
    """``file, log, format, separator, fields``: what the first lines of each file tell of it.

    The format is ``tsv``, ``json`` or ``unknown``, by the first of the leading
    lines that shows one.  ``separator`` is a regular expression.
    """
    value = F.col("value")
    is_fields, is_separator = value.startswith("#fields"), value.startswith("#separator")
    kind = F.when(is_fields | is_separator, "tsv").when(is_object(value), "json")
    first = lambda test: F.min(F.when(test, F.struct("n", "value")))
    told = lines.where("n is not null").groupBy("file", "log").agg(F.min("n").alias("n"), F.min(F.when(kind.isNotNull(), F.struct("n", kind.alias("kind")))).alias("k"), first(is_fields).alias("f"), first(is_separator).alias("s"))
    mark = F.trim(F.regexp_replace("s.value", r"^#separator\s?", ""))
    # An escape such as \x09 means the same in a regular expression.
    pattern = F.when(mark.startswith("\\"), mark).when(mark != "", F.concat(F.lit("\\Q"), mark, F.lit("\\E"))).otherwise(F.lit("\t"))
    shown = F.when(F.col("k.n") < F.col("n") + HEAD_LINES, F.col("k.kind")).otherwise("unknown")
    told = told.select("file", "log", shown.alias("format"), pattern.alias("separator"), F.col("f.value").alias("f"))
    fields = F.slice(F.split("f", F.concat(F.lit("\\s+|"), F.col("separator"))), F.lit(2), F.size(F.split("f", F.concat(F.lit("\\s+|"), F.col("separator")))))
    return told.select("file", "log", "format", "separator", F.when(F.col("format") == "tsv", F.filter(fields, lambda x: x != "")).alias("fields"))


def sniff(spark: SparkSession, folder: str) -> DataFrame:
    """``file, log, format`` of every log file."""
    return heads(lines_of(spark, folder)).select("file", "log", "format")


def names_in(lines: DataFrame, known: DataFrame) -> dict[str, list[str]]:
    """The columns of each log: the fields of all its headers in order of their place, and the keys of all its objects."""
    fields = known.select("log", F.posexplode("fields")).groupBy("log", F.col("col").alias("name")).agg(F.min("pos").alias("pos"))
    if known.where("format = 'json'").take(1):
        objects = lines.where(is_object(F.col("value"))).join(F.broadcast(known.where("format = 'json'").select("file")), "file")
        keys = objects.select("log", F.explode(F.json_object_keys("value")).alias("name")).distinct().withColumn("pos", F.lit(1 << 30))
        fields = fields.union(keys).groupBy("log", "name").agg(F.min("pos").alias("pos"))
    out: dict[str, list[str]] = {}
    for row in fields.orderBy("log", "pos", "name").collect():
        out.setdefault(row["log"], []).append(row["name"])
    return out


def rows_of(lines: DataFrame, known: DataFrame, log: str, names: Sequence[str]) -> DataFrame:
    """The rows of one log from all its files, each read by its own header; all columns are text, null where a file lacks one.

    Short rows end in nulls, longer ones are cut; the marks for unset and empty
    fields become nulls.  Lines of JSON files that aren't objects are dropped.
    """
    told = known.where(F.col("log") == log).select("file", "format", "separator", "fields")
    mine = lines.where(F.col("log") == log).select("file", "value").join(small(told), "file")
    tsv = F.col("format") == "tsv"
    mine = mine.where(F.when(tsv, ~F.col("value").startswith("#") & (F.col("value") != "")).otherwise(is_object(F.col("value"))))
    cells = F.when(tsv, F.split("value", F.col("separator"), F.lit(-1)))
    mine = mine.select("fields", cells.alias("cells"), F.when(~tsv, F.from_json("value", T.StructType([T.StructField(n, T.StringType()) for n in names]))).alias("object"))
    mine = mine.where("cells is not null or object is not null")

    def column(name: str) -> Column:
        cell = F.get("cells", F.array_position("fields", F.lit(name)).cast("int") - 1)
        return F.coalesce(F.when(~cell.isin(*UNSET), cell), F.col("object").getField(name)).alias(name)

    return mine.select(*(column(n) for n in names))


def read_logs(spark: SparkSession, folder: str, every: bool = False, logs: Sequence[str] = CORE_LOGS) -> dict[str, DataFrame]:
    """The core logs of a folder (or all) by name; files of unknown format are left out.

    The heads of all files are a table made in one scan, so the number of jobs
    doesn't follow the number of files; each log then reads its own files at
    once, joined with their heads.
    """
    lines = lines_of(spark, folder)
    known = materialize(heads(lines if every else lines.where(F.col("log").isin(*logs))).where("format <> 'unknown'"))
    return {log: rows_of(lines, known, log, names) for log, names in names_in(lines, known).items()}


def write_log(rows: DataFrame, folder: str, log: str, format: str = "tsv") -> None:
    """Writes a table as log files ``<log>.<number>.log``, one a task, each with its own header; nulls become the unset mark."""
    escaped = lambda c: F.replace(F.replace(F.col(c).cast("string"), F.lit("\t"), F.lit("\\x09")), F.lit("\n"), F.lit("\\x0a"))
    head = ["#separator \\x09", "\t".join(["#fields", *rows.columns])]

    def headed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield pa.RecordBatch.from_arrays([pa.array(head)], ["value"])
        for batch in batches:
            yield pa.RecordBatch.from_arrays(batch.columns, ["value"])

    if format == "json":
        text = rows.select(F.to_json(F.struct("*")).alias("value"))
    else:
        text = rows.select(F.concat_ws("\t", *(F.coalesce(escaped(c), F.lit(UNSET[0])) for c in rows.columns)).alias("value")).mapInArrow(headed, "value string")
    spark, part = rows.sparkSession, f"{folder.rstrip('/')}/.{uuid.uuid4().hex}"
    text.write.text(part)
    files, written = file_system(spark, part)
    for n, status in enumerate(s for s in files.listStatus(written) if s.getPath().getName().startswith("part-")):
        files.rename(status.getPath(), file_system(spark, f"{folder.rstrip('/')}/{log}.{part[-6:]}-{n:05}.log")[1])
    files.delete(written, True)


def tls_log(logs: dict[str, DataFrame]) -> DataFrame | None:
    """The log of TLS handshakes under its older or newer name."""
    return logs.get("ssl", logs.get("tls"))


def read_flows(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """Flow rows from CSV with a header under a declared schema; unreadable rows go to ``_corrupt``."""
    wide = T.StructType([*schema.fields, T.StructField("_corrupt", T.StringType())])
    return spark.read.schema(wide).csv(path, header=True, mode="PERMISSIVE", columnNameOfCorruptRecord="_corrupt")
