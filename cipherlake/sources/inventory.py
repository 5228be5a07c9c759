"""Inventories of files, and the sinks of reports."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cipherlake.functions.expr import artifact_type, numeric
from cipherlake.plans.scratch import materialize

#: Bytes of a file that Spark reads into one row, and of a piece of a longer one.
WHOLE, PIECE = 64 << 20, 4 << 20


def reached(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path as Arrow opens it, and the path in it."""
    if path.startswith("file:") or "://" not in path:
        return fs.LocalFileSystem(), "/" + path.removeprefix("file:").lstrip("/")
    return fs.FileSystem.from_uri(path)


def opened(path: str) -> pa.NativeFile:
    """A file that Spark listed, as a stream."""
    system, inner = reached(path)
    return system.open_input_stream(inner)


def digest_of(stream: pa.NativeFile) -> str:
    """The hash of a stream, read in pieces."""
    digest = hashlib.sha256()
    with stream:
        while piece := stream.read(PIECE):
            digest.update(piece)
    return digest.hexdigest()


def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``path, sha256, length, modificationTime`` of listed files, each read in pieces."""
    for batch in batches:
        told = [digest_of(opened(path)) for path in batch.column(0).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(told, pa.string()), batch.column(1), batch.column(2)], ["path", "sha256", "length", "modificationTime"])


def files(spark: SparkSession, folder: str, stage: str = "", whole: int = WHOLE) -> DataFrame:
    """``stage, path, sha256, size, modified`` of every file under a folder.

    Files of at most ``whole`` bytes go through Spark's reader, one to a row.
    Longer ones, of any size, are only listed by it, dealt to tasks by their
    paths, and read there in pieces, so memory doesn't follow their size.  For
    that the tasks must reach them by a path that Arrow's file systems open.
    Empty files aren't listed, since Spark's reader leaves them out.
    """
    read = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder)
    short = read.where(F.col("length") <= whole).select("path", F.sha2("content", 256).alias("sha256"), "length", "modificationTime")
    long = read.where(F.col("length") > whole).select("path", "length", "modificationTime").repartition("path")
    both = short.union(long.mapInArrow(hashed, "path string, sha256 string, length long, modificationTime timestamp"))
    return both.select(F.lit(stage).alias("stage"), "path", "sha256", F.col("length").alias("size"), F.col("modificationTime").alias("modified"))


#: Files of a folder that :func:`write_files` makes.
FOLDER = 1000


def write_files(rows: DataFrame, folder: str, key: str, text: str) -> DataFrame:
    """``folder`` of the folders under ``folder`` that hold a file ``key=value`` for each row, with its text as a line.

    ``key`` is unique.  Tasks write the files themselves, about ``FOLDER`` to a
    folder, so no commit moves them one by one; a task that is repeated writes
    the same ones again.
    """
    # Fixed while the files are written, since the folders follow from it.
    parts = max(1, -(-rows.count() // FOLDER))
    dealt = rows.select(F.pmod(F.xxhash64(key), F.lit(parts)).alias("part"), F.col(key).cast("string"), F.col(text).cast("string"))

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, inner = reached(folder)
        made = set()
        for batch in batches:
            for part, name, line in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if part not in made:
                    system.create_dir(f"{inner}/part={part}")
                    made.add(part)
                with system.open_output_stream(f"{inner}/part={part}/{key}={name}") as out:
                    out.write(f"{line or ''}\n".encode("utf-8", "surrogatepass"))
        yield pa.RecordBatch.from_arrays([pa.array([f"{folder}/part={p}" for p in made], pa.string())], ["folder"])

    cores = rows.sparkSession.sparkContext.defaultParallelism
    written = dealt.repartition(max(cores, -(-parts // 10)), "part").mapInArrow(write, "folder string")
    return materialize(written.distinct())


def files_of(folders: DataFrame, stage: str = "") -> DataFrame:
    """As :func:`files`, of the files right in each of ``folders (folder)``, which a task lists and reads in pieces.

    For more files than a driver can list; tasks must reach them by a path that Arrow's file systems open.
    """

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for folder in batch.column(0).to_pylist():
                system, inner = reached(folder)
                found = [f for f in system.get_file_info(fs.FileSelector(inner)) if f.type == fs.FileType.File]
                told = [digest_of(system.open_input_stream(f.path)) for f in found]
                paths = [f"{folder}/{f.base_name}" for f in found]
                times = pa.array([f.mtime_ns // 1000 for f in found], pa.int64()).cast(pa.timestamp("us", "UTC"))
                yield pa.RecordBatch.from_arrays([pa.array(paths, pa.string()), pa.array(told, pa.string()), pa.array([f.size for f in found], pa.int64()), times], ["path", "sha256", "size", "modified"])

    cores = folders.sparkSession.sparkContext.defaultParallelism
    read_ = folders.repartition(max(cores, -(-folders.count() // 10)), "folder").mapInArrow(read, "path string, sha256 string, size long, modified timestamp")
    return read_.select(F.lit(stage).alias("stage"), "path", "sha256", "size", "modified")


def with_parents(entries: DataFrame, parents: DataFrame) -> DataFrame:
    """Provenance entries with the hash of the file each was made from (``parent_path``)."""
    of = parents.select(F.col("path").alias("parent_path"), F.col("sha256").alias("parent_sha256"))
    return entries.join(of, "parent_path", "left")


def artifacts(spark: SparkSession, folder: str) -> DataFrame:
    """Files of a run with their kind."""
    return files(spark, folder).withColumn("artifact_type", artifact_type(F.col("path")))


def quality_reports(spark: SparkSession, folder: str, limit: int = 8) -> DataFrame:
    """The newest reports, whether they failed, and the names of their failed gates."""
    schema = "dataset_name string, failed boolean, outcomes array<struct<name: string, status: string>>"
    read = spark.read.schema(schema).option("recursiveFileLookup", True).option("multiLine", True).option("pathGlobFilter", "*.json").json(folder)
    bad = F.transform(F.filter("outcomes", lambda o: F.lower(o["status"]) == "fail"), lambda o: F.coalesce(o["name"], F.lit("unknown")))
    return read.select("dataset_name", "failed", bad.alias("failed_gates"), F.col("_metadata.file_modification_time").alias("modified"), F.col("_metadata.file_path").alias("path")).orderBy(F.desc("modified"), "path").limit(limit)


def quality_flags(sources: DataFrame, reports: DataFrame) -> DataFrame:
    """Sources with ``quality_failed`` of their report, null where there is none."""
    return sources.join(reports.select("dataset_name", F.col("failed").alias("quality_failed")), "dataset_name", "left")


def importances(native: DataFrame, permutation: DataFrame, limit: int = 12) -> DataFrame:
    """``model, feature, value`` of the strongest features, native where a model has it."""
    first = native.select("model", "feature", F.col("importance").alias("value"))
    second = permutation.select("model", "feature", F.col("importance_mean").alias("value")).join(first.select("model").distinct(), "model", "left_anti")
    ranked = Window.partitionBy("model").orderBy(F.desc("value"), "feature")
    return first.union(second).withColumn("rank", F.row_number().over(ranked)).where(F.col("rank") <= limit)


def json_safe(table: DataFrame) -> DataFrame:
    """Numbers that JSON can't hold become null."""
    return table.select(*(numeric(F.col(c)).alias(c) if kind in ("double", "float") else F.col(c) for c, kind in table.dtypes))


def write_table(table: DataFrame, path: str, by: str | None = None, format: str = "parquet") -> None:
    """A stage's table as Parquet, or as CSV with a header, where lists are written as JSON; by partitions of one column if it is named."""
    if format == "csv":
        nested = [c for c, kind in table.dtypes if kind.startswith(("array", "struct", "map"))]
        table = table.withColumns({c: F.to_json(c) for c in nested}) if nested else table
    writer = table.write.mode("overwrite")
    writer = writer.partitionBy(by) if by else writer
    writer.csv(path, header=True, escape='"') if format == "csv" else writer.parquet(path)


def write_json(table: DataFrame, path: str) -> None:
    json_safe(table).write.mode("overwrite").option("ignoreNullFields", False).json(path)


def write_graph(tables: dict[str, DataFrame], path: str) -> None:
    """Nodes, edges and clusters, each as JSON lines."""
    for name in ("nodes", "edges", "clusters"):
        write_json(tables[name], f"{path}/{name}")
