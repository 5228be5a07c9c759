"""Lineage cuts and size-checked joins.

Intermediate tables go to the folder named by ``spark.checkpoint.dir``, which
all machines of a cluster share.  Only where that setting is missing on a local
master (tests, notebooks on one machine) does a temporary folder take its
place; on a cluster its absence is an error.
"""

from __future__ import annotations

import atexit
import gc
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Largest number of cells (a key and a few numbers, or an element of an array of these) that is broadcast.
BROADCAST_CELLS = 1_000_000


def scratch_root(spark: SparkSession) -> str:
    """The shared folder; sets one for this session where none is named."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root
    root = spark.conf.get("cipherlake.scratch", None)
    if not root:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that all machines share")
        folder = tempfile.mkdtemp(prefix="cipherlake-")
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
        root = f"file://{folder}"
        spark.conf.set("cipherlake.scratch", root)
        spark.sparkContext.setCheckpointDir(root)
    return root


def materialize(df: DataFrame) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it back.

    The result has no lineage, so an executor lost later costs a re-read and
    not a recomputation.
    """
    spark = df.sparkSession
    path = f"{scratch_root(spark).rstrip('/')}/t-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def release(spark: SparkSession) -> None:
    """Have the shuffle files of frames that nothing refers to any more deleted, which Spark does when the driver collects its garbage."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def file_system(spark: SparkSession, path: str) -> tuple:
    """The file system of a path that Spark can open, and the path in it."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()), place


def drop_table(df: DataFrame) -> None:
    """Delete the files behind a frame made by :func:`materialize`."""
    for file in df.inputFiles()[:1]:
        files, path = file_system(df.sparkSession, file)
        files.delete(path.getParent(), True)


def is_small(df: DataFrame, bound: int = BROADCAST_CELLS) -> bool:
    """Whether the rows of ``df`` and their array elements are at most ``bound``."""
    arrays = [c for c, kind in df.dtypes if kind.startswith("array")]
    return df.select(sum((F.coalesce(F.size(c), F.lit(0)) for c in arrays), F.lit(1)).cast("long").alias("n")).agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0] <= bound


def small(df: DataFrame, bound: int = BROADCAST_CELLS) -> DataFrame:
    """``df`` with a broadcast hint if its rows and their array elements are at most ``bound``.

    Beyond the bound the frame comes back as it is and the join shuffles.  The
    frame should be materialized, since it is counted, and hold numbers only.
    """
    return F.broadcast(df) if is_small(df, bound) else df
