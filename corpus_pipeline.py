"""The corpus pipeline: language, repeated lines, near-duplicates, benchmark passages, packing.

Each stage is a function of (spark, docs, sf_dir).  All but the last return the
columns of ``documents``; the last returns the packed pieces.

Cases: the language stage drops null, empty and letterless texts, and keeps all
others of a corpus without any label; it and decontamination decide on each row
by its text, so rows without ``doc_id`` or with a repeated one don't share a
fate there.  The line and near-duplicate stages take rows that share a
``doc_id`` for one document, and leave rows without one as they are.  An empty
table goes through all stages and gives no piece.  Further columns are kept by
all stages but the last.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cipherlake.llm import decontaminate, language, line_dedup, near_dup, packing
from cipherlake.llm.queries import remainder, table
from cipherlake.plans.scratch import materialize

#: Least probability with which the language stage keeps a document.
SURE = 0.4


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is told with some certainty; texts without a letter go."""
    return language.drop_unidentified(docs, remainder(3, 1), SURE)


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without lines that stand elsewhere; those with no line of their own go."""
    left = line_dedup.dedup_lines(docs)
    if "n_chars" in docs.columns:
        left = left.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return left.select(*docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates."""
    return near_dup.drop_near_duplicates(docs)


def drop_benchmark_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no item of ``benchmark``."""
    return decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces of the remaining documents, packed into sequences."""
    return packing.pack(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", identify_language),
    ("line_dedup", drop_repeated_lines),
    ("near_dedup", drop_near_duplicates),
    ("decontamination", drop_benchmark_documents),
    ("packing", pack_sequences),
]

#: The trained and token stages can't be said in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {"pipeline": run}


def oracle_sql() -> dict[str, str]:
    return {"pipeline": ORACLE_SQL} if ORACLE_SQL else {}
