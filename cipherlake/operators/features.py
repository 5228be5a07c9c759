"""Feature tables: masks, projections, pruning and the roles of columns."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.feature import VectorAssembler
from pyspark.ml.stat import Correlation
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cipherlake.functions.expr import numeric, quic_mask, tls_mask
from cipherlake.operators.canonical import METADATA

# Texts whose length is a feature, and columns that identify or leak.
LENGTHS_OF = ("server_name", "requested_server_name", "client_fingerprint", "server_fingerprint", "user_agent", "content_type")
IDENTIFIERS = (
    "id",
    "expiration_id",
    "uid",
    "src_ip",
    "dst_ip",
    "src_mac",
    "dst_mac",
    "src_port",
    "dst_port",
    "vlan_id",
    "tunnel_id",
    "first_seen_ms",
    "last_seen_ms",
    "bidirectional_first_seen_ms",
    "bidirectional_last_seen_ms",
    "ts",
)
LEAKAGE = ("src2dst_first_seen_ms", "dst2src_first_seen_ms", "ts_zeek_ssl", "ts_zeek_quic")
ROW_IDS = ("id", "expiration_id")
TIMES = ("ts", "flow_start_ms", "flow_end_ms", "window_start_ms", "window_end_ms")
TIME_ENDS = ("_first_seen_ms", "_last_seen_ms")


def with_masks(merged: DataFrame) -> DataFrame:
    """Adds ``is_tls`` and ``is_quic``."""
    return merged.withColumns({"is_tls": tls_mask(merged.columns), "is_quic": quic_mask(merged.columns)})


def encrypted_split(merged: DataFrame) -> dict[str, DataFrame]:
    """The encrypted rows and those of each protocol; ``merged`` should be materialized, since each part scans it."""
    marked = with_masks(merged)
    drop = lambda rows: rows.drop("is_tls", "is_quic")
    return {"all": merged, "encrypted": drop(marked.where("is_tls or is_quic")), "tls": drop(marked.where("is_tls")), "quic": drop(marked.where("is_quic"))}


def split_counts(merged: DataFrame) -> DataFrame:
    """Rows of each part in one pass."""
    return with_masks(merged).agg(F.count("*").alias("rows"), F.count_if(F.col("is_tls")).alias("tls_rows"), F.count_if(F.col("is_quic")).alias("quic_rows"), F.count_if(F.col("is_tls") | F.col("is_quic")).alias("encrypted_rows"))


def ml_ready(merged: DataFrame) -> DataFrame:
    """Numeric columns without identifiers, plus text lengths; null, NaN and infinite values are 0."""
    numbers = [f.name for f in merged.schema if isinstance(f.dataType, T.NumericType) and f.name not in IDENTIFIERS]
    lengths = [c for c in LENGTHS_OF if c in merged.columns]
    clean = lambda c: F.coalesce(numeric(F.col(c)), F.lit(0.0)).alias(c) if dict(merged.dtypes)[c] in ("double", "float") else F.coalesce(c, F.lit(0)).alias(c)
    return merged.select(*(clean(c) for c in numbers), *(F.coalesce(F.length(c), F.lit(0)).alias(f"{c}_len") for c in lengths))


def drop_leakage(features: DataFrame, columns: Sequence[str] = LEAKAGE) -> DataFrame:
    return features.drop(*(c for c in columns if c in features.columns))


def column_roles(table: DataFrame, target: str, excluded: Sequence[str] = ()) -> tuple[list[str], dict[str, str]]:
    """Feature columns, and of every other column why it is none."""
    features, reasons = [], {}
    for field in table.schema:
        c = field.name
        if c == target:
            reasons[c] = "target_column"
        elif c in METADATA or c in excluded:
            reasons[c] = "metadata"
        elif c in ROW_IDS:
            reasons[c] = "identifier"
        elif c in TIMES or c.endswith(TIME_ENDS):
            reasons[c] = "absolute_time"
        elif not isinstance(field.dataType, (T.NumericType, T.BooleanType)):
            reasons[c] = "non_numeric"
        else:
            features.append(c)
    return features, reasons


def label_lookup(table: DataFrame, target: str = "label_id", label: str = "label") -> DataFrame:
    """Each pair of a label's number and name, in order."""
    return table.select(target, label).distinct().orderBy(target, label)


def align(table: DataFrame, features: Sequence[str], keep: Sequence[str] = ()) -> DataFrame:
    """The columns a model was trained on: missing ones null, others dropped, all as doubles."""
    have = set(table.columns)
    return table.select(*keep, *((F.col(c).cast("double") if c in have else F.lit(None).cast("double")).alias(c) for c in features))


def coerced(table: DataFrame) -> DataFrame:
    """Every column as a number; what isn't one is 0."""
    return table.select(*(F.coalesce(numeric(F.col(c)), F.lit(0.0)).alias(c) for c in table.columns))


def shape(table: DataFrame) -> DataFrame:
    """Rows, duplicate rows and missing values."""
    missing = sum((numeric(F.col(c)).isNull().cast("long") for c in table.columns), F.lit(0))
    per_row = table.groupBy(*table.columns).agg(F.count("*").alias("_n")).withColumn("_m", missing)
    return per_row.agg(F.coalesce(F.sum("_n"), F.lit(0)).alias("rows"), F.coalesce(F.sum(F.col("_n") - 1), F.lit(0)).alias("duplicate_rows"), F.coalesce(F.sum(F.col("_n") * F.col("_m")), F.lit(0)).alias("missing_values"))


def ranges(table: DataFrame) -> DataFrame:
    """``feature, least, largest``: one row per column, from one aggregate."""
    stats = table.agg(*(f(F.col(c).cast("double")).alias(f"{n}_{i}") for i, c in enumerate(table.columns) for n, f in (("lo", F.min), ("hi", F.max))))
    rows = F.array(*(F.struct(F.lit(c).alias("feature"), F.col(f"lo_{i}").alias("least"), F.col(f"hi_{i}").alias("largest")) for i, c in enumerate(table.columns)))
    return stats.select(F.explode(rows).alias("r")).select("r.*")


def constant_features(table: DataFrame) -> list[str]:
    return [r["feature"] for r in ranges(table).where("least = largest or least is null").collect()]


def top_shares(table: DataFrame) -> DataFrame:
    """``feature, top_share``: share of the commonest value of each column; one shuffle of counts."""
    pairs = F.explode(F.array(*(F.struct(F.lit(c).alias("feature"), F.col(c).cast("double").alias("value")) for c in table.columns)))
    counts = table.select(pairs.alias("p")).groupBy("p.feature", "p.value").agg(F.count("*").alias("n"))
    return counts.groupBy("feature").agg((F.max("n") / F.sum("n")).alias("top_share"))


def near_constant_features(table: DataFrame, share: float = 0.995) -> list[str]:
    """Columns one value of which, null counting as one, has more than ``share`` of the rows.

    A value with well over half of the rows is the median, which a rough
    percentile finds with certainty, so its rows are counted without a shuffle
    of all values.
    """
    if share < 0.75:
        return [r["feature"] for r in top_shares(table).where(F.col("top_share") > share).collect()]
    columns = [(c, F.col(c).cast("double")) for c in table.columns]
    if not columns:
        return []
    middle = table.agg(*(F.percentile_approx(v, F.lit(0.5), F.lit(100)).alias(f"m{i}") for i, (_, v) in enumerate(columns))).first()
    known = lambda i, v: F.count_if(v == F.lit(middle[f"m{i}"])) if middle[f"m{i}"] is not None else F.lit(0)
    counts = table.agg(F.count("*").alias("n"), *(F.greatest(known(i, v), F.count_if(v.isNull())).alias(f"c{i}") for i, (_, v) in enumerate(columns))).first()
    return [c for i, (c, _) in enumerate(columns) if counts["n"] and counts[f"c{i}"] / counts["n"] > share]


def correlations(table: DataFrame) -> DataFrame:
    """``a, b, r`` for each pair of columns in their order."""
    vectors = VectorAssembler(inputCols=table.columns, outputCol="v").transform(table).select("v")
    matrix = Correlation.corr(vectors, "v").first()[0].toArray()
    rows = [(table.columns[i], table.columns[j], float(matrix[i, j])) for j in range(len(table.columns)) for i in range(j)]
    return table.sparkSession.createDataFrame(rows, "a string, b string, r double")


def correlated_features(table: DataFrame, most: float = 0.95) -> list[str]:
    """Columns that correlate too much with any column before them."""
    found = {r["b"] for r in correlations(table).where(~F.isnan("r") & (F.abs("r") > most)).select("b").distinct().collect()}
    return [c for c in table.columns if c in found]


def prune(table: DataFrame, share: float = 0.995, correlation: float = 0.95) -> tuple[DataFrame, dict[str, list[str]]]:
    """The table as numbers without constant, near-constant and correlated columns, and what went at each step."""
    out, dropped = coerced(table), {}
    for step, find in (("constant", constant_features), ("near_constant", lambda t: near_constant_features(t, share)), ("correlated", lambda t: correlated_features(t, correlation))):
        dropped[step] = find(out)
        out = out.drop(*dropped[step])
    return out, dropped


def value_counts(table: DataFrame, column: str, limit: int) -> DataFrame:
    """``value, n`` of the commonest values, nulls included; ties by value."""
    return table.groupBy(F.col(column).alias("value")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), F.asc_nulls_last("value")).limit(limit)
