"""Two-tier detection: rules over given or predicted scores."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cipherlake.functions.expr import alert_level, weighted_mean
from cipherlake.operators import metrics


@dataclass(frozen=True)
class Rules:
    """Thresholds and weights of the second tier."""

    thresholds: Mapping[str, float] = field(default_factory=lambda: {"random_forest": 0.5, "gradient_boosting": 0.5})
    weights: Mapping[str, float] = field(default_factory=dict)
    consensus: float = 0.5
    passes: int = 2


def apply_rules(scored: DataFrame, rules: Rules = Rules()) -> DataFrame:  # noqa: B008
    """Adds the second tier's passes, consensus and the alert level to ``tier1_pass`` and ``<model>_probability`` columns.

    Rows that the first tier stops have null scores and don't pass.  A row
    passes the second tier by enough models or by the weighted mean score; with
    no model the second tier passes what the first does.
    """
    models = list(rules.thresholds)
    first = F.coalesce("tier1_pass", F.lit(False))
    out = scored.withColumn("tier1_pass", first)
    if not models:
        out = out.withColumns({"tier2_pass_count": F.lit(0), "tier2_consensus_score": F.lit(None).cast("double"), "tier2_consensus_pass": F.lit(False), "tier2_pass": F.col("tier1_pass")})
        return out.withColumn("alert_level", F.when(F.col("tier2_pass"), "medium").otherwise("none"))
    passed = {m: F.coalesce(F.col("tier1_pass") & (F.col(f"{m}_probability") >= t), F.lit(False)) for m, t in rules.thresholds.items()}
    out = out.withColumns({f"{m}_pass": p for m, p in passed.items()})
    mean = weighted_mean([F.col(f"{m}_probability") for m in models], [rules.weights.get(m, 1.0) for m in models])
    out = out.withColumns({"tier2_pass_count": sum((F.col(f"{m}_pass").cast("int") for m in models), F.lit(0)), "tier2_consensus_score": F.when(F.col("tier1_pass"), mean)})
    enough = F.col("tier2_pass_count") >= min(rules.passes, len(models))
    agreed = F.coalesce(F.col("tier2_consensus_score") >= rules.consensus, F.lit(False))
    out = out.withColumns({"tier2_consensus_pass": agreed, "tier2_pass": F.col("tier1_pass") & (enough | agreed)})
    return out.withColumn("alert_level", alert_level(F.col("tier1_pass"), F.col("tier2_pass"), F.col("tier2_pass_count"), len(models), F.col("tier2_consensus_score")))


def score_tiers(table: DataFrame, first: Callable[[DataFrame], DataFrame], threshold: float, second: Mapping[str, Callable[[DataFrame], DataFrame]], rules: Rules) -> DataFrame:
    """Scores rows with the first model, and only the rows it passes with the others; then applies the rules.

    ``first`` and each of ``second`` add the column ``probability``.  The two
    parts are scored apart and put together again, so the models of the second
    tier never see a row that was stopped.
    """
    tier1 = first(table).withColumnRenamed("probability", "tier1_probability").withColumn("tier1_pass", F.coalesce(F.col("tier1_probability") >= threshold, F.lit(False)))
    deep = tier1.where("tier1_pass")
    for name, model in second.items():
        deep = model(deep).withColumnRenamed("probability", f"{name}_probability")
    return apply_rules(tier1.where("not tier1_pass").unionByName(deep, allowMissingColumns=True), rules)


def candidates(tiered: DataFrame) -> DataFrame:
    return tiered.where("tier1_pass")


def suspicious(tiered: DataFrame) -> DataFrame:
    return tiered.where("tier2_pass")


def stage_metrics(tiered: DataFrame, y: str = "label_id") -> DataFrame:
    """Metrics of both tiers, one row each; a row without consensus counts as score 0."""
    out = None
    for stage, passed, score in (("tier1", "tier1_pass", F.col("tier1_probability")), ("tier2", "tier2_pass", F.coalesce("tier2_consensus_score", F.lit(0.0)))):
        rows = tiered.select(F.col(y).alias("y"), F.col(passed).alias("said"), score.alias("score"))
        one = metrics.binary_metrics(rows, "y", F.col("said")).withColumn("stage", F.lit(stage)).join(metrics.ranking_metrics(rows, "y", "score").withColumn("stage", F.lit(stage)), "stage")
        out = one if out is None else out.union(one)
    return out


def stage_rates(tiered: DataFrame) -> DataFrame:
    """Rows, passes and pass rates of both tiers."""
    share = lambda c: F.coalesce(F.avg(F.col(c).cast("int")), F.lit(0.0))
    return tiered.agg(F.count("*").alias("rows"), F.count_if(F.col("tier1_pass")).alias("candidates"), F.count_if(F.col("tier2_pass")).alias("suspicious"), share("tier1_pass").alias("candidate_rate"), share("tier2_pass").alias("suspicious_rate"))


def top_strings(rows: DataFrame, keys: Sequence[str], value: str, k: int, name: str) -> DataFrame:
    """``keys`` and the ``k`` commonest values of each group in order; ties by value; nulls don't count."""
    counts = rows.where(F.col(value).isNotNull()).groupBy(*keys, F.col(value).cast("string").alias("_v")).agg(F.count("*").alias("_c"))
    ranked = counts.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("_c"), "_v"))).where(F.col("_n") <= k)
    return ranked.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("_n", "_v"))), lambda x: x["_v"]).alias(name))
