"""Binary metrics over a table of ``(y, score)``, each from grouped counts."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cipherlake.operators.ranking import sums_before
from cipherlake.plans.scratch import materialize, small

#: Steps of the threshold sweep.
STEPS = 200
#: What models are compared by.
SCORERS = ("accuracy", "precision", "recall", "f1", "specificity", "balanced_accuracy", "roc_auc", "average_precision")


def ratio(a: Column, b: Column) -> Column:
    """a / b, 0 where b is."""
    return F.coalesce(F.try_divide(a, b), F.lit(0.0))


def rates(counts: DataFrame) -> DataFrame:
    """Adds the usual rates to ``tp, fp, tn, fn``."""
    tp, fp, tn, fn = (F.col(c) for c in ("tp", "fp", "tn", "fn"))
    recall, specificity = ratio(tp, tp + fn), ratio(tn, tn + fp)
    return counts.withColumns(
        {
            "accuracy": ratio(tp + tn, tp + fp + tn + fn),
            "precision": ratio(tp, tp + fp),
            "recall": recall,
            "f1": ratio(2 * tp, 2 * tp + fp + fn),
            "specificity": specificity,
            "balanced_accuracy": (recall + specificity) / 2,
        }
    )


def confusion(rows: DataFrame, y: str, predicted: Column) -> DataFrame:
    """``tp, fp, tn, fn`` in one row."""
    positive, said = F.col(y) == 1, F.coalesce(predicted, F.lit(False))
    return rows.agg(F.count_if(positive & said).alias("tp"), F.count_if(~positive & said).alias("fp"), F.count_if(~positive & ~said).alias("tn"), F.count_if(positive & ~said).alias("fn"))


def binary_metrics(rows: DataFrame, y: str, predicted: Column) -> DataFrame:
    return rates(confusion(rows, y, predicted))


def threshold_sweep(rows: DataFrame, y: str, score: str, steps: int = STEPS) -> DataFrame:
    """Rates at each threshold ``i / steps``: scores are counted by the last threshold they reach, then summed from above."""
    step = 1.0 / steps
    # The thresholds are products, so the same literals compare alike everywhere.
    reached = F.size(F.filter(F.transform(F.sequence(F.lit(0), F.lit(steps)), lambda i: i * F.lit(step)), lambda t: F.col(score) >= t))
    known = rows.where(F.col(y).isNotNull())
    hist = known.groupBy(F.coalesce(reached, F.lit(0)).alias("k")).agg(F.count_if(F.col(y) == 1).alias("p"), F.count_if(F.col(y) != 1).alias("n"))
    grid = rows.sparkSession.range(0, steps + 2).select(F.col("id").cast("int").alias("k"))
    full = grid.join(F.broadcast(hist), "k", "left").na.fill(0, ["p", "n"])
    # At most steps + 2 rows from here on.
    above = Window.orderBy(F.desc("k")).rowsBetween(Window.unboundedPreceding, 0)
    whole = Window.partitionBy()
    cumulated = full.withColumns({"tp": F.sum("p").over(above), "fp": F.sum("n").over(above), "all_p": F.sum("p").over(whole), "all_n": F.sum("n").over(whole)})
    counts = cumulated.where("k > 0").select(((F.col("k") - 1) * F.lit(step)).alias("threshold"), "tp", "fp", (F.col("all_n") - F.col("fp")).alias("tn"), (F.col("all_p") - F.col("tp")).alias("fn"))
    return rates(counts)


def best_threshold(sweep: DataFrame, metric: str = "f1") -> DataFrame:
    """The threshold with the best metric; ties by precision, balanced accuracy, recall, then the lowest threshold."""
    order = [F.desc(metric), F.desc("precision"), F.desc("balanced_accuracy"), F.desc("recall"), F.asc("threshold")]
    return sweep.orderBy(*order).limit(1).select("threshold", F.lit(metric).alias("metric"), F.col(metric).alias("metric_value"), "precision", "recall", "f1", "balanced_accuracy")


def cumulated(rows: DataFrame, y: str, score: str, by: Sequence[str] = ()) -> DataFrame:
    """``score, p, n, tp, fp`` at each distinct score, cumulated from the highest, by ranges of the score.

    With ``by`` the sums start anew in each segment.  All segments are summed in
    one pass over one order; what stands before a segment is taken off after.
    """
    known = rows.where(F.col(y).isNotNull() & F.col(score).isNotNull())
    counts = known.groupBy(*by, F.col(score).alias("score")).agg(F.count_if(F.col(y) == 1).alias("p"), F.count_if(F.col(y) != 1).alias("n"))
    order = F.struct(*by, (-F.col("score")).alias("_s")) if by else F.desc("score")
    points = sums_before(counts, order, {"_tp": "p", "_fp": "n"})
    if by:
        points = materialize(points)
        # One row a segment.
        starts = points.groupBy(*(F.col(c).alias(f"_{c}") for c in by)).agg(F.min("_tp").alias("_tp0"), F.min("_fp").alias("_fp0"))
        on = reduce(lambda a, b: a & b, (F.col(c).eqNullSafe(F.col(f"_{c}")) for c in by))
        points = points.join(small(materialize(starts)), on).withColumns({"_tp": F.col("_tp") - F.col("_tp0"), "_fp": F.col("_fp") - F.col("_fp0")})
    return points.select(*by, "score", "p", "n", (F.col("p") + F.col("_tp")).alias("tp"), (F.col("n") + F.col("_fp")).alias("fp"))


def ranking_metrics(rows: DataFrame, y: str, score: str, by: Sequence[str] = ()) -> DataFrame:
    """``roc_auc`` (ties count half; null for one class) and ``average_precision`` (a step sum), of all rows or of each segment."""
    points = cumulated(rows, y, score, by)
    sums = points.groupBy(*by).agg(F.sum("p").alias("all_p"), F.sum("n").alias("all_n"), F.sum(F.col("n") * (F.col("tp") - F.col("p") / 2)).alias("won"), F.sum(F.col("p") * F.col("tp") / (F.col("tp") + F.col("fp"))).alias("steps"))
    return sums.select(*by, F.when((F.col("all_p") > 0) & (F.col("all_n") > 0), F.col("won") / (F.col("all_p") * F.col("all_n"))).alias("roc_auc"), ratio(F.col("steps"), F.col("all_p")).alias("average_precision"))


def scorers(rows: DataFrame, y: str, score: str, said: Column, by: Sequence[str]) -> DataFrame:
    """The eight metrics of ``SCORERS`` for each segment, in two aggregates over all of them."""
    positive, said = F.col(y) == 1, F.coalesce(said, F.lit(False))
    counts = rows.where(F.col(y).isNotNull()).groupBy(*by).agg(F.count_if(positive & said).alias("tp"), F.count_if(~positive & said).alias("fp"), F.count_if(~positive & ~said).alias("tn"), F.count_if(positive & ~said).alias("fn"))
    return rates(counts).join(ranking_metrics(rows, y, score, by), list(by), "left").select(*by, *SCORERS)


def curves(rows: DataFrame, y: str, score: str) -> DataFrame:
    """``threshold, fpr, tpr, precision, recall`` at each distinct score."""
    points = cumulated(rows, y, score)
    totals = rows.where(F.col(y).isNotNull() & F.col(score).isNotNull()).agg(F.count_if(F.col(y) == 1).alias("p"), F.count_if(F.col(y) != 1).alias("n")).first()
    positives, negatives = F.lit(totals["p"]), F.lit(totals["n"])
    return points.select(F.col("score").alias("threshold"), ratio(F.col("fp"), negatives).alias("fpr"), ratio(F.col("tp"), positives).alias("tpr"), ratio(F.col("tp"), F.col("tp") + F.col("fp")).alias("precision"), ratio(F.col("tp"), positives).alias("recall"))


def confusion_matrix(rows: DataFrame, y: str, predicted: Column) -> DataFrame:
    """``actual, predicted, n`` for the four cells, empty ones too."""
    counts = confusion(rows, y, predicted)
    cell = lambda a, p, n: F.struct(F.lit(a).alias("actual"), F.lit(p).alias("predicted"), F.col(n).alias("n"))
    return counts.select(F.explode(F.array(cell(0, 0, "tn"), cell(0, 1, "fp"), cell(1, 0, "fn"), cell(1, 1, "tp"))).alias("c")).select("c.*")


def classification_report(rows: DataFrame, y: str, predicted: Column) -> DataFrame:
    """``class, precision, recall, f1, support`` for both classes, their mean and their weighted mean."""
    c = confusion(rows, y, predicted)

    def one(name: str, hit: str, false: str, miss: str) -> Column:
        h, f, m = F.col(hit), F.col(false), F.col(miss)
        return F.struct(F.lit(name).alias("class"), ratio(h, h + f).alias("precision"), ratio(h, h + m).alias("recall"), ratio(2 * h, 2 * h + f + m).alias("f1"), (h + m).alias("support"))

    both = c.select(one("0", "tn", "fn", "fp").alias("a"), one("1", "tp", "fp", "fn").alias("b"))
    total = F.col("a.support") + F.col("b.support")
    mean = F.struct(F.lit("macro avg").alias("class"), *(((F.col(f"a.{k}") + F.col(f"b.{k}")) / 2).alias(k) for k in ("precision", "recall", "f1")), total.alias("support"))
    weighted = F.struct(F.lit("weighted avg").alias("class"), *(ratio(F.col(f"a.{k}") * F.col("a.support") + F.col(f"b.{k}") * F.col("b.support"), total).alias(k) for k in ("precision", "recall", "f1")), total.alias("support"))
    return both.select(F.explode(F.array(F.col("a"), F.col("b"), mean, weighted)).alias("r")).select("r.*")


def mean_gap(rows: DataFrame, y: str, features: list[str]) -> DataFrame:
    """``feature, importance``: distance of the class means over the root of the mean class variance."""
    positive = F.col(y) == 1
    stats = rows.agg(*(f(F.when(test, F.col(c).cast("double"))).alias(f"{n}{k}_{i}") for i, c in enumerate(features) for k, test in ((1, positive), (0, ~positive)) for n, f in (("m", F.avg), ("v", F.var_pop))))
    gap = lambda i: F.abs(F.col(f"m1_{i}") - F.col(f"m0_{i}")) / F.sqrt((F.col(f"v1_{i}") + F.col(f"v0_{i}")) / 2 + 1e-9)
    return stats.select(F.explode(F.array(*(F.struct(F.lit(c).alias("feature"), gap(i).alias("importance")) for i, c in enumerate(features)))).alias("r")).select("r.*")
