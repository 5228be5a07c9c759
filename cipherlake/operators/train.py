"""Training and evaluation of the binary classifiers."""

from __future__ import annotations

import math
from collections.abc import Callable, Mapping, Sequence
from functools import reduce

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier, NaiveBayes, RandomForestClassifier
from pyspark.ml.feature import Bucketizer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cipherlake.operators import metrics
from cipherlake.operators.ranking import dense_numbers
from cipherlake.plans.scratch import materialize

SEED, TEST_SHARE, FOLDS = 42, 0.2, 5
PERMUTATION_ROWS, REPEATS = 4_000, 5
#: Bins of a pass over values, and rows from which on the rest is counted by value.
BINS, FINISH = 1024, 50_000
#: Rows of a partition that a classifier learns from: least before more cores are used, and most (a forest keeps a count a tree with each row).
LEAST_ROWS, MOST_ROWS = 5_000, 100_000
#: Bins of a feature between which boosted trees choose, as many as Spark makes by default.
SPLITS = 32


def draw(key: str, seed: int) -> Column:
    """A reproducible random order of rows that every engine can compute."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(key).cast("string")))


def class_ranks(rows: DataFrame, label: str, key: str, seed: int) -> DataFrame:
    """Adds ``_rank`` (from 0) of each row in its class in random order, and ``_size`` of the class; rows without a class go.

    All rows are numbered by class and order, so no task ranks a whole class.
    """
    numbered = dense_numbers(rows.where(F.col(label).isNotNull()).withColumn("_d", draw(key, seed)), [label, "_d", key], "_n")
    classes = numbered.groupBy(label).agg(F.min("_n").alias("_b"), F.count("*").alias("_size"))
    return numbered.join(F.broadcast(classes), label).withColumn("_rank", F.col("_n") - F.col("_b")).drop("_d", "_n", "_b")


def stratified_split(rows: DataFrame, label: str, key: str, share: float = TEST_SHARE, seed: int = SEED) -> DataFrame:
    """Adds ``split``: the same share of each class is ``test``, by random order."""
    ranked = class_ranks(rows, label, key, seed)
    return ranked.withColumn("split", F.when(F.col("_rank") < F.round(F.col("_size") * share), "test").otherwise("train")).drop("_rank", "_size")


def folds(rows: DataFrame, label: str, key: str, k: int = FOLDS, seed: int = SEED) -> DataFrame:
    """Adds ``fold`` from 0 to k - 1, with equal shares of each class."""
    return class_ranks(rows, label, key, seed).withColumn("fold", (F.col("_rank") % k).cast("int")).drop("_rank", "_size")


def uninformative(rows: DataFrame, features: Sequence[str]) -> list[str]:
    """Features with one value only, null counting as a value."""
    stats = rows.agg(*(f(c).alias(f"{n}_{i}") for i, c in enumerate(features) for n, f in (("lo", F.min), ("hi", F.max), ("n", F.count))), F.count("*").alias("all")).first()
    return [c for i, c in enumerate(features) if stats[f"n_{i}"] == 0 or (stats[f"n_{i}"] == stats["all"] and stats[f"lo_{i}"] == stats[f"hi_{i}"])]


def position(kind: str, value: Column, least: Column, most: Column) -> Column:
    """Place from 0 to 1 of a value between two others, evenly by size or by logarithm."""
    # Halves, so that no difference overflows.
    value, least, most = (F.signum(x) * F.log1p(F.abs(x)) if kind == "log" else x / 2 for x in (value, least, most))
    return F.coalesce(F.try_divide(value - least, most - least), F.lit(0.0))


def bins(value: Column, least: Column, most: Column, kind: str) -> Column:
    """Number of a value's bin, growing with the value: infinities and NaN have their own, at both ends."""
    inner = F.least(F.floor(position(kind, value, least, most) * BINS), F.lit(BINS - 1))
    return F.when(F.isnan(value), BINS + 1).when(value == float("inf"), BINS).when(value == float("-inf"), -1).otherwise(inner).cast("int")


def medians(rows: DataFrame, features: Sequence[str]) -> dict[str, float]:
    """Exact medians, nulls left out, NaN above all numbers; 0 for a column of nulls.

    All columns are narrowed together: one pass counts their values by bins
    between the least and largest that may be the median, and keeps the bins
    that hold the middle ranks.  Passes cut ranges by size and by logarithm in
    turn.  What is left is counted by value once it has at most ``FINISH`` rows,
    so neither a task nor the driver ever holds all values.
    """
    cells = F.array(*(F.struct(F.lit(i).alias("c"), F.col(c).cast("double").alias("v")) for i, c in enumerate(features)))
    values = rows.select(F.explode(cells).alias("x")).select("x.c", "x.v").where("v is not null")
    finite = F.when(~F.isnan("v") & (F.abs("v") < float("inf")), F.col("v"))
    first = {r["c"]: r for r in values.groupBy("c").agg(F.count("*").alias("n"), F.min(finite).alias("least"), F.max(finite).alias("most")).collect()}
    out = {c: 0.0 for c in features}
    # Of each open column: rows below its range, rows within, and the range.
    open_ = {i: (0, r["n"], r["least"] if r["least"] is not None else 0.0, r["most"] if r["most"] is not None else 0.0) for i, r in first.items()}
    unbounded = set(open_)
    kind = "log"
    spark = rows.sparkSession
    while open_:
        ranges = F.broadcast(spark.createDataFrame([(i, least, most, i in unbounded) for i, (_, _, least, most) in open_.items()], "c int, least double, most double, whole boolean"))
        inside = values.join(ranges, "c").where("whole or v between least and most")
        finish = sum(n for _, n, _, _ in open_.values()) <= FINISH
        by = F.col("v") if finish else bins(F.col("v"), F.col("least"), F.col("most"), kind)
        counts: dict[int, list] = {}
        for r in inside.groupBy("c", by.alias("bin")).agg(F.count("*").alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi")).collect():
            counts.setdefault(r["c"], []).append(r)
        for i, (below, _, *_) in list(open_.items()):
            ends = []
            for rank in ((first[i]["n"] - 1) // 2, first[i]["n"] // 2):
                at = below
                for r in sorted(counts[i], key=lambda r: (math.isnan(r["hi"]), r["hi"])):
                    if rank < at + r["n"]:
                        ends.append((at, r))
                        break
                    at += r["n"]
            (at, a), (_, b) = ends
            if a is b and a["lo"] != a["hi"] and not math.isnan(a["hi"]):
                open_[i] = (at, a["n"], a["lo"], a["hi"])
            else:
                # Both ranks have one value, or the lower ends a bin and the upper begins the next.
                out[features[i]] = a["hi"] if a is b else a["hi"] / 2 + b["lo"] / 2
                del open_[i]
        unbounded.clear()
        kind = "even" if kind == "log" else "log"
    return out


def impute(rows: DataFrame, values: Mapping[str, float]) -> DataFrame:
    return rows.withColumns({c: F.coalesce(F.col(c).cast("double"), F.lit(float(v))) for c, v in values.items()})


def estimators(weight: str = "_weight", trees: int = 300, rounds: int = 200) -> dict[str, Callable[[], object]]:
    """The three classifiers; the forest weighs the classes equally over all its trees."""
    common = {"featuresCol": "_features", "labelCol": "_y"}
    return {
        "gaussian_nb": lambda: NaiveBayes(modelType="gaussian", **common),
        "random_forest": lambda: RandomForestClassifier(numTrees=trees, weightCol=weight, seed=SEED, **common),
        "gradient_boosting": lambda: GBTClassifier(maxIter=rounds, stepSize=0.05, maxDepth=3, lossType="logistic", seed=SEED, **common),
    }


def prepared(rows: DataFrame, label: str) -> DataFrame:
    """Adds the label as a double and weights that make the classes equal, and deals the rows evenly over the cores.

    Learning goes over its input hundreds of times in the partitions it is
    given, which for one file or row group would be one task.
    """
    of = {r[label]: r["n"] for r in rows.groupBy(label).agg(F.count("*").alias("n")).collect()}
    total = sum(of.values())
    weights = F.coalesce(*(F.when(F.col(label) == k, F.lit(total / (len(of) * n))) for k, n in of.items() if k is not None), F.lit(1.0))
    return dealt(rows.withColumns({"_y": F.col(label).cast("double"), "_weight": weights}), total)


def dealt(rows: DataFrame, total: int) -> DataFrame:
    cores = rows.sparkSession.sparkContext.defaultParallelism
    return rows.repartition(max(math.ceil(total / MOST_ROWS), min(cores, math.ceil(total / LEAST_ROWS)), 1))


def borders(rows: DataFrame, features: Sequence[str], most: int = SPLITS) -> list[list[float]]:
    """Where the bins of each feature meet: midway between its values if these are at most ``most``, else at quantiles of all rows."""
    counts = rows.agg(*(F.approx_count_distinct(c).alias(f"c{i}") for i, c in enumerate(features))).first()
    cells = [F.struct(F.lit(i).alias("c"), F.col(c).cast("double").alias("v")) for i, c in enumerate(features) if counts[f"c{i}"] <= 2 * most]
    values: dict[int, set[float]] = {}
    if cells:
        for r in rows.select(F.explode(F.array(*cells)).alias("x")).select("x.c", "x.v").where("v is not null and not isnan(v)").distinct().collect():
            values.setdefault(r["c"], set()).add(r["v"])
    out = []
    quantiles = rows.approxQuantile(list(features), [k / most for k in range(1, most)], 0.001)
    for i, cuts in enumerate(quantiles):
        own = sorted(values.get(i, ()))
        if own and len(own) <= most:
            cuts = [m if math.isfinite(m := a / 2 + b / 2) else b if math.isfinite(b) else math.nextafter(a, b) for a, b in zip(own, own[1:])]
        # A bucketizer wants a border even where all values are one.
        out.append(sorted({x for x in cuts if math.isfinite(x)}) or [0.0])
    return out


def fit_boosted(rows: DataFrame, label: str, features: Sequence[str], estimator: GBTClassifier) -> PipelineModel:
    """A boosted model over binned features, learned from one weighted row for all rows that agree in label and bins.

    Boosted trees see nothing of a feature but its bin, and every row counts, so
    two hundred rounds go over combinations of bins, which grow far slower than
    rows.
    """
    bins = [f"_bin{i}" for i in range(len(features))]
    splits = [[-math.inf, *cuts, math.inf] for cuts in borders(rows, features)]
    stages = [Bucketizer(splitsArray=splits, inputCols=list(features), outputCols=bins, handleInvalid="keep"), VectorAssembler(inputCols=bins, outputCol="_features")]
    told = stages[0].transform(rows.select(F.col(label).cast("double").alias("_y"), *dict.fromkeys(features)))
    # Without the mark of a category, since bins are in order.
    told = told.select("_y", *(F.col(b).alias(b, metadata={}) for b in bins))
    grouped = materialize(told.groupBy("_y", *bins).agg(F.count("*").cast("double").alias("_weight")))
    learned = estimator.copy().setWeightCol("_weight").fit(stages[1].transform(dealt(grouped, grouped.count())))
    return PipelineModel([*stages, learned])


def fit(rows: DataFrame, label: str, features: Sequence[str], estimator: object) -> PipelineModel:
    """Model over imputed features; medians are learned from ``rows`` and go with the caller's tables."""
    if isinstance(estimator, GBTClassifier):
        return fit_boosted(rows, label, features, estimator)
    narrow = prepared(rows.select(*dict.fromkeys([label, *features])), label)
    return Pipeline(stages=[VectorAssembler(inputCols=list(features), outputCol="_features"), estimator]).fit(narrow)


def probability(model: PipelineModel, rows: DataFrame) -> DataFrame:
    """``rows`` with the column ``probability`` of class 1."""
    out = model.transform(rows)
    return out.withColumn("_p", vector_to_array(F.col("probability"))[1]).select(*rows.columns, F.col("_p").alias("probability"))


def out_of_fold(rows: DataFrame, label: str, key: str, features: Sequence[str], make: Callable[[], object], k: int = FOLDS) -> DataFrame:
    """``key, label, fold, score``: each row scored by a model that hasn't seen its fold."""
    dealt = materialize(folds(rows, label, key, k))
    out = None
    for i in range(k):
        train = dealt.where(F.col("fold") != i)
        values = medians(train, features)
        model = fit(impute(train, values), label, features, make())
        part = probability(model, impute(dealt.where(F.col("fold") == i), values)).select(key, label, "fold", F.col("probability").alias("score"))
        out = part if out is None else out.union(part)
    return out


def cross_validation(scores: DataFrame, label: str, by: Sequence[str] = (), threshold: float = 0.5) -> DataFrame:
    """``metric, mean, std`` over the folds of out-of-fold scores, of each segment ``by``; std is that of the population.

    All folds of all segments are scored at once.
    """
    folded = metrics.scorers(scores, label, "score", F.col("score") >= threshold, [*by, "fold"])
    pairs = folded.select(*by, F.explode(F.array(*(F.struct(F.lit(n).alias("metric"), F.col(n).alias("value")) for n in metrics.SCORERS))).alias("x")).select(*by, "x.*")
    return pairs.groupBy(*by, "metric").agg(F.avg("value").alias("mean"), F.stddev_pop("value").alias("std"))


def comparison(out_of_fold_scores: DataFrame, tested: DataFrame, thresholds: DataFrame, label: str) -> DataFrame:
    """One row a model: its threshold, each metric's mean and deviation over the folds, and on the hold-out at 0.5 and at the threshold.

    ``out_of_fold_scores (model, fold, label, score)`` and ``tested (model,
    label, score)`` hold the scores of all models, and ``thresholds`` has
    ``model, threshold_metric, selected_threshold``.
    """
    folded = cross_validation(out_of_fold_scores, label, ["model"])
    wide = folded.groupBy("model").agg(*(F.max(F.when(F.col("metric") == m, F.col(k))).alias(f"cv_{m}_{k}") for m in metrics.SCORERS for k in ("mean", "std")))
    known = tested.join(F.broadcast(thresholds.select("model", "selected_threshold")), "model")
    at = lambda name, said: metrics.scorers(known, label, "score", said, ["model"]).select("model", *(F.col(m).alias(f"test_{name}_{m}") for m in metrics.SCORERS))
    out = thresholds.join(wide, "model", "left").join(at("default", F.col("score") >= 0.5), "model", "left").join(at("optimized", F.col("score") >= F.col("selected_threshold")), "model", "left")
    return out.select(*thresholds.columns, *(f"{k}_{m}{e}" for m in metrics.SCORERS for k, e in (("cv", "_mean"), ("cv", "_std"), ("test_default", ""), ("test_optimized", ""))))


def native_importance(model: PipelineModel, features: Sequence[str], spark: SparkSession) -> DataFrame | None:
    """Importances of a tree model; None for others, for which :func:`metrics.mean_gap` serves."""
    last = model.stages[-1]
    if not hasattr(last, "featureImportances"):
        return None
    values = last.featureImportances.toArray()
    return spark.createDataFrame([(c, float(v)) for c, v in zip(features, values, strict=True)], "feature string, importance double").orderBy(F.desc("importance"), "feature")


def permutation_importance(model: PipelineModel, rows: DataFrame, label: str, key: str, features: Sequence[str], repeats: int = REPEATS, most: int = PERMUTATION_ROWS, seed: int = SEED) -> DataFrame:
    """``feature, importance_mean, importance_std``: loss of ROC-AUC when a feature's values are exchanged between rows.

    A stratified sample of at most about ``most`` rows is scored once as it is
    and, in one frame, once for each (feature, repeat).
    """
    n = rows.count()
    ranked = class_ranks(rows, label, key, seed).where(F.col("_rank") < F.ceil(F.col("_size") * min(1.0, most / max(n, 1)))).drop("_rank", "_size")
    # Bounded by ``most``: both orders are numbered on the sample alone.
    sample = materialize(ranked.withColumn("_i", F.row_number().over(Window.orderBy(key))))
    tried = F.explode(F.array(*(F.struct(F.lit(f).alias("feature"), F.lit(r).alias("repeat")) for f in features for r in range(repeats))))
    shuffled = sample.select("_i", *features, tried.alias("t")).select("_i", *features, "t.*")
    order = Window.partitionBy("feature", "repeat").orderBy(F.md5(F.concat_ws(":", "feature", "repeat", F.lit(str(seed)), "_i")))
    values = F.coalesce(*(F.when(F.col("feature") == c, F.col(c).cast("double")) for c in features))
    donor = shuffled.select("feature", "repeat", F.row_number().over(order).alias("_i"), values.alias("_v"))
    mixed = sample.join(donor, "_i").withColumns({c: F.when(F.col("feature") == c, F.col("_v")).otherwise(F.col(c).cast("double")) for c in features})
    base = metrics.ranking_metrics(probability(model, sample), label, "probability").first()["roc_auc"]
    scored = probability(model, mixed.select("feature", "repeat", label, *features))
    counts = scored.groupBy("feature", "repeat", F.col("probability").alias("s")).agg(F.count_if(F.col(label) == 1).alias("p"), F.count_if(F.col(label) != 1).alias("n"))
    own = Window.partitionBy("feature", "repeat").orderBy(F.desc("s")).rowsBetween(Window.unboundedPreceding, 0)
    auc = counts.withColumn("tp", F.sum("p").over(own)).groupBy("feature", "repeat").agg((F.sum(F.col("n") * (F.col("tp") - F.col("p") / 2)) / (F.sum("p") * F.sum("n"))).alias("auc"))
    return auc.groupBy("feature").agg(F.avg(F.lit(base) - F.col("auc")).alias("importance_mean"), F.stddev_pop("auc").alias("importance_std"))


def evaluate(test: DataFrame, model: PipelineModel, label: str, key: str, threshold: float) -> dict[str, DataFrame]:
    """Hold-out predictions and their metrics at 0.5 and at the chosen threshold."""
    scored = probability(model, test).select(key, F.col(label).alias("y"), F.col("probability").alias("score"))
    predictions = scored.withColumns({"predicted": (F.col("score") >= 0.5).cast("int"), "predicted_optimized": (F.col("score") >= threshold).cast("int")})
    return {
        "predictions": predictions,
        "default": metrics.binary_metrics(scored, "y", F.col("score") >= 0.5),
        "optimized": metrics.binary_metrics(scored, "y", F.col("score") >= threshold),
        "ranking": metrics.ranking_metrics(scored, "y", "score"),
        "curves": metrics.curves(scored, "y", "score"),
    }


def run(rows: DataFrame, label: str, key: str, features: Sequence[str], path: str | None = None, models: Mapping[str, Callable[[], object]] | None = None, metric: str = "f1") -> DataFrame:
    """Trains and compares the classifiers; saves each with its features, medians and threshold under ``path``.

    The result is that of :func:`comparison`, best optimised F1 first.
    """
    spark = rows.sparkSession
    split = materialize(stratified_split(rows, label, key))
    train, test = split.where("split = 'train'"), split.where("split = 'test'")
    used = [c for c in features if c not in uninformative(train, features)]
    values = medians(train, used)
    folded, tested, chosen = [], [], []
    for name, make in (models or estimators()).items():
        scores = materialize(out_of_fold(train, label, key, used, make))
        best = metrics.best_threshold(metrics.threshold_sweep(scores, label, "score"), metric).first()
        model = fit(impute(train, values), label, used, make())
        folded.append(scores.select(F.lit(name).alias("model"), "fold", label, "score"))
        tested.append(probability(model, impute(test, values)).select(F.lit(name).alias("model"), label, F.col("probability").alias("score")))
        chosen.append((name, metric, float(best["threshold"])))
        if path:
            model.write().overwrite().save(f"{path}/{name}/model")
            manifest = spark.createDataFrame([(name, used, values, float(best["threshold"]))], "model string, features array<string>, medians map<string,double>, threshold double")
            manifest.coalesce(1).write.mode("overwrite").json(f"{path}/{name}/manifest")
    thresholds = spark.createDataFrame(chosen, "model string, threshold_metric string, selected_threshold double")
    compared = comparison(reduce(DataFrame.union, folded), materialize(reduce(DataFrame.union, tested)), thresholds, label)
    return compared.orderBy(F.desc_nulls_last("test_optimized_f1"), "model")


def load(spark: SparkSession, path: str, name: str, override: float | None = None, optimized: bool = True) -> tuple[Callable[[DataFrame], DataFrame], float]:
    """A saved model as a function that adds ``probability``, and its threshold (its own, 0.5 or the given one)."""
    manifest = spark.read.schema("model string, features array<string>, medians map<string,double>, threshold double").json(f"{path}/{name}/manifest").first()
    model = PipelineModel.load(f"{path}/{name}/model")
    features, values = manifest["features"], manifest["medians"]

    def score(rows: DataFrame) -> DataFrame:
        own = {f"_in_{c}": F.col(c).cast("double") if c in rows.columns else F.lit(None).cast("double") for c in features}
        wide = rows.withColumns(own)
        keep = [F.col(c) for c in rows.columns if c not in features]
        ready = wide.select(*keep, *(F.coalesce(F.col(f"_in_{c}"), F.lit(values[c])).alias(c) for c in features), F.struct(*(F.col(c) for c in rows.columns)).alias("_row"))
        return probability(model, ready).select("_row.*", "probability")

    return score, override if override is not None else manifest["threshold"] if optimized else 0.5
