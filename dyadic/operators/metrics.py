"""Ranking and threshold metrics of scored, labelled rows, per task, exact under ties.

Rows are first counted by task and score, so curves are as long as the distinct scores; running sums over them
are spread over partitions.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from dyadic.functions.numeric import confusion_measures, ratio
from dyadic.operators.ordering import running


def curve(df: DataFrame, by: Sequence[str], score: str, label: str) -> DataFrame:
    """by, score, pos and neg of each distinct score, tp and n from the highest score down, and all_pos, all_neg."""
    y = F.col(label).cast("int")
    points = df.where(F.col(score).isNotNull() & F.col(label).isNotNull()).groupBy(*by, F.col(score).alias("score")).agg(F.sum(y).alias("pos"), F.sum(1 - y).alias("neg"))
    run = running(points, list(by), [F.col("score").desc()], {"tp": F.col("pos"), "fp": F.col("neg")})
    totals = points.groupBy(*by).agg(F.sum("pos").alias("all_pos"), F.sum("neg").alias("all_neg"))
    return run.join(totals, list(by)).withColumn("n", F.col("tp") + F.col("fp"))


def ranking_metrics(df: DataFrame, by: Sequence[str], score: str, label: str) -> DataFrame:
    """average_precision, pr_auc (trapezoids), auroc (null with one class) and best_f1 with its threshold."""
    c = curve(df, by, score, label)
    precision, recall = F.col("tp") / F.col("n"), ratio(F.col("tp"), F.col("all_pos"))
    before_n, before_tp = F.col("n") - F.col("pos") - F.col("neg"), F.col("tp") - F.col("pos")
    before = F.when(before_n == 0, 1.0).otherwise(before_tp / F.when(before_n != 0, before_n))
    step = ratio(F.col("pos"), F.col("all_pos"))
    f1 = ratio(2 * precision * recall, precision + recall)
    wins = F.col("neg") * (F.col("tp") - F.col("pos") / 2)
    out = c.groupBy(*by).agg(
        F.sum(step * precision).alias("average_precision"),
        F.sum(step * (precision + before) / 2).alias("pr_auc"),
        (F.sum(wins) / F.max(F.when((F.col("all_pos") > 0) & (F.col("all_neg") > 0), F.col("all_pos") * F.col("all_neg")))).alias("auroc"),
        F.max(f1).alias("best_f1"),
        F.max_by("score", F.struct(f1, -F.col("score"))).alias("best_threshold"),
        F.max("all_pos").alias("n_pos"),
        F.max("all_neg").alias("n_neg"),
    )
    return out


def threshold_metrics(df: DataFrame, by: Sequence[str], score: str, label: str, threshold: float) -> DataFrame:
    """Confusion counts at score > threshold and the measures that follow from them."""
    hit, true = F.col(score) > threshold, F.col(label).cast("boolean")
    counts = df.groupBy(*by).agg(F.count_if(hit & true).alias("tp"), F.count_if(hit & ~true).alias("fp"), F.count_if(~hit & true).alias("fn"), F.count_if(~hit & ~true).alias("tn"))
    return counts.withColumns(confusion_measures(*(F.col(c) for c in ("tp", "fp", "fn", "tn"))))


def precision_at(df: DataFrame, by: Sequence[str], score: str, label: str, ids: Sequence[str], ks: Sequence[int]) -> DataFrame:
    """by, k and the share of true labels among the min(k, n) best; ties go by ids."""
    rows = df.where(F.col(score).isNotNull() & F.col(label).isNotNull()).select(*by, *ids, F.col(score).alias("_s"), F.col(label).cast("int").alias("_y"))
    # the limit is applied to each group before the shuffle, too
    place = F.row_number().over(Window.partitionBy(*by).orderBy(F.col("_s").desc(), *map(F.col, ids)))
    top = rows.withColumn("_rank", place).where(F.col("_rank") <= max(ks))
    at = top.withColumn("k", F.explode(F.array(*map(F.lit, ks)))).where("_rank <= k")
    return at.groupBy(*by, "k").agg(F.avg("_y").alias("precision_at_k"))


def ensemble_mean(long: DataFrame, keys: Sequence[str], score: str, out: str = "mean_score") -> DataFrame:
    """Mean over models, poolings, orders or folds, whatever else the rows differ in."""
    return long.groupBy(*keys).agg(F.avg(score).alias(out), F.count("*").alias("n_scores"))


def fold_average(scored: DataFrame, keys: Sequence[str], fold: str, own_fold: str, score: str) -> DataFrame:
    """keys, out_of_fold (the score of the model of the row's own fold) and fold_mean (the mean over all folds' models)."""
    own = F.max(F.when(F.col(fold) == F.col(own_fold), F.col(score)))
    return scored.groupBy(*keys).agg(own.alias("out_of_fold"), F.avg(score).alias("fold_mean"))


def ablation(scored: DataFrame, task: str, variants: Sequence[str], score: str, label: str, threshold: float) -> DataFrame:
    """Ranking and threshold metrics of every task and variant (such as a pooling), one row each."""
    by = [task, *variants]
    return ranking_metrics(scored, by, score, label).join(threshold_metrics(scored, by, score, label, threshold), by)


def delta(metrics: DataFrame, baseline: DataFrame, on: Sequence[str], value: str) -> DataFrame:
    """metrics with the baseline's value and the difference; null where there is no baseline."""
    base = baseline.select(*on, F.col(value).alias(f"baseline_{value}"))
    return metrics.join(base, list(on), "left").withColumn("delta", F.col(value) - F.col(f"baseline_{value}"))


def best_checkpoints(df: DataFrame, by: Sequence[str], checkpoint: str, score: str, k: int) -> DataFrame:
    """Of each mode the k checkpoints with the best score; a checkpoint counts once, with its best."""
    best = df.groupBy(*by, checkpoint).agg(F.max(score).alias(score))
    return best.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(F.col(score).desc(), F.col(checkpoint)))).where(F.col("rank") <= k).withColumn("rank", F.col("rank").cast("long"))


def stacked(df: DataFrame, features: Sequence[str], label: str, penalties: Sequence[float] = (0.01, 0.1, 1.0), k: int = 5, seed: int = 63) -> DataFrame:
    """df with stacked_score: logistic regression with an L2 penalty over several scores, chosen by k-fold AUROC."""
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.evaluation import BinaryClassificationEvaluator
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.functions import vector_to_array
    from pyspark.ml.tuning import CrossValidator, ParamGridBuilder

    regression = LogisticRegression(featuresCol="_features", labelCol="_label", maxIter=50)
    rows = df.withColumn("_label", F.col(label).cast("double"))
    search = CrossValidator(estimator=Pipeline(stages=[VectorAssembler(inputCols=list(features), outputCol="_features"), regression]), estimatorParamMaps=ParamGridBuilder().addGrid(regression.regParam, list(penalties)).build(), evaluator=BinaryClassificationEvaluator(labelCol="_label"), numFolds=k, seed=seed)
    scored = search.fit(rows).transform(rows)
    return scored.select(*df.columns, vector_to_array("probability")[1].alias("stacked_score"))
