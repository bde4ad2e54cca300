"""Scores of classifiers from predictions alone."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.plans.series import Axis, running, total


def confusion_counts(df: DataFrame, truth: str = "y_true", predicted: str = "y_pred") -> DataFrame:
    """Rows (y_true, y_pred, n); the only pass over the predictions."""
    return df.groupBy(F.col(truth).alias("y_true"), F.col(predicted).alias("y_pred")).agg(F.count(F.lit(1)).alias("n"))


def confusion_matrix(df: DataFrame, classes: Sequence[int] = (0, 1, 2), truth: str = "y_true", predicted: str = "y_pred") -> DataFrame:
    """One row per true class, one column per predicted class."""
    columns = [F.count_if(F.col(predicted) == c).alias(f"pred_{c}") for c in classes]
    return df.groupBy(F.col(truth).alias("y_true")).agg(*columns)


def _ratio(a: Column, b: Column) -> Column:
    return F.coalesce(a / F.nullif(b, F.lit(0)), F.lit(0.0))


def class_report(df: DataFrame, truth: str = "y_true", predicted: str = "y_pred") -> DataFrame:
    """precision, recall, F1 and support per class; 0 where undefined."""
    counts = confusion_counts(df, truth, predicted)
    sides = counts.select(
        F.inline(
            F.array(
                F.struct(F.col("y_true").alias("label"), F.col("n").alias("support"), F.lit(0).cast("bigint").alias("chosen"), F.when(F.col("y_true") == F.col("y_pred"), F.col("n")).otherwise(0).alias("hit")),
                F.struct(F.col("y_pred").alias("label"), F.lit(0).cast("bigint").alias("support"), F.col("n").alias("chosen"), F.lit(0).cast("bigint").alias("hit")),
            )
        )
    )
    sums = sides.groupBy("label").agg(F.sum("support").alias("support"), F.sum("chosen").alias("_chosen"), F.sum("hit").alias("_hit"))
    rates = sums.withColumns({"precision": _ratio(F.col("_hit"), F.col("_chosen")), "recall": _ratio(F.col("_hit"), F.col("support"))})
    f1 = _ratio(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall"))
    return rates.withColumn("f1", f1).select("label", "precision", "recall", "f1", "support")


def evaluate(df: DataFrame, truth: str = "y_true", predicted: str = "y_pred") -> DataFrame:
    """One row: accuracy and precision, recall, F1 weighted by the true classes' support."""
    report = class_report(df, truth, predicted)
    n = F.sum("support")

    def weighted(c: str) -> Column:
        return (F.sum(F.col(c) * F.col("support")) / n).alias(c)

    # Recall weighted by support is the share of hits.
    return report.agg(weighted("precision"), weighted("recall"), weighted("f1"), n.alias("rows")).select(
        F.col("recall").alias("accuracy"), "precision", "recall", F.col("f1").alias("f1_score"), "rows"
    )


def auc_by_class(df: DataFrame, scores: Sequence[str], truth: str = "y_true") -> DataFrame:
    """One-vs-rest area under the curve per class from rank sums, equal scores sharing their mean rank.

    Scores are counted per distinct value and ranked in parts of like numbers of values.
    """
    entries = [
        F.struct(F.lit(i).alias("label"), F.col(c).cast("double").alias("score"), (F.col(truth) == i).cast("bigint").alias("hit"))
        for i, c in enumerate(scores)
    ]
    long = df.select(F.inline(F.array(*entries)))
    counts = long.groupBy("label", "score").agg(F.count(F.lit(1)).alias("c"), F.sum("hit").alias("hits"))
    ranked = running(counts, Axis(keys=("label",), ts="score", cell=None), _upto=total("c"))
    mean_rank = F.col("_upto") - F.col("c") + (F.col("c") + 1) / 2
    sums = ranked.groupBy("label").agg(
        F.sum(F.col("hits") * mean_rank).alias("_ranks"), F.sum("hits").alias("_p"), F.sum(F.col("c") - F.col("hits")).alias("_n")
    )
    p, n = F.col("_p"), F.col("_n")
    area = (F.col("_ranks") - p * (p + 1) / 2) / F.nullif(p.cast("double") * n, F.lit(0.0))
    return sums.select("label", area.alias("auc"))


def auc_ovr(df: DataFrame, scores: Sequence[str], truth: str = "y_true") -> DataFrame:
    """The plain mean over classes; 0 when a class is missing."""
    per_class = auc_by_class(df, scores, truth)
    mean = F.when(F.count("auc") == len(scores), F.avg("auc")).otherwise(0.0)
    return per_class.agg(mean.alias("auc"))


def neutral_f1(df: DataFrame, truth: str = "y_true", predicted: str = "y_pred", neutral: int = 1) -> DataFrame:
    """F1 of one class from three counts; 0 when it never occurs."""
    t, p = F.col(truth) == neutral, F.col(predicted) == neutral
    hit, wrong = F.count_if(t & p), F.count_if(t != p)
    return df.agg(_ratio(2 * hit, 2 * hit + wrong).alias("neutral_f1"))
