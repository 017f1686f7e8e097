"""Model evaluation: ROC, AUC, best threshold, class and regression errors.

Everything is computed from one aggregate of the scored rows by (group, score)
into positive/negative counts. Cumulative counts over distinct scores come from
the bucketed prefix sums of ``positions.cumulative_before`` (no single-task
window over all scores), so one pass gives, for every group:

* AUC with half credit for ties: sum_s pos(s) * (neg_below(s) + neg(s)/2) / (P*N);
* the ROC point of every threshold t = a distinct score, predicting 1 when score >= t:
  sensitivity = (P - pos_below)/P, specificity = neg_below/N;
* the threshold closest to the top-left corner (R ``coords(..., "best",
  best.method="closest.topleft")``) and the class error at it,
  (FP + FN)/n = ((N - neg_below) + pos_below)/n.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .positions import _cols, cumulative_before


def score_counts(df: DataFrame, score: str, label: str, by=None) -> DataFrame:
    by = _cols(by)
    return df.groupBy(*by, F.col(score).cast("double").alias("score")).agg(
        F.sum(F.col(label).cast("long")).alias("pos"),
        F.sum((F.lit(1) - F.col(label)).cast("long")).alias("neg"),
    )


def roc_points(df: DataFrame, score: str, label: str, by=None) -> DataFrame:
    """One ROC point per (group, distinct score): threshold, sensitivity,
    specificity and class error of the rule ``score >= threshold``."""
    by = _cols(by)
    c = cumulative_before(score_counts(df, score, label, by), "score", ["pos", "neg"], by)
    return c.select(
        *by,
        F.col("score").alias("threshold"),
        "pos", "neg",
        F.col("pos_before"), F.col("neg_before"),
        F.col("pos_total").alias("n_pos"), F.col("neg_total").alias("n_neg"),
        F.try_divide(F.col("pos_total") - F.col("pos_before"), F.col("pos_total")).alias("sensitivity"),
        F.try_divide(F.col("neg_before"), F.col("neg_total")).alias("specificity"),
        F.try_divide(
            (F.col("neg_total") - F.col("neg_before")) + F.col("pos_before"), F.col("pos_total") + F.col("neg_total")
        ).alias("class_error"),
    )


def evaluate_binary(df: DataFrame, score: str, label: str, by=None) -> DataFrame:
    """Per group ``auc, threshold, sensitivity, specificity,
    class_error, n`` with the threshold chosen closest to the top-left corner
    (ties: the lower threshold)."""
    by = _cols(by)
    r = roc_points(df, score, label, by)
    dist = (F.lit(1.0) - F.col("sensitivity")) ** 2 + (F.lit(1.0) - F.col("specificity")) ** 2
    r = r.withColumn("_d", dist).withColumn(
        "_auc_part", F.col("pos") * (F.col("neg_before") + F.col("neg") / 2.0)
    )
    best = F.min_by(
        F.struct("threshold", "sensitivity", "specificity", "class_error"), F.struct("_d", "threshold")
    )
    g = r.groupBy(*by).agg(
        F.try_divide(F.sum("_auc_part"), F.first("n_pos") * F.first("n_neg")).alias("auc"),
        best.alias("_b"),
        (F.first("n_pos") + F.first("n_neg")).cast("long").alias("n"),
    )
    return g.select(*by, "auc", "_b.threshold", "_b.sensitivity", "_b.specificity", "_b.class_error", "n")


def classification_error(df: DataFrame, pred: str, label: str, by=None) -> DataFrame:
    """Share of rows with ``pred != label`` (robust when one class is never predicted)."""
    by = _cols(by)
    return df.groupBy(*by).agg(
        F.avg((F.col(pred) != F.col(label)).cast("double")).alias("class_error"),
        F.count(F.lit(1)).alias("n"),
    )


def confusion_counts(df: DataFrame, pred: str, label: str, by=None) -> DataFrame:
    """Long-form confusion table ``(pred, label, n)``."""
    by = _cols(by)
    return df.groupBy(*by, pred, label).agg(F.count(F.lit(1)).alias("n"))


def regression_error(df: DataFrame, pred: str, target: str, by=None) -> DataFrame:
    """``mse = mean((pred-y)^2)`` and ``mean_abs_prop = mean(|pred-y|/pred)``
    (relative to the prediction, as in the study; pred = 0 rows are skipped)."""
    by = _cols(by)
    diff = F.col(pred).cast("double") - F.col(target).cast("double")
    return df.groupBy(*by).agg(
        F.avg(diff * diff).alias("mse"),
        F.avg(F.try_divide(F.abs(diff), F.col(pred).cast("double"))).alias("mean_abs_prop"),
        F.count(F.lit(1)).alias("n"),
    )


def ratio_to_baseline(df: DataFrame, baseline: DataFrame, metrics: Sequence[str], on=None) -> DataFrame:
    """Metric / baseline metric (NULL for a zero baseline) and the
    ``ce_greater`` flag (class error ratio > 1). ``baseline`` has one row per
    ``on`` group (or one row)."""
    on = _cols(on)
    if on:
        b = baseline.select(*on, *[F.col(m).alias(f"_base_{m}") for m in metrics])
        j = df.join(b, on=on, how="inner")
    else:  # a one-row baseline: a scalar subquery, not a join
        s = baseline.select(F.struct(*[F.col(m).alias(m) for m in metrics])).scalar()
        j = df.withColumns({f"_base_{m}": s.getField(m) for m in metrics})
    for m in metrics:
        j = j.withColumn(f"{m}_ratio", F.try_divide(F.col(m), F.col(f"_base_{m}")))
    if "class_error" in metrics:
        j = j.withColumn("ce_greater", (F.col("class_error_ratio") > 1).cast("int"))
    return j.drop(*[f"_base_{m}" for m in metrics])
