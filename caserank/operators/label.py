"""Success labels and segment success."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.tables import lookup_table

# Fixed values of the study's label rule
MIN_RATIO = 0.05
MIN_COUNT = 2


def ratio_test(paid: Column, toa: Column, min_ratio: float) -> Column:
    """1 if paid/toa >= min_ratio, with R's division semantics under ANSI:
    toa = 0 and paid > 0 is +Inf (1), paid < 0 is -Inf (0), 0/0 is NaN (NULL)."""
    return (
        F.when(toa.isNull() | paid.isNull(), F.lit(None))
        .when(toa == 0, F.when(paid > 0, F.lit(1)).when(paid < 0, F.lit(0)))
        .when(F.try_divide(paid, toa) >= F.lit(min_ratio), F.lit(1))
        .otherwise(F.lit(0))
        .cast("int")
    )


def case_payment_sums(cases: DataFrame, payments: DataFrame, key: str = "case_id", toa: str = "toa",
                      max_month: int | None = None) -> DataFrame:
    """J1 + A1: per case the payment sum and count, with the case's TOA.

    Right outer on the payments side: payments of an unknown case keep a NULL TOA.
    Aggregating payments first (map-side combine) and joining after keeps the
    join at one row per case.
    """
    p = payments if max_month is None else payments.where(F.col("month") <= F.lit(max_month))
    sums = p.groupBy(key).agg(
        F.sum("payment_amount").alias("sum_payments"),
        F.sum("number_of_payment").cast("long").alias("sum_num_payments"),
    )
    return cases.select(key, toa).join(sums, on=key, how="right")


def success_label(
    cases: DataFrame,
    payments: DataFrame,
    key: str = "case_id",
    min_ratio: float = MIN_RATIO,
    min_count: int = MIN_COUNT,
    max_month: int | None = None,
    out: str = "suc",
    keep_parts: bool = False,
) -> DataFrame:
    """Per case ``suc1 = paid/toa >= min_ratio``, ``suc2 = n >= min_count``,
    ``suc = suc2 if suc2 > suc1 else suc1`` (NULL if suc1 is NULL)."""
    s = case_payment_sums(cases, payments, key, max_month=max_month)
    suc1 = ratio_test(F.col("sum_payments"), F.col("toa"), min_ratio)
    suc2 = (F.col("sum_num_payments") >= F.lit(min_count)).cast("int")
    s = s.withColumn("suc1", suc1).withColumn("suc2", suc2)
    s = s.withColumn(out, F.when(F.col("suc2") > F.col("suc1"), F.col("suc2")).otherwise(F.col("suc1")))
    cols = [key, "suc1", "suc2", out] if keep_parts else [key, out]
    return s.select(*cols)


def attach_label(cases: DataFrame, labels: DataFrame, key: str = "case_id") -> DataFrame:
    """Cases right-join labels: every labelled case, cases without payments drop out."""
    return cases.join(labels, on=key, how="right").select(*cases.columns, *[c for c in labels.columns if c != key])


def label_crosstab(labels: DataFrame) -> DataFrame:
    """Counts of (suc1, suc2) pairs."""
    return labels.groupBy("suc1", "suc2").agg(F.count(F.lit(1)).alias("n"))


def segment_success(
    cases: DataFrame,
    payments: DataFrame,
    segment: str,
    key: str = "case_id",
    min_ratio: float = MIN_RATIO,
    min_mean_count: float = MIN_COUNT,
    weighting: str = "case",
) -> DataFrame:
    """D3: per segment ``sum(paid)/sum(toa) >= min_ratio`` or ``mean(n) > min_mean_count``
    (strict), combined like D1.

    ``weighting="event_row"`` reproduces the reference exactly: the case sums are
    repeated on every payment row (A11), so a case weighs by its number of rows.
    """
    sums = case_payment_sums(cases, payments, key)
    per_case = cases.select(key, segment).join(sums, on=key, how="inner")
    if weighting == "event_row":
        rows = payments.groupBy(key).agg(F.count(F.lit(1)).alias("_w"))
        per_case = per_case.join(rows, on=key, how="inner")
        w = F.col("_w")
    else:
        w = F.lit(1)
    agg = per_case.groupBy(segment).agg(
        F.sum(F.col("sum_payments") * w).alias("_paid"),
        F.sum(F.col("toa") * w).alias("_toa"),
        (F.sum(F.col("sum_num_payments") * w) / F.sum(w)).alias("mean_num_payments"),
        F.sum(w).cast("long").alias("weight"),
    )
    suc1 = ratio_test(F.col("_paid"), F.col("_toa"), min_ratio)
    suc2 = (F.col("mean_num_payments") > F.lit(min_mean_count)).cast("int")
    return agg.select(
        segment,
        F.when(suc2 > suc1, suc2).otherwise(suc1).alias("segment_success"),
        F.try_divide(F.col("_paid"), F.col("_toa")).alias("paid_ratio"),
        "mean_num_payments",
        "weight",
    )


def name_segments(spark, df: DataFrame, segment: str, names: Sequence[str], out: str = "segment_name") -> DataFrame:
    """Attach caller-supplied names 1..k to segment ids via a literal table."""
    t = lookup_table(spark, [(i + 1, n) for i, n in enumerate(names)], f"{segment} int, {out} string")
    return df.join(t, on=segment, how="left")
