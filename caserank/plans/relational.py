"""The relational half of stage C on tables that have an SQL form.

Grid results, importance tables and rank tables come from model fits in the study;
the operators that join, rank and average them do not care. Here they run on tables
derived from the labelled cases by plain aggregates: each *fit* is a group of lands,
its *relative influence* the share of a feature's absolute correlation with the label,
its *error* one minus that correlation. The DuckDB statements recompute all of it.
"""

from __future__ import annotations

import os
import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.core import label_number, strip_suffix
from ..operators.columns import cast_columns, feature_columns, recode, select_except
from ..operators.importance import group_mean_rank
from ..operators.metrics import classification_error, ratio_to_baseline
from ..operators.models import select_features
from ..operators.profile import box_stats, crosstab_wide
from ..operators.ranking import best_row, consensus_rank, rank_by, top_k
from ..operators.stats import grouped_target_correlation
from ..session import cut_lineage, ensure_checkpoint_dir, shared
from ..sources.tables import lookup_table, write_table
from . import oracle_sql as O
from . import study
from .catalog import PEARSON, R, register, rounded

FITS = 5
_F = ", ".join(f"CAST({f} AS DOUBLE) AS {f}" for f in O.FEATURES)
_BASKET_ROWS = ", ".join(f"('{f}', {1 + i % 4})" for i, f in enumerate(O.FEATURES))
_POSITION = ", ".join(f"('{f}', {i})" for i, f in enumerate(O.FEATURES))

_CTES = [*O.labelled(), f"""
lab AS (SELECT CAST(land % {FITS} AS INTEGER) AS fit, CAST(suc AS DOUBLE) AS y, {_F} FROM labelled)""", f"""
long AS (UNPIVOT lab ON {", ".join(O.FEATURES)} INTO NAME var VALUE x)""", f"""
cor AS (SELECT fit, var, abs({PEARSON('x', 'y')}) AS a FROM long GROUP BY fit, var)""", """
fits AS (SELECT fit, var, a AS abs_cor, 1 - a AS error, 100 * a / sum(a) OVER (PARTITION BY fit) AS rel_inf FROM cor)""", f"""
baskets(feature, basket_id) AS (VALUES {_BASKET_ROWS})"""]


def _sql(select: str, *more: str) -> str:
    return O.with_ctes(*_CTES, *more) + "\n" + select


def fits(spark, sf) -> DataFrame:
    """(fit, var, abs_cor, error, rel_inf): one row per fit and feature."""
    def build():
        lc = study.labelled_cases(spark, sf).withColumn("fit", (F.col("land") % FITS).cast("int"))
        c = grouped_target_correlation(lc, study.LABEL, study.FEATURES, "fit").withColumnRenamed("abs_cor_lin", "abs_cor")
        total = c.groupBy("fit").agg(F.sum("abs_cor").alias("_t"))
        out = c.join(total, "fit").select("fit", "var", "abs_cor", (1 - F.col("abs_cor")).alias("error"),
                                          F.try_divide(100 * F.col("abs_cor"), F.col("_t")).alias("rel_inf"))
        return cut_lineage(out, "fits")

    return shared(spark, sf, "fits", build)


def baskets(spark) -> DataFrame:
    return lookup_table(spark, [(f, 1 + i % 4) for i, f in enumerate(study.FEATURES)], "feature string, basket_id int")


def _named(spark) -> DataFrame:
    return baskets(spark).withColumnRenamed("feature", "var")


@register("j4_basket_lookup", _sql(f"SELECT f.fit, f.var, b.basket_id, {R('f.rel_inf')} AS rel_inf FROM fits f LEFT JOIN baskets b ON f.var = b.feature"))
def q_j4(spark, sf):
    """The basket of each feature, joined on key columns of different names."""
    b = baskets(spark)
    f = fits(spark, sf)
    return rounded(b.join(f, b.feature == f.var, "right").select("fit", "var", "basket_id", "rel_inf"))


@register("j5_stat_tables_by_feature", _sql(f"""
SELECT x.var, {R('x.rel_inf')} AS rel_inf, {R('x.error')} AS error, {R('y.rel_inf')} AS rel_inf_other, {R('y.error')} AS error_other
FROM (SELECT * FROM fits WHERE fit = 0) x LEFT JOIN (SELECT * FROM fits WHERE fit = 1) y ON x.var = y.var"""))
def q_j5(spark, sf):
    """Two statistic tables joined per feature; clashing names get a suffix."""
    f = fits(spark, sf)
    x, y = f.where("fit = 0").select("var", "rel_inf", "error"), f.where("fit = 1").select("var", "rel_inf", "error")
    return rounded(x.join(y.withColumnsRenamed({c: f"{c}_other" for c in ("rel_inf", "error")}), "var", "left"))


@register("j5_stat_tables_by_basket", _sql(f"""
SELECT f.fit, f.var, f.basket_id, {R('f.rel_inf')} AS rel_inf, {R('g.rel_inf')} AS rel_inf_basket, g.n
FROM (SELECT fits.*, basket_id FROM fits JOIN baskets ON var = feature) f
JOIN (SELECT fit, basket_id, sum(rel_inf) AS rel_inf, count(*) AS n FROM fits JOIN baskets ON var = feature GROUP BY ALL) g
ON f.fit = g.fit AND f.basket_id = g.basket_id"""))
def q_j5_basket(spark, sf):
    """Basket statistics joined to the rows of their features."""
    f = fits(spark, sf).join(_named(spark), "var")
    g = f.groupBy("fit", "basket_id").agg(F.sum("rel_inf").alias("rel_inf_basket"), F.count(F.lit(1)).alias("n"))
    return rounded(f.join(g, ["fit", "basket_id"]).select("fit", "var", "basket_id", "rel_inf", "rel_inf_basket", "n"))


_RANKS = """
ranked AS (SELECT fit, var, CAST(row_number() OVER (PARTITION BY fit ORDER BY rel_inf DESC NULLS LAST, var) AS INTEGER) AS rank FROM fits)"""
_WIDE = "SELECT var, " + ", ".join(f"max(CASE WHEN fit = {i} THEN rank END) AS rank_{i}" for i in range(FITS)) + " FROM ranked GROUP BY var"
_MEAN = "(" + " + ".join(f"rank_{i}" for i in range(FITS)) + f") / {float(FITS)}"


@register("j6_m23_p16_rank_assembly", _sql(f"""
SELECT * EXCLUDE (a), {R('a')} AS avg_place, CAST(row_number() OVER (ORDER BY a NULLS LAST, var) AS INTEGER) AS place
FROM (SELECT *, {_MEAN} AS a FROM wide)""", _RANKS, f"wide AS ({_WIDE})"))
def q_j6(spark, sf):
    """J6 + P16 + M23: the fits' rank tables joined, averaged row-wise and placed."""
    ranked = rank_by(fits(spark, sf), "rel_inf", ascending=False, tiebreak=["var"], by=["fit"])
    tables = [ranked.where(F.col("fit") == i).select("var", F.col("rank").alias(f"rank_{i}")) for i in range(FITS)]
    return rounded(consensus_rank(tables, "var", [f"rank_{i}" for i in range(FITS)]))


_BASKET_RANKS = """
bm AS (SELECT fit, basket_id, avg(rel_inf) AS m FROM fits JOIN baskets ON var = feature GROUP BY ALL)""", """
br AS (SELECT fit, basket_id, CAST(row_number() OVER (PARTITION BY fit ORDER BY m DESC NULLS LAST, basket_id) AS INTEGER) AS rank FROM bm)""", \
    "wide AS (SELECT basket_id, " + ", ".join(f"max(CASE WHEN fit = {i} THEN rank END) AS rank_{i}" for i in range(FITS)) + " FROM br GROUP BY basket_id)"


@register("m21_m24_basket_ranks", _sql(f"""
SELECT * EXCLUDE (a), {R('a')} AS avg_place, CAST(row_number() OVER (ORDER BY a NULLS LAST, basket_id) AS INTEGER) AS place
FROM (SELECT *, {_MEAN} AS a FROM wide)""", *_BASKET_RANKS))
def q_m24(spark, sf):
    """M21 + M24: mean influence per basket ranked in each fit, then the consensus."""
    f = fits(spark, sf)
    tables = [group_mean_rank(f.where(F.col("fit") == i), _named(spark), "rel_inf", f"rank_{i}", ascending=False).select("basket_id", f"rank_{i}")
              for i in range(FITS)]
    return rounded(consensus_rank(tables, "basket_id", [f"rank_{i}" for i in range(FITS)]))


@register("a7_w4_grid_best", _sql("""
SELECT fit, CAST(pos % 3 AS INTEGER) AS depth, round(min(error), 6) AS error FROM fits JOIN p ON var = feature GROUP BY ALL
ORDER BY min(error), fit, depth LIMIT 1""", f"p(feature, pos) AS (VALUES {_POSITION})"))
def q_a7(spark, sf):
    """A7 + W4: the least error of each parameter tuple, then the best tuple."""
    pos = lookup_table(spark, [(f, i % 3) for i, f in enumerate(study.FEATURES)], "var string, depth int")
    g = fits(spark, sf).join(pos, "var").groupBy("fit", "depth").agg(F.min("error").alias("error"))
    return rounded(best_row(g, "error", tiebreak=["fit", "depth"]).select("fit", "depth", "error"))


@register("a8_m16_influence_selection", _sql(f"SELECT var, {R('avg(rel_inf)')} AS mean_rel_inf, CAST(avg(rel_inf) > 2 AS INTEGER) AS selected FROM fits GROUP BY var"))
def q_a8(spark, sf):
    """A8 + M16: mean influence of each feature over the fits, and the ``> 2`` flag."""
    return rounded(select_features(fits(spark, sf)))


@register("a9_mean_error_by_basket", _sql(f"""
SELECT basket_id, {R('avg(error)')} AS mean_error, CAST(row_number() OVER (ORDER BY avg(error), basket_id) AS INTEGER) AS rank
FROM fits JOIN baskets ON var = feature WHERE fit = 2 GROUP BY basket_id"""))
def q_a9(spark, sf):
    """A9 + J4 + W1: mean of a per-feature statistic by basket, smallest first."""
    return rounded(group_mean_rank(fits(spark, sf).where("fit = 2"), _named(spark), "error", "rank", ascending=True))


@register("w5_a3_top6_per_fit", _sql(f"""
SELECT var, count(*) AS n, {R(f'count(*) / {float(FITS)}')} AS share
FROM (SELECT var, row_number() OVER (PARTITION BY fit ORDER BY rel_inf DESC NULLS LAST, var) AS r FROM fits) WHERE r <= 6 GROUP BY var"""))
def q_w5_per_fit(spark, sf):
    """W5 + A2 + A3: the six most influential features of every fit, and in what share
    of the fits each is among them."""
    top = top_k(fits(spark, sf), "rel_inf", 6, by=["fit"], tiebreak=["var"])
    return rounded(top.groupBy("var").agg(F.count(F.lit(1)).alias("n"), (F.count(F.lit(1)) / F.lit(float(FITS))).alias("share")))


@register("j7_a14_influence_by_basket", _sql(f"""
SELECT f.basket_id, {R('q1')} AS q1, {R('med')} AS median, {R('q3')} AS q3,
       {R('min(CASE WHEN rel_inf BETWEEN lo AND hi THEN rel_inf END)')} AS whisker_low,
       {R('max(CASE WHEN rel_inf BETWEEN lo AND hi THEN rel_inf END)')} AS whisker_high,
       CAST(sum(CASE WHEN rel_inf BETWEEN lo AND hi THEN 0 ELSE 1 END) AS BIGINT) AS outliers, f.n
FROM x JOIN f ON x.basket_id = f.basket_id WHERE rel_inf IS NOT NULL GROUP BY f.basket_id, q1, med, q3, f.n""", """
x AS (SELECT basket_id, rel_inf FROM fits JOIN baskets ON var = feature)""", """
q AS (SELECT basket_id, quantile_cont(rel_inf, 0.25) AS q1, median(rel_inf) AS med, quantile_cont(rel_inf, 0.75) AS q3, count(rel_inf) AS n FROM x GROUP BY 1)""", """
f AS (SELECT *, q1 - 1.5 * (q3 - q1) AS lo, q3 + 1.5 * (q3 - q1) AS hi FROM q)"""))
def q_j7(spark, sf):
    """J7 + A14: every fit's influences with their baskets, box statistics by basket."""
    return rounded(box_stats(fits(spark, sf).join(_named(spark), "var"), "rel_inf", "basket_id"))


_DPD_RULE = "CASE WHEN dpd < (SELECT avg(dpd) FROM labelled) THEN 1 ELSE 0 END"


@register("m12_m19_error_ratio_by_group", O.with_ctes(*O.labelled(), f"""
p AS (SELECT CAST(land % {FITS} AS INTEGER) AS fit, CASE WHEN {_DPD_RULE} <> suc THEN 1.0 ELSE 0.0 END AS e FROM labelled)""", """
g AS (SELECT fit, avg(e) AS class_error, count(*) AS n FROM p GROUP BY fit)""", """
b AS (SELECT avg(e) AS base FROM p)""") + f"""
SELECT fit, {R('class_error')} AS class_error, n, {R('class_error / NULLIF(base, 0)')} AS class_error_ratio,
       CAST(class_error / NULLIF(base, 0) > 1 AS INTEGER) AS ce_greater FROM g, b""")
def q_m19(spark, sf):
    """M12 + M19: class error of a fixed rule by group, over the error on all rows."""
    lc = study.labelled_cases(spark, sf)
    mean = lc.select(F.avg("dpd")).scalar()
    scored = lc.select((F.col("land") % FITS).cast("int").alias("fit"), "suc", F.when(F.col("dpd") < mean, 1).otherwise(0).alias("pred"))
    return rounded(ratio_to_baseline(classification_error(scored, "pred", "suc", "fit"), classification_error(scored, "pred", "suc"), ["class_error"]))


@register("f5_f7_labels", _sql("SELECT fit, var, concat(var, ' ', CAST(round_even(rel_inf, 2) AS VARCHAR)) AS label FROM fits"))
def q_labels(spark, sf):
    """F5 + F6 + F7: plot labels; the scaled column's suffix is stripped again."""
    f = fits(spark, sf).withColumn("column", F.concat("var", F.lit("_nrm")))
    return f.select("fit", "var", F.concat(strip_suffix("column"), F.lit(" "), label_number("rel_inf", 2).cast("string")).alias("label"))


@register("s3_written_table", _sql(f"SELECT fit, var, {R('error')} AS error FROM fits"))
def q_s3(spark, sf):
    """S3 + S2: a table written by fit and read back."""
    path = write_table(fits(spark, sf).select("var", "error", "fit"), os.path.join(ensure_checkpoint_dir(spark), "tables"), f"saved-{uuid.uuid4().hex}", ["fit"])
    return rounded(spark.read.parquet(path).select(F.col("fit").cast("int").alias("fit"), "var", "error"))


@register("p1_f10_column_subsets", O.with_ctes(*O.labelled()) + "\nSELECT case_id, toa, dpd, suc FROM labelled")
def q_p1(spark, sf):
    """P1 + F10: the columns but for a list of names, and the feature list by difference."""
    lc = study.labelled_cases(spark, sf)
    drop = [f for f in feature_columns(lc, ["case_id", "suc"]) if f not in ("toa", "dpd")]
    return select_except(lc, drop).select("case_id", "toa", "dpd", "suc")


@register("p7_p11_recode_and_cast", O.with_ctes(*O.labelled()) + """
SELECT case_id, CASE is_female WHEN 1 THEN 0 WHEN 0 THEN 1 END AS is_female, CAST(land AS VARCHAR) AS land, CAST(age AS DOUBLE) AS age FROM labelled""")
def q_p7(spark, sf):
    """P7 + P11 + F8: a flag inverted by a value map; casts by name."""
    c = recode(study.labelled_cases(spark, sf).select("case_id", "is_female", "land", "age"), "is_female", {1: 0, 0: 1})
    return cast_columns(c, {"land": "string", "age": "double"})


@register("a12_crosstab_wide", O.with_ctes(*O.labelled()) + """
SELECT land, count(*) FILTER (WHERE suc = 0) AS suc_0, count(*) FILTER (WHERE suc = 1) AS suc_1 FROM labelled GROUP BY land""")
def q_a12_wide(spark, sf):
    """The contingency table in wide form."""
    return crosstab_wide(study.labelled_cases(spark, sf), "land", "suc", [0, 1]).withColumnsRenamed({"0": "suc_0", "1": "suc_1"})

