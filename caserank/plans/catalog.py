"""Registered queries: one per operator of the study, each over the given tables,
with the DuckDB statement that recomputes it (``ORACLE``). Queries without an
SQL form (model fits, clustering) are registered without an oracle entry and
are checked by property and brute-force tests instead."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, FloatType

from ..operators.ranking import rank_by
from ..operators.stats import target_correlation
from ..session import cut_lineage, shared
from . import oracle_sql as O
from . import study

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def deco(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn
    return deco


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Round every double column (both engines sum in different orders)."""
    return df.select(*[
        F.round(F.col(f.name), digits).alias(f.name) if isinstance(f.dataType, (DoubleType, FloatType)) else F.col(f.name)
        for f in df.schema.fields
    ])


def R(expr: str) -> str:
    return f"round({expr}, 6)"


def PEARSON(a: str, b: str) -> str:
    a_, b_ = f"CASE WHEN {b} IS NOT NULL THEN {a} END", f"CASE WHEN {a} IS NOT NULL THEN {b} END"
    sd = f"(stddev_samp({a_}) * stddev_samp({b_}))"
    return f"CASE WHEN {sd} > 0 THEN covar_samp({a}, {b}) / {sd} END"


# --- D1/D2: success label -----------------------------------------------------

@register("d1_success_label", O.with_ctes(*O.BASE, O.labels_cte()) + "\nSELECT case_id, suc1, suc2, suc FROM labels")
def d1_success_label(spark, sf):
    return study.labels(spark, sf, keep_parts=True)


@register("d2_label_crosstab", O.with_ctes(*O.BASE, O.labels_cte()) +
          "\nSELECT suc1, suc2, count(*) AS n FROM labels GROUP BY suc1, suc2")
def d2_label_crosstab(spark, sf):
    from ..operators.label import label_crosstab
    return label_crosstab(study.labels(spark, sf, keep_parts=True))


# --- M2 + W1 + W2: feature/label correlation and ranks (the flagship) ---------

_F_DBL = ", ".join(f"CAST({f} AS DOUBLE) AS {f}" for f in O.FEATURES)
_SQL_M2 = O.with_ctes(*O.labelled(), f"""
lab AS (SELECT case_id, CAST(suc AS DOUBLE) AS y, {_F_DBL} FROM labelled)""", f"""
long AS (UNPIVOT lab ON {", ".join(O.FEATURES)} INTO NAME var VALUE x)""", """
rk AS (
  SELECT var, x, y,
         rank() OVER (PARTITION BY var ORDER BY x) + (count(*) OVER (PARTITION BY var, x) - 1) / 2.0 AS rx,
         rank() OVER (PARTITION BY var ORDER BY y) + (count(*) OVER (PARTITION BY var, y) - 1) / 2.0 AS ry
  FROM long WHERE x IS NOT NULL AND y IS NOT NULL)""", f"""
cors AS (
  SELECT var, {PEARSON('x', 'y')} AS cor_lin, {PEARSON('rx', 'ry')} AS cor_spear FROM rk GROUP BY var)""") + f"""
SELECT var, {R('cor_lin')} AS cor_lin, {R('abs(cor_lin)')} AS abs_cor_lin,
       {R('cor_spear')} AS cor_spear, {R('abs(cor_spear)')} AS abs_cor_spear,
       CAST(row_number() OVER (ORDER BY abs(cor_lin) DESC NULLS LAST, var) AS INTEGER) AS rank_lin,
       CAST(row_number() OVER (ORDER BY abs(cor_spear) DESC NULLS LAST, var) AS INTEGER) AS rank_spear
FROM cors"""


@register("m2_feature_label_correlation", _SQL_M2)
def feature_label_correlation(spark, sf):
    lc = study.labelled_cases(spark, sf)
    tc = target_correlation(lc, study.LABEL, study.FEATURES, key=study.KEY)
    tc = rank_by(tc, "abs_cor_lin", ascending=False, tiebreak=["var"], out="rank_lin")
    tc = rank_by(tc, "abs_cor_spear", ascending=False, tiebreak=["var"], out="rank_spear")
    return rounded(tc.select("var", "cor_lin", "abs_cor_lin", "cor_spear", "abs_cor_spear", "rank_lin", "rank_spear"))


# --- Stage A tables ------------------------------------------------------------

_CASES = O.with_ctes(*O.BASE)
_FEATS = ", ".join(O.FEATURES)


def _cases(spark, sf):
    """The decoded cases as a stage table: order statistics read it once a level."""
    return shared(spark, sf, "decoded", lambda: cut_lineage(study.decoded_cases(spark, sf), "decoded"))


def _rsel(cols):
    """SQL select list that rounds the double columns of the cases table."""
    dbl = {"toa", "loan_amount", "principal", "interest", "other", "population", "mean_salary",
           "gdp_per_capita", "last_payment_amount"}
    return ", ".join(R(c) + f" AS {c}" if c in dbl else c for c in cols)


@register("s1_p6_decoded_cases", _CASES + f"\nSELECT case_id, {_rsel(O.FEATURES)} FROM cases")
def q_decoded(spark, sf):
    """S1 + P4 + P6 (+ J1 source joins): the decoded case table."""
    return rounded(_cases(spark, sf))


@register("i1_i2_clean_payments", _CASES + "\nSELECT case_id, month, " + R("payment_amount") +
          " AS payment_amount, number_of_payment FROM payments")
def q_payments(spark, sf):
    from ..sources.fixtures import payments_raw
    return rounded(study.clean_payments(payments_raw(spark, sf)))


@register("a1_case_payment_sums", O.with_ctes(*O.BASE, O.labels_cte()) +
          f"\nSELECT case_id, {R('toa')} AS toa, {R('sum_payments')} AS sum_payments, sum_num_payments FROM labels_sums")
def q_sums(spark, sf):
    from ..operators.label import case_payment_sums
    from ..sources.fixtures import cases_raw, payments_raw
    return rounded(case_payment_sums(cases_raw(spark, sf), study.clean_payments(payments_raw(spark, sf))))


@register("stage_a_imputed_cases", O.with_ctes(*O.BASE, O.IMPUTED) + f"\nSELECT case_id, {_rsel(O.FEATURES)} FROM imputed")
def q_imputed(spark, sf):
    """I1-I10 in order plus the non-model completion: no NULL left in any feature
    of cases that have lineitems."""
    return rounded(study.imputed_cases(spark, sf))


@register("stage_a_labelled_cases", O.with_ctes(*O.labelled()) + f"\nSELECT case_id, {_rsel(O.FEATURES)}, suc FROM labelled")
def q_labelled(spark, sf):
    """Imputed cases right-joined with their labels (cases without payments drop out)."""
    return rounded(study.labelled_cases(spark, sf))


@register("p7_invert_flags", _CASES + "\nSELECT case_id, " + ", ".join(
    f"CAST(CASE WHEN {c} IS NULL THEN NULL WHEN {c} = 1 THEN 0 ELSE 1 END AS INTEGER) AS {c}"
    for c in ["closed_execution", "bailiff", "is_female", "is_cash_loan", "external_agency"]) + " FROM cases")
def q_invert(spark, sf):
    from ..operators.columns import invert_flag
    c = _cases(spark, sf)
    for col in ["closed_execution", "bailiff", "is_female", "is_cash_loan", "external_agency"]:
        c = invert_flag(c, col)
    return c.select("case_id", "closed_execution", "bailiff", "is_female", "is_cash_loan", "external_agency")


@register("p9_membership", _CASES + """
SELECT case_id, 1 AS has_payments FROM cases WHERE case_id IN (SELECT case_id FROM payments)
UNION ALL
SELECT case_id, 0 AS has_payments FROM cases WHERE case_id NOT IN (SELECT case_id FROM payments)""")
def q_membership(spark, sf):
    """%in% / %notin% as left semi / left anti joins."""
    from ..operators.columns import keep_in, keep_not_in
    from ..sources.fixtures import payments_raw
    c = _cases(spark, sf).select("case_id")
    p = payments_raw(spark, sf).select("case_id")
    return keep_in(c, p, "case_id").withColumn("has_payments", F.lit(1)).unionByName(
        keep_not_in(c, p, "case_id").withColumn("has_payments", F.lit(0)))


@register("p10_complete_cases", _CASES + f"\nSELECT case_id FROM cases WHERE " +
          " AND ".join(f"{c} IS NOT NULL" for c in O.FEATURES))
def q_complete(spark, sf):
    from ..operators.columns import complete_cases
    return complete_cases(_cases(spark, sf)).select("case_id")


@register("p3_conditional_update", _CASES + """
SELECT case_id, CASE WHEN age = -1 AND is_female IS NULL THEN 0 ELSE age END AS age FROM cases""")
def q_cond_update(spark, sf):
    """``dt[cond, col := value]``: other rows keep their value."""
    from ..operators.columns import conditional_update
    c = _cases(spark, sf)
    return conditional_update(c, (F.col("age") == -1) & F.col("is_female").isNull(), "age", F.lit(0)).select("case_id", "age")


@register("p12_null_census", _CASES + "\nSELECT column_name AS \"column\", CAST(nulls AS BIGINT) AS nulls, "
          "CAST((SELECT count(*) FROM cases) AS BIGINT) AS \"rows\" FROM (UNPIVOT (SELECT " +
          ", ".join(f"count(*) - count({c}) AS {c}" for c in ["case_id", *O.FEATURES]) +
          " FROM cases) ON " + ", ".join(["case_id", *O.FEATURES]) + " INTO NAME column_name VALUE nulls)")
def q_nulls(spark, sf):
    from ..operators.profile import null_census
    return null_census(_cases(spark, sf))


_F_DBL_CASES = ", ".join(f"CAST({f} AS DOUBLE) AS {f}" for f in O.FEATURES)


@register("p13_profile", _CASES + f""",
wide AS (SELECT {_F_DBL_CASES} FROM cases),
long AS (SELECT * FROM wide UNPIVOT INCLUDE NULLS (value FOR "column" IN ({_FEATS})))
SELECT "column", {R('min(value)')} AS min, {R('quantile_cont(value, 0.25)')} AS q1, {R('median(value)')} AS median,
       {R('avg(value)')} AS mean, {R('quantile_cont(value, 0.75)')} AS q3, {R('max(value)')} AS max,
       CAST(count(*) - count(value) AS BIGINT) AS nulls
FROM long GROUP BY "column\"""")
def q_profile(spark, sf):
    from ..operators.profile import profile
    return rounded(profile(_cases(spark, sf), study.FEATURES))


@register("p14_schema", None)
def q_schema(spark, sf):
    """R ``str``: name/type/nullability, rows, distinct values and an example value of
    each column of the decoded cases table."""
    from ..operators.profile import schema_rows
    return schema_rows(_cases(spark, sf))


@register("p15_unpivot", _CASES + f""",
long AS (UNPIVOT (SELECT case_id, {_F_DBL_CASES} FROM cases) ON {_FEATS} INTO NAME var VALUE value)
SELECT case_id, var, {R('value')} AS value FROM long""")
def q_unpivot(spark, sf):
    """``melt`` to (case_id, var, value); NULL values dropped."""
    c = _cases(spark, sf).select("case_id", *[F.col(f).cast("double").alias(f) for f in study.FEATURES])
    return rounded(c.unpivot(["case_id"], study.FEATURES, "var", "value").where(F.col("value").isNotNull()))


@register("p16_row_mean", _CASES + f"\nSELECT case_id, {R('(external_agency + bailiff + closed_execution) / 3.0')} AS flag_mean FROM cases")
def q_row_mean(spark, sf):
    from ..operators.columns import row_mean
    c = _cases(spark, sf)
    return rounded(c.select("case_id", row_mean(["external_agency", "bailiff", "closed_execution"]).alias("flag_mean")))


@register("a2_a3_frequencies", _CASES + """
SELECT land, count(*) AS n, round(count(*) / sum(count(*)) OVER (), 6) AS share FROM cases GROUP BY land""")
def q_freq(spark, sf):
    from ..operators.profile import frequencies
    return rounded(frequencies(_cases(spark, sf), "land"))


@register("a4_group_mean_median", _CASES + f"""
SELECT land, {R('avg(mean_salary)')} AS mean, {R('median(mean_salary)')} AS median, count(mean_salary) AS n
FROM cases WHERE land IS NOT NULL GROUP BY land""")
def q_group_stats(spark, sf):
    from ..operators.positions import exact_median
    c = _cases(spark, sf).where(F.col("land").isNotNull())
    m = c.groupBy("land").agg(F.avg("mean_salary").alias("mean"), F.count("mean_salary").alias("n"))
    md = exact_median(c, "mean_salary", "land")
    return rounded(m.join(md, "land", "left").select("land", "mean", "median", "n"))


@register("a6_global_quantiles", _CASES + f"""
SELECT {R('avg(loan_amount)')} AS mean, {R('median(loan_amount)')} AS median,
       {R('quantile_cont(loan_amount, 0.9)')} AS p90, count(loan_amount) AS n FROM cases""")
def q_global_q(spark, sf):
    from ..operators.positions import exact_quantiles
    c = _cases(spark, sf)
    q = exact_quantiles(c, "loan_amount", [0.5, 0.9])
    s = c.select(F.avg("loan_amount").alias("mean")).scalar()
    return rounded(q.groupBy().agg(
        F.max(F.when(F.col("p") == 0.5, F.col("q"))).alias("median"),
        F.max(F.when(F.col("p") == 0.9, F.col("q"))).alias("p90"),
        F.max("n").alias("n"),
    ).select(s.alias("mean"), "median", "p90", "n"))


@register("a12_crosstab", _CASES + "\nSELECT bailiff, closed_execution, count(*) AS n FROM cases GROUP BY bailiff, closed_execution")
def q_crosstab(spark, sf):
    from ..operators.profile import crosstab_counts
    return crosstab_counts(_cases(spark, sf), "bailiff", "closed_execution")


@register("a13_histogram", _CASES + """,
bins AS (SELECT b AS bin, CAST(b - 1 AS DOUBLE) AS lower, CAST(b AS DOUBLE) AS upper FROM range(1, 26) t(b))
SELECT bin, lower, upper, CAST((SELECT count(*) FROM cases WHERE land IS NOT NULL AND
       ((land > lower AND land <= upper) OR (bin = 1 AND land = lower))) AS BIGINT) AS n FROM bins""")
def q_hist(spark, sf):
    from ..operators.profile import histogram
    return histogram(_cases(spark, sf), "land", list(range(0, 26)))


@register("a14_box_stats", _CASES + f""",
q AS (SELECT is_cash_loan, quantile_cont(loan_amount, 0.25) AS q1, median(loan_amount) AS median,
             quantile_cont(loan_amount, 0.75) AS q3, count(loan_amount) AS n FROM cases GROUP BY is_cash_loan),
f AS (SELECT *, q1 - 1.5 * (q3 - q1) AS lo, q3 + 1.5 * (q3 - q1) AS hi FROM q)
SELECT f.is_cash_loan, {R('q1')} AS q1, {R('median')} AS median, {R('q3')} AS q3,
       {R('min(CASE WHEN loan_amount BETWEEN lo AND hi THEN loan_amount END)')} AS whisker_low,
       {R('max(CASE WHEN loan_amount BETWEEN lo AND hi THEN loan_amount END)')} AS whisker_high,
       CAST(sum(CASE WHEN loan_amount BETWEEN lo AND hi THEN 0 ELSE 1 END) AS BIGINT) AS outliers, f.n
FROM cases c JOIN f ON c.is_cash_loan = f.is_cash_loan WHERE loan_amount IS NOT NULL
GROUP BY f.is_cash_loan, q1, median, q3, f.n""")
def q_box(spark, sf):
    from ..operators.profile import box_stats
    return rounded(box_stats(_cases(spark, sf), "loan_amount", "is_cash_loan"))


# --- I3-I10: one query per imputation policy (on the decoded cases) -------------

@register("i3_formula_fill", _CASES + f"\nSELECT case_id, {R('COALESCE(other, toa - (principal + interest))')} AS other FROM cases")
def q_i3(spark, sf):
    from ..operators.impute import fill_expr
    # one reader of a few columns: no stage table, and the other columns are pruned
    c = fill_expr(study.decoded_cases(spark, sf), "other", F.col("toa") - (F.col("principal") + F.col("interest")))
    return rounded(c.select("case_id", "other"))


@register("i4_median_fill", _CASES + """
SELECT case_id, COALESCE(contract_days, CAST(floor((SELECT median(contract_days) FROM cases)) AS INTEGER)) AS contract_days
FROM cases""")
def q_i4(spark, sf):
    from ..operators.impute import fill_stat
    c = fill_stat(_cases(spark, sf), "contract_days", "median", post=F.floor)
    return c.select("case_id", "contract_days")


@register("i5_i6_bernoulli_fill", _CASES + f""",
probs AS (SELECT avg(bailiff) AS pb, avg(closed_execution) AS pce, avg(external_agency) AS pea FROM cases),
b AS (SELECT case_id, closed_execution, external_agency,
        COALESCE(bailiff, CASE WHEN {O.U('case_id', 'bern:bailiff')} < (SELECT pb FROM probs) THEN 1 ELSE 0 END) AS bailiff
      FROM cases)
SELECT case_id, CAST(bailiff AS INTEGER) AS bailiff,
  CAST(COALESCE(closed_execution, CASE WHEN bailiff = 0 THEN 0 WHEN bailiff = 1 THEN
       CASE WHEN {O.U('case_id', 'bern:closed_execution')} < (SELECT pce FROM probs) THEN 1 ELSE 0 END END) AS INTEGER) AS closed_execution,
  CAST(COALESCE(external_agency, CASE WHEN {O.U('case_id', 'bern:external_agency')} < (SELECT pea FROM probs) THEN 1 ELSE 0 END) AS INTEGER) AS external_agency
FROM b""")
def q_i5(spark, sf):
    from ..operators.impute import bernoulli_probs, fill_bernoulli, fill_expr
    c0 = _cases(spark, sf)
    p = bernoulli_probs(c0, ["bailiff", "closed_execution", "external_agency"])
    c = fill_bernoulli(c0, "bailiff", "case_id", p.getField("bailiff"))
    c = fill_expr(c, "closed_execution", F.lit(0), where=F.col("bailiff") == 0)
    c = fill_bernoulli(c, "closed_execution", "case_id", p.getField("closed_execution"), where=F.col("bailiff") == 1)
    c = fill_bernoulli(c, "external_agency", "case_id", p.getField("external_agency"))
    return c.select("case_id", "bailiff", "closed_execution", "external_agency")


@register("i7_empirical_fill", _CASES + "," + O._cdf("cases", "land", "land_cdf").strip() +
          f"\nSELECT case_id, CAST({O._empirical('cases', 'land', 'land_cdf')} AS INTEGER) AS land FROM cases")
def q_i7(spark, sf):
    from ..operators.impute import fill_empirical
    return fill_empirical(_cases(spark, sf), "land", "case_id").select("case_id", "land")


@register("i8_group_mean_fill", _CASES + f""",
lm AS (SELECT land, avg(mean_salary) AS m FROM cases GROUP BY land)
SELECT c.case_id, {R('COALESCE(c.mean_salary, lm.m)')} AS mean_salary FROM cases c LEFT JOIN lm ON c.land = lm.land""")
def q_i8(spark, sf):
    from ..operators.impute import fill_group_stat
    return rounded(fill_group_stat(_cases(spark, sf), "mean_salary", "land", "mean").select("case_id", "mean_salary"))


@register("i9_group_median_fill", _CASES + f""",
lm AS (SELECT is_cash_loan, median(loan_amount) AS m FROM cases WHERE is_cash_loan IS NOT NULL GROUP BY is_cash_loan)
SELECT c.case_id, {R('COALESCE(c.loan_amount, lm.m)')} AS loan_amount FROM cases c LEFT JOIN lm ON c.is_cash_loan = lm.is_cash_loan""")
def q_i9(spark, sf):
    from ..operators.impute import fill_group_stat
    return rounded(fill_group_stat(_cases(spark, sf), "loan_amount", "is_cash_loan", "median").select("case_id", "loan_amount"))


@register("i10_donor_fill", _CASES + f""",
c1 AS (SELECT * REPLACE (COALESCE(is_female, 1) AS is_female) FROM cases),
donors AS (SELECT age AS dv, row_number() OVER (ORDER BY {O.U('case_id', 'donor:age:order')}, case_id) AS dpos
           FROM c1 WHERE is_female = 1 AND age <> -1)
SELECT c1.case_id, CAST(CASE WHEN c1.age = -1 THEN COALESCE((SELECT dv FROM donors WHERE dpos =
       floor({O.U('c1.case_id', 'donor:age')} * (SELECT count(*) FROM donors)) + 1), c1.age) ELSE c1.age END AS INTEGER) AS age
FROM c1""")
def q_i10(spark, sf):
    from ..operators.impute import fill_constant, fill_donor
    c = fill_constant(_cases(spark, sf), "is_female", 1)
    c = fill_donor(c, "age", "case_id", recipient=F.col("age") == -1,
                   donor=(F.col("is_female") == 1) & (F.col("age") != -1))
    return c.select("case_id", "age")


# --- X1-X6: splits, samples, permutations, resamples, scaling -------------------

@register("x1_split", _CASES + f"""
SELECT case_id, CAST(CASE WHEN {O.U('case_id', 'split')} < 0.6 THEN 0 WHEN {O.U('case_id', 'split')} < 0.8 THEN 1 ELSE 2 END AS INTEGER) AS split
FROM cases""")
def q_x1(spark, sf):
    from ..operators.sampling import split
    return split(_cases(spark, sf).select("case_id"), "case_id", [0.6, 0.2, 0.2])


@register("x2_sample_exact", _CASES + f"""
SELECT case_id FROM cases ORDER BY {O.U('case_id', 'sample')}, case_id
LIMIT (SELECT CAST(floor(count(*) * 0.6) AS BIGINT) FROM cases)""")
def q_x2(spark, sf):
    from ..operators.sampling import sample_fraction_exact
    return sample_fraction_exact(_cases(spark, sf).select("case_id"), "case_id", 0.6)


def _perm_sql(cols, salt="perm"):
    parts = [f"""dst AS (SELECT case_id, row_number() OVER (ORDER BY {O.U('case_id', salt + ':dst')}, case_id) AS pos FROM cases)"""]
    sel, joins = [], []
    for i, c in enumerate(cols):
        parts.append(f"""s{i} AS (SELECT {c} AS v, row_number() OVER (ORDER BY {O.U('case_id', salt + ':' + c)}, case_id) AS pos FROM cases)""")
        sel.append(f"s{i}.v AS {c}")
        joins.append(f"JOIN s{i} ON s{i}.pos = dst.pos")
    return _CASES + ",\n" + ",\n".join(parts) + f"\nSELECT dst.case_id, {', '.join(sel)} FROM dst " + " ".join(joins)


@register("x3_permute_column", _perm_sql(["dpd"]))
def q_x3(spark, sf):
    from ..operators.sampling import permute_columns
    return permute_columns(_cases(spark, sf).select("case_id", "dpd"), "case_id", ["dpd"])


@register("x4_permute_basket", _perm_sql(["dpd", "contract_days", "age"]))
def q_x4(spark, sf):
    """A basket of columns, each shuffled independently."""
    from ..operators.sampling import permute_columns
    return permute_columns(_cases(spark, sf).select("case_id", "dpd", "contract_days", "age"), "case_id",
                           ["dpd", "contract_days", "age"])


@register("x5_resample_splits", _CASES + f""",
rep AS (SELECT case_id, r AS replicate FROM cases, range(1, 101) t(r))
SELECT replicate, CAST(CASE WHEN ('0x' || substr(md5(CAST(case_id AS VARCHAR) || '|rs' || CAST(replicate AS VARCHAR)), 1, 13))::BIGINT
       / 4503599627370496.0::DOUBLE < 0.6 THEN 0 ELSE 1 END AS INTEGER) AS split, count(*) AS n
FROM rep GROUP BY ALL""")
def q_x5(spark, sf):
    """Repeated random 60/40 splits (one salt per replicate), sizes per replicate."""
    from ..functions.core import u
    from ..operators.sampling import replicate
    r = replicate(_cases(spark, sf).select("case_id"), 100)
    r = r.withColumn("split", F.when(u("case_id", F.concat(F.lit("rs"), F.col("replicate").cast("string"))) < 0.6, 0)
                     .otherwise(1).cast("int"))
    return r.groupBy("replicate", "split").agg(F.count(F.lit(1)).alias("n"))


_NRM = ["toa", "dpd", "age", "land", "mean_salary"]


@register("x6_min_max", _CASES + ", b AS (SELECT " + ", ".join(
    f"min({c}) AS {c}_lo, max({c}) AS {c}_hi" for c in _NRM) + " FROM cases)\nSELECT case_id, " + ", ".join(
    R(f"CASE WHEN {c} IS NULL THEN NULL WHEN {c}_hi = {c}_lo THEN 0.0 ELSE ({c} - {c}_lo) / ({c}_hi - {c}_lo) END") + f" AS {c}_nrm"
    for c in _NRM) + " FROM cases, b")
def q_x6(spark, sf):
    from ..operators.sampling import min_max
    c = _cases(spark, sf)
    return rounded(min_max(c, _NRM).select("case_id", *[f"{x}_nrm" for x in _NRM]))


# --- D3/D4: segment success ------------------------------------------------------

def _seg_sql(weighting: str) -> str:
    w = "rows_" if weighting == "event_row" else "1"
    extra = ", r.rows_ AS rows_" if weighting == "event_row" else ""
    rows = ", rw AS (SELECT case_id, count(*) AS rows_ FROM payments GROUP BY case_id)" if weighting == "event_row" else ""
    join = "JOIN rw r ON r.case_id = s.case_id" if weighting == "event_row" else ""
    return O.with_ctes(*O.BASE, O.labels_cte()) + rows + f""",
pc AS (SELECT c.land, s.toa, s.sum_payments, s.sum_num_payments{extra} FROM cases c JOIN labels_sums s ON c.case_id = s.case_id {join}),
agg AS (SELECT land, sum(sum_payments * {w}) AS paid, sum(toa * {w}) AS toa_, sum(sum_num_payments * {w}) / sum({w}) AS mean_num_payments,
        CAST(sum({w}) AS BIGINT) AS weight FROM pc GROUP BY land),
f AS (SELECT *, CASE WHEN toa_ IS NULL OR paid IS NULL THEN NULL WHEN toa_ = 0 THEN (CASE WHEN paid > 0 THEN 1 WHEN paid < 0 THEN 0 END)
             WHEN paid / toa_ >= 0.05 THEN 1 ELSE 0 END AS s1, CASE WHEN mean_num_payments > 2 THEN 1 ELSE 0 END AS s2 FROM agg)
SELECT land, CAST(CASE WHEN s2 > s1 THEN s2 ELSE s1 END AS INTEGER) AS segment_success,
       {R('CASE WHEN toa_ <> 0 THEN paid / toa_ END')} AS paid_ratio, {R('mean_num_payments')} AS mean_num_payments, weight
FROM f"""


@register("d3_segment_success", _seg_sql("case"))
def q_d3(spark, sf):
    """D3 (per-case weighting) with land as the segment."""
    from ..operators.label import segment_success
    from ..sources.fixtures import payments_raw
    return rounded(segment_success(_cases(spark, sf), study.clean_payments(payments_raw(spark, sf)), "land"))


@register("d3_a11_segment_success_event_rows", _seg_sql("event_row"))
def q_d3e(spark, sf):
    """D3 exactly as the study weights it: case sums repeated on every payment row."""
    from ..operators.label import segment_success
    from ..sources.fixtures import payments_raw
    return rounded(segment_success(_cases(spark, sf), study.clean_payments(payments_raw(spark, sf)), "land",
                                   weighting="event_row"))


@register("d4_s4_segment_names", _CASES + """
SELECT s.land, n.segment_name, s.n FROM (SELECT land, count(*) AS n FROM cases GROUP BY land) s
LEFT JOIN (SELECT CAST(i AS INTEGER) AS land, 'segment_' || lpad(CAST(i AS VARCHAR), 2, '0') AS segment_name FROM range(1, 21) t(i)) n
ON s.land = n.land""")
def q_d4(spark, sf):
    """Caller-supplied names for segment ids 1..20 from a literal lookup table."""
    from ..operators.label import name_segments
    from ..operators.profile import frequencies
    counts = frequencies(_cases(spark, sf), "land").drop("share")
    names = [f"segment_{i:02d}" for i in range(1, 21)]
    return name_segments(spark, counts, "land", names).select("land", "segment_name", "n")


# --- M10-M13, M20, W4, W7: evaluation on scored rows --------------------------------
# score = sum of quantities of an order, label = sum(extendedprice) >= totalprice,
# grouped by market segment (see FIXTURES.md "Per-segment metrics")

_SCORED_SQL = """
scored AS (
  SELECT c.c_mktsegment AS segment, CAST(sum(l.l_quantity) AS DOUBLE) AS score,
         CAST(sum(l.l_extendedprice) >= o.o_totalprice AS INTEGER) AS label
  FROM orders o JOIN lineitem l ON l.l_orderkey = o.o_orderkey JOIN customer c ON c.c_custkey = o.o_custkey
  GROUP BY o.o_orderkey, o.o_totalprice, c.c_mktsegment)"""


def _scored(spark, sf):
    from ..sources.tables import read_table
    o = read_table(spark, sf, "orders")
    li = read_table(spark, sf, "lineitem")
    c = read_table(spark, sf, "customer")
    per = li.groupBy("l_orderkey").agg(F.sum("l_quantity").alias("score"), F.sum("l_extendedprice").alias("_ext"))
    j = per.join(o, per.l_orderkey == o.o_orderkey).join(c, o.o_custkey == c.c_custkey)
    return j.select(F.col("c_mktsegment").alias("segment"), F.col("score").cast("double").alias("score"),
                    (F.col("_ext") >= F.col("o_totalprice")).cast("int").alias("label"))


_ROC_SQL = O.with_ctes(_SCORED_SQL, """
sc AS (SELECT segment, score, CAST(sum(label) AS BIGINT) AS pos, CAST(sum(1 - label) AS BIGINT) AS neg FROM scored GROUP BY segment, score)""", """
cum AS (SELECT *, sum(pos) OVER w - pos AS pos_before, sum(neg) OVER w - neg AS neg_before,
               sum(pos) OVER (PARTITION BY segment) AS n_pos, sum(neg) OVER (PARTITION BY segment) AS n_neg
        FROM sc WINDOW w AS (PARTITION BY segment ORDER BY score ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))""", """
roc AS (SELECT segment, score AS threshold, pos, neg, pos_before, neg_before, n_pos, n_neg,
               (n_pos - pos_before) / n_pos AS sensitivity, neg_before / n_neg AS specificity,
               ((n_neg - neg_before) + pos_before) / (n_pos + n_neg) AS class_error FROM cum)""")


@register("m10_roc_points", _ROC_SQL + f"""
SELECT segment, threshold, {R('sensitivity')} AS sensitivity, {R('specificity')} AS specificity, {R('class_error')} AS class_error
FROM roc""")
def q_roc(spark, sf):
    from ..operators.metrics import roc_points
    r = roc_points(_scored(spark, sf), "score", "label", "segment")
    return rounded(r.select("segment", "threshold", "sensitivity", "specificity", "class_error"))


@register("m10_m11_m12_m20_evaluate_by_segment", _ROC_SQL + f""",
best AS (SELECT segment, arg_min(struct_pack(threshold, sensitivity, specificity, class_error),
                 struct_pack(d := (1 - sensitivity) ^ 2 + (1 - specificity) ^ 2, t := threshold)) AS b,
                sum(pos * (neg_before + neg / 2.0)) / (max(n_pos) * max(n_neg)) AS auc, max(n_pos) + max(n_neg) AS n
         FROM roc GROUP BY segment)
SELECT segment, {R('auc')} AS auc, b.threshold AS threshold, {R('b.sensitivity')} AS sensitivity,
       {R('b.specificity')} AS specificity, {R('b.class_error')} AS class_error, CAST(n AS BIGINT) AS n FROM best""")
def q_eval(spark, sf):
    """M10 AUC (ties half), M11 closest-top-left threshold, M12 class error at it, M20 per segment."""
    from ..operators.metrics import evaluate_binary
    return rounded(evaluate_binary(_scored(spark, sf), "score", "label", "segment"))


@register("m10_overall_auc", O.with_ctes(_SCORED_SQL, """
sc AS (SELECT score, sum(label) AS pos, sum(1 - label) AS neg FROM scored GROUP BY score)""", """
cum AS (SELECT *, sum(neg) OVER (ORDER BY score ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - neg AS neg_before FROM sc)""") + f"""
SELECT {R('sum(pos * (neg_before + neg / 2.0)) / (sum(pos) * sum(neg))')} AS auc FROM cum""")
def q_auc_all(spark, sf):
    from ..operators.metrics import evaluate_binary
    return rounded(evaluate_binary(_scored(spark, sf), "score", "label").select("auc"))


@register("m12_confusion_at_threshold", O.with_ctes(_SCORED_SQL) + """
SELECT segment, CAST(score >= 150 AS INTEGER) AS pred, label, count(*) AS n FROM scored GROUP BY ALL""")
def q_confusion(spark, sf):
    """Confusion table of the rule score >= 150 per segment."""
    from ..operators.metrics import confusion_counts
    s = _scored(spark, sf).withColumn("pred", (F.col("score") >= 150).cast("int"))
    return confusion_counts(s, "pred", "label", "segment")


@register("m13_regression_error", _CASES + f"""
SELECT is_cash_loan, {R('avg((dpd / 365.0 - contract_days / 365.0) ^ 2)')} AS mse,
       {R('avg(CASE WHEN dpd <> 0 THEN abs(dpd / 365.0 - contract_days / 365.0) / (dpd / 365.0) END)')} AS mean_abs_prop,
       count(*) AS n
FROM cases WHERE dpd IS NOT NULL AND contract_days IS NOT NULL GROUP BY is_cash_loan""")
def q_regerr(spark, sf):
    """MSE and MeanAbsProp (relative to the prediction) of predicting the
    contract age (years) by the days past due (years)."""
    from ..operators.metrics import regression_error
    c = (_cases(spark, sf).where(F.col("dpd").isNotNull() & F.col("contract_days").isNotNull())
         .withColumn("pred", F.col("dpd") / 365.0).withColumn("y", F.col("contract_days") / 365.0))
    return rounded(regression_error(c, "pred", "y", "is_cash_loan"))


# --- M1, M1b, M3: correlation matrix, complete-case matrix, row distances ------------

def _corr_sql(src: str, complete: bool, rnd: bool = True) -> str:
    feats = O.FEATURES
    where = (" WHERE " + " AND ".join(f"{f} IS NOT NULL" for f in feats)) if complete else ""
    pairs = []
    for a in feats:
        for b in feats:
            v = (f"CASE WHEN stddev_samp({a}) > 0 THEN 1.0 END" if a == b else PEARSON(a, b))
            pairs.append(f"SELECT '{a}' AS var_a, '{b}' AS var_b, {R(v) if rnd else v} AS corr FROM src")
    return f"src AS (SELECT * FROM {src}{where})\n" + "\nUNION ALL\n".join(pairs)


@register("m1_corr_matrix", O.with_ctes(*O.labelled()) + ",\n" + _corr_sql("labelled", False))
def q_corr(spark, sf):
    from ..operators.stats import corr_matrix
    return rounded(corr_matrix(study.labelled_cases(spark, sf), study.FEATURES))


@register("m1b_corr_complete_cases", _CASES + ",\n" + _corr_sql("cases", True))
def q_corr_cc(spark, sf):
    """R ``cor(use="complete.obs")`` on the raw (not imputed) cases."""
    from ..operators.stats import corr_matrix
    return rounded(corr_matrix(_cases(spark, sf), study.FEATURES, complete_only=True))


_SQL_M3 = O.with_ctes(*O.labelled()) + ",\ncm AS (" + _corr_sql("labelled", False, rnd=False).replace(
    "src AS (SELECT * FROM labelled)\n", "") + """),
cm0 AS (SELECT var_a, var_b, COALESCE(corr, 0.0) AS corr FROM cm)
SELECT a.var_a AS var_a, b.var_a AS var_b, round(sqrt(sum((a.corr - b.corr) ^ 2)), 6) AS dist
FROM cm0 a JOIN cm0 b ON a.var_b = b.var_b GROUP BY a.var_a, b.var_a"""


@register("m3_corr_row_distances", _SQL_M3.replace("FROM src", "FROM labelled"))
def q_dist(spark, sf):
    """M3 distances: Euclidean distance between rows of the correlation matrix."""
    from ..operators.stats import corr_matrix, row_distances
    cm = corr_matrix(study.labelled_cases(spark, sf), study.FEATURES)
    return rounded(row_distances(cm.fillna(0.0, subset=["corr"])))


@register("m3_correlation_baskets", None)
def q_baskets(spark, sf):
    """M3: complete-linkage baskets (k=4) of the correlation-matrix rows; the
    linkage runs on p points (checked against a NumPy brute force in tests)."""
    from ..operators.stats import correlation_baskets
    return correlation_baskets(study.labelled_cases(spark, sf), study.FEATURES, k=4)


@register("m3_merge_heights", None)
def q_merges(spark, sf):
    """M3: the merges of the feature tree with their heights."""
    from ..operators.stats import merge_table
    return rounded(merge_table(study.labelled_cases(spark, sf), study.FEATURES))


# --- M4-M7, I13: nearest neighbours ----------------------------------------------

POP_FEATURES = [f for f in O.FEATURES if f != "population"]


def _nrm_sql(src: str, feats, name: str, fit: str = "true") -> str:
    """Min-max over ``src`` with bounds from the rows where ``fit`` holds."""
    b = ", ".join(f"min({c}) AS {c}_lo, max({c}) AS {c}_hi" for c in feats)
    cols = ", ".join(
        f"CASE WHEN {c}_hi = {c}_lo THEN 0.0 ELSE (CAST({c} AS DOUBLE) - {c}_lo) / ({c}_hi - {c}_lo) END AS {c}" for c in feats)
    return f"{name}_b AS (SELECT {b} FROM {src} WHERE {fit}),\n{name} AS (SELECT s.* EXCLUDE ({', '.join(feats)}), {cols} FROM {src} s, {name}_b)"


def _dist_sql(a: str, b: str, feats) -> str:
    return "round(sqrt(" + " + ".join(f"({a}.{f} - {b}.{f}) ^ 2" for f in feats) + "), 9)"


_SQL_I13 = O.with_ctes(*O.BASE, O.IMPUTED.replace(
    "imputed AS (SELECT i13.* REPLACE (COALESCE(i13.population, pm.pm) AS population) FROM i13 LEFT JOIN pop_mean pm ON i13.land = pm.land)",
    "imputed AS (SELECT * FROM i13)"), _nrm_sql("imputed", POP_FEATURES, "nrm"), f"""
ok AS (SELECT * FROM nrm WHERE {' AND '.join(f + ' IS NOT NULL' for f in POP_FEATURES)})""", f"""
pairs AS (SELECT q.case_id, t.population AS y, {_dist_sql('q', 't', POP_FEATURES)} AS d, t.case_id AS nk
          FROM ok q, ok t WHERE q.population IS NULL AND t.population IS NOT NULL)""", """
rk AS (SELECT *, row_number() OVER (PARTITION BY case_id ORDER BY d, nk) AS rn FROM pairs)""") + f"""
SELECT case_id, {R('avg(y)')} AS population FROM rk WHERE rn <= 5 GROUP BY case_id"""


@register("m4_i13_knn_population_fill", _SQL_I13)
def q_knn_pop(spark, sf):
    """Population of cases where it is missing = mean over the 5 nearest
    cases (min-max features over all rows, as in the study)."""
    from ..operators.knn import knn_regress
    from ..operators.sampling import min_max
    base = study.imputed_cases(spark, sf, population_fallback=False)
    n = min_max(base, POP_FEATURES, replace=True)
    pred = knn_regress(n.where(F.col("population").isNotNull()), n.where(F.col("population").isNull()),
                       "case_id", POP_FEATURES, "population", 5)
    return rounded(pred.withColumnRenamed("pred", "population"))


KNN_SPLIT = [0.6, 0.2, 0.2]


def _knn_sets(spark, sf):
    """Split rows, features scaled with the bounds of the training rows (no leak of
    validation and test rows into the scale)."""
    from ..operators.sampling import min_max, split

    def build():
        s = split(study.labelled_cases(spark, sf), "case_id", KNN_SPLIT, salt="knn-split")
        return cut_lineage(min_max(s, study.FEATURES, replace=True, fit_on=s.where("split = 0")), "knn_sets")

    return shared(spark, sf, "knn_sets", build)


_SQL_KNN_SETS = [*O.labelled(), f"""
split AS (SELECT *, CASE WHEN {O.U('case_id', 'knn-split')} < 0.6 THEN 0 WHEN {O.U('case_id', 'knn-split')} < 0.8 THEN 1 ELSE 2 END AS split FROM labelled)""",
                 _nrm_sql("split", O.FEATURES, "sets", "split = 0")]


@register("m5_knn_classify", O.with_ctes(*_SQL_KNN_SETS, f"""
pairs AS (SELECT q.case_id, t.suc AS y, {_dist_sql('q', 't', O.FEATURES)} AS d, t.case_id AS nk
          FROM sets q, sets t WHERE q.split = 2 AND t.split = 0)""", """
rk AS (SELECT *, row_number() OVER (PARTITION BY case_id ORDER BY d, nk) AS rn FROM pairs)""") + """
SELECT case_id, CAST(avg(y) >= 0.5 AS INTEGER) AS pred FROM rk WHERE rn <= 50 GROUP BY case_id""")
def q_knn_cls(spark, sf):
    """M5: test-set class by majority vote of the 50 nearest training cases."""
    from ..operators.knn import knn_classify
    s = _knn_sets(spark, sf)
    return knn_classify(s.where("split = 0"), s.where("split = 2"), "case_id", study.FEATURES, study.LABEL, 50)


KNN_KS = [10, 50, *range(100, 1001, 100)]


@register("m6_knn_select_k", O.with_ctes(*_SQL_KNN_SETS, f"""
pairs AS (SELECT q.case_id, q.suc AS truth, t.suc AS y, {_dist_sql('q', 't', O.FEATURES)} AS d, t.case_id AS nk
          FROM sets q, sets t WHERE q.split = 1 AND t.split = 0)""", """
rk AS (SELECT *, row_number() OVER (PARTITION BY case_id ORDER BY d, nk) AS rn FROM pairs)""", """
cum AS (SELECT case_id, truth, rn, sum(y) OVER (PARTITION BY case_id ORDER BY rn ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS cy
        FROM rk WHERE rn <= 1000)""") + f"""
SELECT CAST(rn AS INTEGER) AS k, {R('1.0 / rn')} AS complex, {R('avg(CASE WHEN CAST(cy / rn >= 0.5 AS INTEGER) <> truth THEN 1.0 ELSE 0.0 END)')} AS class_error
FROM cum WHERE rn IN ({', '.join(map(str, KNN_KS))}) GROUP BY rn""")
def q_knn_k(spark, sf):
    """M6: validation error for every k of the grid from one neighbour pass at k=1000."""
    from ..operators.knn import knn_select_k
    s = _knn_sets(spark, sf)
    return rounded(knn_select_k(s.where("split = 0"), s.where("split = 1"), "case_id", study.FEATURES, study.LABEL, KNN_KS))


@register("m7_knn_removal_importance", None)
def q_knn_removal(spark, sf):
    """M7: test error with each feature / each basket removed over the full-model
    error (PropOfErr) and its rank; all 1 + p + B models in one neighbour pass."""
    from ..operators.knn import knn_removal_importance
    from ..operators.ranking import rank_by
    from ..operators.stats import correlation_baskets
    s = _knn_sets(spark, sf)
    baskets = {r.var: r.basket_id for r in correlation_baskets(s.where("split = 0"), study.FEATURES).collect()}
    groups = {f: [f] for f in study.FEATURES}
    for b in sorted(set(baskets.values())):
        groups[f"basket_{b}"] = [f for f in study.FEATURES if baskets[f] == b]
    imp = knn_removal_importance(s.where("split = 0"), s.where("split = 2"), "case_id", study.FEATURES, study.LABEL, 50, groups)
    imp = imp.withColumn("kind", F.when(F.col("name").startswith("basket_"), "basket").when(F.col("name") == "All", "all")
                         .otherwise("feature"))
    return rounded(rank_by(imp, "prop_of_err", ascending=False, tiebreak=["name"], out="rank", by=["kind"]))


# --- Stage C: models, importance, consensus (no SQL form: model fits) -------------------

from . import ranking_study as RS  # noqa: E402


@register("m14_m15_gbt_grid_stage1", None)
def q_grid1(spark, sf):
    """M14 stage 1 + M15: one row per (grid point, feature): validation class error,
    threshold, AUC, relative influence."""
    return rounded(RS.boosting_grid_1(spark, sf))


@register("m14_gbt_grid_stage2", None)
def q_grid2(spark, sf):
    """M14 stage 2 (stage-1 winners fixed): shrinkage x trees."""
    return rounded(RS.boosting_grid_2(spark, sf))


@register("m16_a8_select_features", None)
def q_select(spark, sf):
    """Mean relative influence per feature over the stage-2 grid, > 2 flag."""
    from ..operators.models import select_features
    return rounded(select_features(RS.boosting_grid_2(spark, sf)))


@register("m8_m17_m19_gbt_permutation_features", None)
def q_gbt_perm(spark, sf):
    """M8 + M17 + M19: boosted model, permutation of each feature on the test set:
    class error / AUC / sensitivity / specificity and ratios to the baseline."""
    return rounded(RS.boosting_permutations(spark, sf))


@register("m18_m21_basket_ranks_boosting", None)
def q_gbt_baskets(spark, sf):
    """M18 + M21: basket permutation ranks and mean relative influence rank."""
    return rounded(RS.boosting_basket_ranks(spark, sf))


@register("m15_gbt_relative_influence", None)
def q_relinf(spark, sf):
    return rounded(RS.relative_influence(spark, sf))


@register("m9_logit_pvalues", None)
def q_logit_p(spark, sf):
    """M9: Wald p-values of the logistic regression (aliased features NULL)."""
    return rounded(RS.logit_fit(spark, sf)["pvalues"])


@register("m9_m17_logit_permutation", None)
def q_logit_perm(spark, sf):
    return rounded(RS.logit(spark, sf)["perm"])


@register("j5_boosting_stats_by_feature", None)
def q_j5_boost(spark, sf):
    return rounded(RS.boosting_feature_stats(spark, sf))


@register("j5_boosting_stats_by_basket", None)
def q_j5_boost_b(spark, sf):
    return rounded(RS.boosting_basket_stats(spark, sf))


@register("j5_logit_stats_by_feature", None)
def q_j5_logit(spark, sf):
    return rounded(RS.logit_feature_stats(spark, sf))


@register("j5_logit_stats_by_basket", None)
def q_j5_logit_b(spark, sf):
    return rounded(RS.logit_basket_stats(spark, sf))


@register("m6_m7_knn_model_ranks", None)
def q_knn_ranks(spark, sf):
    return rounded(RS.knn(spark, sf)["removal"])


@register("m23_consensus_feature_rank", None)
def q_consensus(spark, sf):
    """The study's result: nine ranks per feature, mean, place."""
    return rounded(RS.consensus_features(spark, sf))


@register("m24_consensus_basket_rank", None)
def q_consensus_b(spark, sf):
    """Seven ranks per basket, mean, place."""
    return rounded(RS.consensus_baskets(spark, sf))


# --- M22 + portfolio tables (A13, D3, D4, M20) ----------------------------------------

def portfolios(spark, sf):
    """M22 on the min-max scaled labelled features: 20 portfolios (CLARA, 100 samples of 500)."""
    def build():
        from ..operators.cluster import clara
        from ..operators.sampling import min_max
        from ..session import cut_lineage
        n = cut_lineage(min_max(RS.model_sets(spark, sf), study.FEATURES, suffix="_nrm"), "portfolio_input")
        out, med = clara(n, "case_id", [f"{f}_nrm" for f in study.FEATURES], k=20, samples=100, sampsize=500, out="portfolio")
        return cut_lineage(out.drop(*[f"{f}_nrm" for f in study.FEATURES]), "portfolios"), med
    return shared(spark, sf, "portfolios", build)


@register("m22_clara_portfolios", None)
def q_clara(spark, sf):
    """Portfolio (cluster 1..20) of every labelled case."""
    return portfolios(spark, sf)[0].select("case_id", "portfolio")


@register("a13_portfolio_histogram", None)
def q_port_hist(spark, sf):
    """Histogram of the portfolio ids (breaks 0..20)."""
    from ..operators.profile import histogram
    return histogram(portfolios(spark, sf)[0], "portfolio", list(range(0, 21)))


@register("d3_d4_portfolio_success", None)
def q_port_success(spark, sf):
    """D3 + D4 per CLARA portfolio, with the portfolio names attached."""
    from ..operators.label import name_segments, segment_success
    from ..sources.fixtures import payments_raw
    p = portfolios(spark, sf)[0]
    seg = segment_success(p, study.clean_payments(payments_raw(spark, sf)), "portfolio", weighting="event_row")
    return rounded(name_segments(spark, seg, "portfolio", [f"portfolio_{i:02d}" for i in range(1, 21)]))


@register("m20_gbt_eval_by_portfolio", None)
def q_port_eval(spark, sf):
    """Boosted model AUC / class error per portfolio on the test split."""
    from ..operators import models as M
    from ..operators.metrics import evaluate_binary
    model = RS.boosted_model(spark, sf)
    p = portfolios(spark, sf)[0].where("split = 2")
    return rounded(evaluate_binary(M.score(model, p, study.FEATURES, levels=RS.factor_levels(spark, sf)), "score", study.LABEL, by="portfolio"))


@register("w5_top6_features", None)
def q_top6(spark, sf):
    """The six features with the best consensus place (a top-k report)."""
    from ..operators.ranking import top_k
    return top_k(RS.consensus_features(spark, sf), "place", 6, ascending=True, tiebreak=["var"]).select(
        "var", "place", "avg_place")


# the k grid of m6 on the model sets' split, its best row
@register("w4_best_k_knn", "SELECT * FROM (" + ORACLE["m6_knn_select_k"].replace("knn-split", "model-split") + ") ORDER BY class_error, k LIMIT 1")
def q_bestk(spark, sf):
    """Argmin row of the kNN k grid (best k)."""
    from ..operators.ranking import best_row
    return rounded(best_row(RS.knn_errors(spark, sf), "class_error", tiebreak=["k"]))


# --- I11-I13 with M8b/M8c/M13: the study's model fills -----------------------------------

def _model_imputed(spark, sf):
    return shared(spark, sf, "model_imputed", lambda: study.model_imputed_cases(spark, sf))


@register("i11_i12_i13_model_imputed_cases", None)
def q_model_imputed(spark, sf):
    """Stage A with forest (I11), boosting (I12) and kNN (I13) fills: no NULL
    feature left in cases that have lineitems."""
    return rounded(_model_imputed(spark, sf)[0])


@register("m13_model_fill_errors", None)
def q_model_fill_err(spark, sf):
    """M13 on the hold-out rows of the two model fills (MSE, MeanAbsProp)."""
    errs = _model_imputed(spark, sf)[1]
    out = None
    for col, e in errs.items():
        e = e.withColumn("column", F.lit(col))
        out = e if out is None else out.unionByName(e)
    return rounded(out.select("column", "mse", "mean_abs_prop", "n"))


@register("a14_j7_relinf_by_basket", None)
def q_relinf_box(spark, sf):
    """J7 + A14: every grid fit's relative influence joined to the feature's basket,
    box statistics per (basket, feature)."""
    from ..operators.profile import box_stats
    g = RS.boosting_grid_1(spark, sf).join(F.broadcast(RS.baskets(spark, sf)), "var")
    return rounded(box_stats(g, "rel_inf", ["basket_id", "var"]))


@register("m6b_a10_knn_population_k_grid", None)
def q_knn_kgrid(spark, sf):
    """M6b + X5 + A10: kNN regression of population, k in {5..10, 20, 30}, over
    100 repeated 60% resamples, scored on the resample's own rows; mean errors per k."""
    from ..operators.knn import knn_regress_k_grid
    from ..operators.sampling import min_max
    base = study.imputed_cases(spark, sf, population_fallback=False)
    n = min_max(base, POP_FEATURES, replace=True).where(F.col("population").isNotNull())
    per = knn_regress_k_grid(n, "case_id", POP_FEATURES, "population", [5, 6, 7, 8, 9, 10, 20, 30], resamples=100)
    return rounded(per.groupBy("k", "complex").agg(F.avg("mse").alias("mean_mse"),
                                                   F.avg("mean_abs_prop").alias("mean_abs_prop"),
                                                   F.count(F.lit(1)).alias("resamples")))
