"""Case/payment tables derived from the given TPC-H-like tables.

The study works on two inputs: ``cases`` (one row per case, application
features with gaps) and ``payments`` (one row per case and payment). Both are
derived here from ``orders``/``lineitem``/``customer``/``nation`` with plain
joins and aggregates, so their size grows with the input. Gaps are cut in with
the hash uniform (``u(case_id, 'mask:<col>') < MASK_RATE``), identical in the
DuckDB oracle (``caserank.plans.oracle_sql``).

Fixed values (must be equal in the Spark build and in the oracle SQL):
  import date ................ 2002-01-01 (DPD, months since last payment)
  month origin year .......... 1995 (payment month index)
  mask rate .................. 0.1 for case columns, 0.05 for payment columns
  negative payment rate ...... 0.03
  cash-loan priorities ....... '1-URGENT', '2-HIGH'
  company segment ............ 'MACHINERY' (no gender, age sentinel -1)
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.core import u
from .tables import read_table

IMPORT_DATE = "2002-01-01"
IMPORT_MONTH_INDEX = 2002 * 12 + 1
MONTH_ORIGIN_YEAR = 1995
MASK_RATE = 0.1
PAYMENT_MASK_RATE = 0.05
NEGATIVE_RATE = 0.03
CASH_LOAN_PRIORITIES = ("1-URGENT", "2-HIGH")
COMPANY_SEGMENT = "MACHINERY"
AGE_SENTINEL = -1

# model features in table order (19, as in the study); the label and keys are not features
FEATURES = [
    "toa", "loan_amount", "principal", "interest", "other",
    "external_agency", "bailiff", "closed_execution",
    "population", "mean_salary", "gdp_per_capita", "land", "age",
    "dpd", "contract_days", "last_payment_amount", "m_last_payment",
    "is_female", "is_cash_loan",
]
BINARY_FEATURES = ["external_agency", "bailiff", "closed_execution", "is_female", "is_cash_loan"]
MASKED = [
    "other", "population", "mean_salary", "gdp_per_capita", "land",
    "dpd", "contract_days", "last_payment_amount", "m_last_payment",
]


def mask(value: Column, key: str, name: str, rate: float = MASK_RATE) -> Column:
    return F.when(u(key, f"mask:{name}") < F.lit(rate), F.lit(None)).otherwise(value)


def payments_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """payments with gaps and reversals: (case_id, month, payment_amount, number_of_payment)."""
    li = read_table(spark, sf_dir, "lineitem")
    k = F.concat_ws("|", *[F.col(c).cast("string") for c in ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")])
    amount = F.col("l_extendedprice") * (F.lit(1.0) - F.col("l_discount"))
    return li.select(
        F.col("l_orderkey").alias("case_id"),
        ((F.year("l_shipdate") - MONTH_ORIGIN_YEAR) * 12 + F.month("l_shipdate")).cast("int").alias("month"),
        F.when(u(k, "mask:payment_amount") < F.lit(PAYMENT_MASK_RATE), F.lit(None).cast("double"))
        .when(u(k, "neg:payment_amount") < F.lit(NEGATIVE_RATE), -amount)
        .otherwise(amount).alias("payment_amount"),
        F.when(u(k, "mask:number_of_payment") < F.lit(PAYMENT_MASK_RATE), F.lit(None).cast("int"))
        .otherwise(F.lit(1)).alias("number_of_payment"),
    )


def case_amounts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Key and total amount of every case, without the other features' joins."""
    return read_table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("case_id"), F.col("o_totalprice").alias("toa"))


def cases_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per order, application features with natural and masked gaps."""
    o = read_table(spark, sf_dir, "orders")
    li = read_table(spark, sf_dir, "lineitem")
    c = read_table(spark, sf_dir, "customer")
    n = read_table(spark, sf_dir, "nation")
    per_order = li.groupBy("l_orderkey").agg(
        F.sum("l_extendedprice").alias("loan_amount"),
        F.sum(F.col("l_extendedprice") * (F.lit(1.0) - F.col("l_discount"))).alias("principal"),
        F.sum(F.col("l_extendedprice") * F.col("l_tax")).alias("interest"),
        F.max((F.col("l_returnflag") == "R").cast("int")).alias("external_agency"),
        F.max((F.col("l_returnflag") == "A").cast("int")).alias("bailiff"),
        F.max((F.col("l_linestatus") == "O").cast("int")).alias("closed_execution"),
        # latest payment: by (shipdate, line number), ties by amount
        F.max(F.struct("l_shipdate", "l_linenumber", "l_extendedprice")).alias("_last"),
    )
    cn = c.join(n.select("n_nationkey", "n_regionkey"), c.c_nationkey == n.n_nationkey, "left")
    per_nation = c.groupBy("c_nationkey").agg(
        F.avg("c_acctbal").alias("_nation_bal"), F.count(F.lit(1)).alias("_nation_pop")
    )
    per_region = cn.groupBy("n_regionkey").agg(F.avg("c_acctbal").alias("_region_bal"))
    cust = (
        cn.join(per_nation, "c_nationkey", "left")
        .join(per_region, "n_regionkey", "left")
        .select("c_custkey", "c_nationkey", "c_acctbal", "c_mktsegment", "_nation_bal", "_nation_pop", "_region_bal")
    )
    j = o.join(per_order, o.o_orderkey == per_order.l_orderkey, "left").join(
        cust, o.o_custkey == cust.c_custkey, "left"
    )
    key = "o_orderkey"
    days = F.datediff(F.lit(IMPORT_DATE).cast("date"), F.to_date("o_orderdate"))
    company = F.col("c_mktsegment") == COMPANY_SEGMENT
    last_month = F.year("_last.l_shipdate") * 12 + F.month("_last.l_shipdate")
    return j.select(
        F.col("o_orderkey").alias("case_id"),
        F.when(company, F.lit(None)).when(F.col("c_custkey") % 2 == 1, F.lit("FEMALE"))
        .otherwise(F.lit("MALE")).alias("gender"),
        F.when(F.col("o_orderpriority").isin(*CASH_LOAN_PRIORITIES), F.lit("Cash loan"))
        .otherwise(F.lit("Credit card")).alias("product"),
        F.col("o_totalprice").alias("toa"),
        "loan_amount", "principal", "interest",
        mask(F.col("o_totalprice") - (F.col("principal") + F.col("interest")) + F.col("c_acctbal"), key, "other").alias("other"),
        "external_agency", "bailiff", "closed_execution",
        mask(F.col("_nation_pop").cast("double"), key, "population").alias("population"),
        mask(F.col("_nation_bal"), key, "mean_salary").alias("mean_salary"),
        mask(F.col("_region_bal"), key, "gdp_per_capita").alias("gdp_per_capita"),
        mask(F.col("c_nationkey").cast("int"), key, "land").alias("land"),
        F.when(company, F.lit(AGE_SENTINEL)).otherwise(F.lit(18) + F.col("c_custkey") % 60).cast("int").alias("age"),
        mask(days.cast("int"), key, "dpd").alias("dpd"),
        mask((days + F.lit(30) * (F.col("o_custkey") % 12)).cast("int"), key, "contract_days").alias("contract_days"),
        mask(F.col("_last.l_extendedprice"), key, "last_payment_amount").alias("last_payment_amount"),
        mask((F.lit(IMPORT_MONTH_INDEX) - last_month).cast("int"), key, "m_last_payment").alias("m_last_payment"),
    )
