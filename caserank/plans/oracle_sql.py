"""DuckDB SQL that recomputes the Spark results independently (correctness oracle).

The fixture CTEs restate ``sources.fixtures`` and ``plans.study`` in SQL; the
hash uniform is ``('0x'||substr(md5(key||'|salt'),1,13))::BIGINT / 2^52``, equal
bit for bit to the Spark expression. Doubles are rounded to 6 places in both
engines before comparison.
"""

from __future__ import annotations

FEATURES = [
    "toa", "loan_amount", "principal", "interest", "other",
    "external_agency", "bailiff", "closed_execution",
    "population", "mean_salary", "gdp_per_capita", "land", "age",
    "dpd", "contract_days", "last_payment_amount", "m_last_payment",
    "is_female", "is_cash_loan",
]


def U(key: str, salt: str) -> str:
    return f"(('0x' || substr(md5(CAST({key} AS VARCHAR) || '|{salt}'), 1, 13))::BIGINT / 4503599627370496.0::DOUBLE)"


def MASK(expr: str, name: str, rate: float = 0.1) -> str:
    return f"CASE WHEN {U('o.o_orderkey', 'mask:' + name)} < {rate} THEN NULL ELSE {expr} END"


_LK = "concat_ws('|', CAST(l_orderkey AS VARCHAR), CAST(l_linenumber AS VARCHAR), CAST(l_partkey AS VARCHAR), CAST(l_suppkey AS VARCHAR))"

PAYMENTS_RAW = f"""
payments_raw AS (
  SELECT l_orderkey AS case_id,
         CAST((year(l_shipdate) - 1995) * 12 + month(l_shipdate) AS INTEGER) AS month,
         CASE WHEN {U(_LK, 'mask:payment_amount')} < 0.05 THEN NULL
              WHEN {U(_LK, 'neg:payment_amount')} < 0.03 THEN -(l_extendedprice * (1.0 - l_discount))
              ELSE l_extendedprice * (1.0 - l_discount) END AS payment_amount,
         CASE WHEN {U(_LK, 'mask:number_of_payment')} < 0.05 THEN NULL ELSE 1 END::INTEGER AS number_of_payment
  FROM lineitem
)"""

PAYMENTS = """
payments AS (
  SELECT case_id, month,
         COALESCE(CASE WHEN payment_amount < 0.0 THEN 0.0 ELSE payment_amount END, 0.0) AS payment_amount,
         COALESCE(number_of_payment, 0)::INTEGER AS number_of_payment
  FROM payments_raw
)"""

CASES_RAW = f"""
per_order AS (
  SELECT l_orderkey,
         sum(l_extendedprice) AS loan_amount,
         sum(l_extendedprice * (1.0 - l_discount)) AS principal,
         sum(l_extendedprice * l_tax) AS interest,
         max(CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END) AS external_agency,
         max(CASE WHEN l_returnflag = 'A' THEN 1 ELSE 0 END) AS bailiff,
         max(CASE WHEN l_linestatus = 'O' THEN 1 ELSE 0 END) AS closed_execution
  FROM lineitem GROUP BY l_orderkey
),
last_line AS (
  SELECT l_orderkey, l_shipdate AS last_ship, l_extendedprice AS last_amount FROM (
    SELECT l_orderkey, l_shipdate, l_extendedprice,
           row_number() OVER (PARTITION BY l_orderkey ORDER BY l_shipdate DESC, l_linenumber DESC, l_extendedprice DESC) AS rn
    FROM lineitem) WHERE rn = 1
),
per_nation AS (SELECT c_nationkey, avg(c_acctbal) AS nation_bal, count(*) AS nation_pop FROM customer GROUP BY c_nationkey),
per_region AS (
  SELECT n_regionkey, avg(c_acctbal) AS region_bal
  FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey GROUP BY n_regionkey
),
cust AS (
  SELECT c.c_custkey, c.c_nationkey, c.c_acctbal, c.c_mktsegment, pn.nation_bal, pn.nation_pop, pr.region_bal
  FROM customer c LEFT JOIN nation n ON c.c_nationkey = n.n_nationkey
  LEFT JOIN per_nation pn ON c.c_nationkey = pn.c_nationkey
  LEFT JOIN per_region pr ON n.n_regionkey = pr.n_regionkey
),
cases_raw AS (
  SELECT o.o_orderkey AS case_id,
         CASE WHEN cu.c_mktsegment = 'MACHINERY' THEN NULL WHEN cu.c_custkey % 2 = 1 THEN 'FEMALE' ELSE 'MALE' END AS gender,
         CASE WHEN o.o_orderpriority IN ('1-URGENT', '2-HIGH') THEN 'Cash loan' ELSE 'Credit card' END AS product,
         o.o_totalprice AS toa,
         po.loan_amount, po.principal, po.interest,
         {MASK('o.o_totalprice - (po.principal + po.interest) + cu.c_acctbal', 'other')} AS other,
         po.external_agency::INTEGER AS external_agency, po.bailiff::INTEGER AS bailiff,
         po.closed_execution::INTEGER AS closed_execution,
         {MASK('CAST(cu.nation_pop AS DOUBLE)', 'population')} AS population,
         {MASK('cu.nation_bal', 'mean_salary')} AS mean_salary,
         {MASK('cu.region_bal', 'gdp_per_capita')} AS gdp_per_capita,
         {MASK('CAST(cu.c_nationkey AS INTEGER)', 'land')} AS land,
         CAST(CASE WHEN cu.c_mktsegment = 'MACHINERY' THEN -1 ELSE 18 + cu.c_custkey % 60 END AS INTEGER) AS age,
         {MASK("CAST(date_diff('day', CAST(o.o_orderdate AS DATE), DATE '2002-01-01') AS INTEGER)", 'dpd')} AS dpd,
         {MASK("CAST(date_diff('day', CAST(o.o_orderdate AS DATE), DATE '2002-01-01') + 30 * (o.o_custkey % 12) AS INTEGER)", 'contract_days')} AS contract_days,
         {MASK('ll.last_amount', 'last_payment_amount')} AS last_payment_amount,
         {MASK('CAST(24025 - (year(ll.last_ship) * 12 + month(ll.last_ship)) AS INTEGER)', 'm_last_payment')} AS m_last_payment
  FROM orders o
  LEFT JOIN per_order po ON o.o_orderkey = po.l_orderkey
  LEFT JOIN last_line ll ON o.o_orderkey = ll.l_orderkey
  LEFT JOIN cust cu ON o.o_custkey = cu.c_custkey
),
cases AS (
  SELECT case_id, toa, loan_amount, principal, interest, other, external_agency, bailiff, closed_execution,
         population, mean_salary, gdp_per_capita, land, age, dpd, contract_days, last_payment_amount, m_last_payment,
         CAST(CASE WHEN gender IS NULL THEN NULL WHEN gender = 'FEMALE' THEN 1 ELSE 0 END AS INTEGER) AS is_female,
         CAST(CASE WHEN product IS NULL THEN NULL WHEN product = 'Cash loan' THEN 1 ELSE 0 END AS INTEGER) AS is_cash_loan
  FROM cases_raw
)"""


def _cdf(src: str, col: str, name: str) -> str:
    return f"""
{name} AS (
  SELECT v, (hi - c) / n AS plo, hi / n AS phi FROM (
    SELECT v, c, sum(c) OVER (ORDER BY v ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS hi, sum(c) OVER () AS n
    FROM (SELECT {col} AS v, count(*) AS c FROM {src} WHERE {col} IS NOT NULL GROUP BY {col})))"""


def _empirical(src: str, col: str, cdf: str) -> str:
    return (f"COALESCE({src}.{col}, (SELECT v FROM {cdf} WHERE {U(src + '.case_id', 'emp:' + col)} >= plo "
            f"AND {U(src + '.case_id', 'emp:' + col)} < phi))")


IMPUTED = f"""
i1 AS (SELECT * REPLACE (COALESCE(other, toa - (principal + interest)) AS other) FROM cases),
i2 AS (SELECT * REPLACE (COALESCE(contract_days, CAST(floor((SELECT median(contract_days) FROM i1)) AS INTEGER)) AS contract_days) FROM i1),
probs AS (SELECT avg(bailiff) AS pb, avg(closed_execution) AS pce, avg(external_agency) AS pea FROM i2),
i3 AS (SELECT * REPLACE (COALESCE(bailiff, CASE WHEN {U('case_id', 'bern:bailiff')} < (SELECT pb FROM probs) THEN 1 ELSE 0 END)::INTEGER AS bailiff) FROM i2),
i4 AS (SELECT * REPLACE (COALESCE(closed_execution,
          CASE WHEN bailiff = 0 THEN 0
               WHEN bailiff = 1 THEN CASE WHEN {U('case_id', 'bern:closed_execution')} < (SELECT pce FROM probs) THEN 1 ELSE 0 END END)::INTEGER AS closed_execution,
        COALESCE(external_agency, CASE WHEN {U('case_id', 'bern:external_agency')} < (SELECT pea FROM probs) THEN 1 ELSE 0 END)::INTEGER AS external_agency) FROM i3),
{_cdf('i4', 'land', 'land_cdf').strip()},
i5 AS (SELECT * REPLACE (CAST({_empirical('i4', 'land', 'land_cdf')} AS INTEGER) AS land) FROM i4),
land_means AS (SELECT land, avg(mean_salary) AS ms, avg(gdp_per_capita) AS gdp FROM i5 GROUP BY land),
i6 AS (SELECT i5.* REPLACE (COALESCE(i5.mean_salary, lm.ms) AS mean_salary) FROM i5 LEFT JOIN land_means lm ON i5.land = lm.land),
i7 AS (SELECT i6.* REPLACE (COALESCE(i6.gdp_per_capita, lm.gdp) AS gdp_per_capita) FROM i6 LEFT JOIN land_means lm ON i6.land = lm.land),
i8 AS (SELECT * REPLACE (COALESCE(is_female, 1)::INTEGER AS is_female) FROM i7),
donors AS (SELECT age AS dv, row_number() OVER (ORDER BY {U('case_id', 'donor:age:order')}, case_id) AS dpos
           FROM i8 WHERE is_female = 1 AND age <> -1),
i9 AS (SELECT i8.* REPLACE (CASE WHEN i8.age = -1 THEN COALESCE(
          (SELECT dv FROM donors WHERE dpos = floor({U('i8.case_id', 'donor:age')} * (SELECT count(*) FROM donors)) + 1), i8.age)
          ELSE i8.age END::INTEGER AS age) FROM i8),
loan_med AS (SELECT is_cash_loan, median(loan_amount) AS med FROM i9 WHERE is_cash_loan IS NOT NULL GROUP BY is_cash_loan),
i10 AS (SELECT i9.* REPLACE (COALESCE(i9.loan_amount, lm.med) AS loan_amount) FROM i9 LEFT JOIN loan_med lm ON i9.is_cash_loan = lm.is_cash_loan),
{_cdf('i10', 'm_last_payment', 'mlp_cdf').strip()},
i11 AS (SELECT * REPLACE (CAST({_empirical('i10', 'm_last_payment', 'mlp_cdf')} AS INTEGER) AS m_last_payment) FROM i10),
lpa_med AS (SELECT m_last_payment, median(last_payment_amount) AS med FROM i11 WHERE m_last_payment IS NOT NULL GROUP BY m_last_payment),
i12 AS (SELECT i11.* REPLACE (COALESCE(i11.last_payment_amount, lm.med) AS last_payment_amount) FROM i11 LEFT JOIN lpa_med lm ON i11.m_last_payment = lm.m_last_payment),
i13 AS (SELECT * REPLACE (COALESCE(dpd, CAST(round_even((SELECT median(dpd) FROM i12), 0) AS INTEGER)) AS dpd) FROM i12),
pop_mean AS (SELECT land, avg(population) AS pm FROM i13 GROUP BY land),
imputed AS (SELECT i13.* REPLACE (COALESCE(i13.population, pm.pm) AS population) FROM i13 LEFT JOIN pop_mean pm ON i13.land = pm.land)"""


def labels_cte(min_ratio: float = 0.05, min_count: int = 2, name: str = "labels") -> str:
    return f"""
{name}_sums AS (
  SELECT p.case_id, c.toa, p.sum_payments, p.sum_num_payments FROM
    (SELECT case_id, sum(payment_amount) AS sum_payments, CAST(sum(number_of_payment) AS BIGINT) AS sum_num_payments
     FROM payments GROUP BY case_id) p
  LEFT JOIN cases_raw c ON c.case_id = p.case_id
),
{name}_parts AS (
  SELECT case_id,
    CAST(CASE WHEN toa IS NULL OR sum_payments IS NULL THEN NULL
         WHEN toa = 0 THEN (CASE WHEN sum_payments > 0 THEN 1 WHEN sum_payments < 0 THEN 0 END)
         WHEN sum_payments / toa >= {min_ratio} THEN 1 ELSE 0 END AS INTEGER) AS suc1,
    CAST(sum_num_payments >= {min_count} AS INTEGER) AS suc2
  FROM {name}_sums
),
{name} AS (SELECT case_id, suc1, suc2, CAST(CASE WHEN suc2 > suc1 THEN suc2 ELSE suc1 END AS INTEGER) AS suc FROM {name}_parts)"""


def with_ctes(*parts: str) -> str:
    return "WITH " + ",\n".join(p.strip() for p in parts)


BASE = [PAYMENTS_RAW, PAYMENTS, CASES_RAW]


def labelled(min_ratio: float = 1.0, min_count: int = 6) -> list[str]:
    """CTE list ending in ``labelled``: imputed cases with the label."""
    return [*BASE, IMPUTED, labels_cte(min_ratio, min_count), """
labelled AS (
  SELECT i.*, l.suc FROM imputed i JOIN labels l ON i.case_id = l.case_id WHERE l.suc IS NOT NULL
)"""]
