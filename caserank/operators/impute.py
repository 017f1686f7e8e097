"""Imputation operators, one per policy (I1-I10; model fills I11-I13 live in
``models``/``knn`` and are wired in ``plans.study``).

Every operator returns the input with ``col`` filled and, if ``flag`` is set, a
``<col>_imputed`` 0/1 column. Statistics are computed with one distributed
aggregate and attached either as a scalar subquery (global statistic) or by an
equi-join on the group key (group statistic; the statistic table has one row per
group, is a stage table and is broadcast when small). Random draws use the hash uniform
``u(key, salt)``, so a fill is the same at any partitioning and on retry.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.core import u
from ..session import cut_lineage
from .positions import UNIFORM_BUCKETS, cumulative_before, exact_median, quantiles_of, uniform_bucket, with_positions


def _flagged(df: DataFrame, col: str, new: Column, flag: bool) -> DataFrame:
    if flag:
        df = df.withColumn(f"{col}_imputed", F.col(col).isNull().cast("int"))
    return df.withColumn(col, F.coalesce(F.col(col), new.cast(df.schema[col].dataType)))


def fill_constant(df: DataFrame, col: str, value, flag: bool = False) -> DataFrame:
    """NULL -> constant."""
    return _flagged(df, col, F.lit(value), flag)


def clip(df: DataFrame, col: str, lower=None, upper=None) -> DataFrame:
    """Clip non-NULL values to [lower, upper]; NULL stays NULL."""
    c = F.col(col)
    if lower is not None:
        c = F.when(c < F.lit(lower), F.lit(lower)).otherwise(c)
    if upper is not None:
        c = F.when(c > F.lit(upper), F.lit(upper)).otherwise(c)
    return df.withColumn(col, c.cast(df.schema[col].dataType))


def fill_expr(df: DataFrame, col: str, expr: Column, where: Column | None = None, flag: bool = False) -> DataFrame:
    """NULL -> expression of other columns (NULL if an input is NULL)."""
    e = expr if where is None else F.when(where, expr)
    return _flagged(df, col, e, flag)


def global_stat(df: DataFrame, col: str, stat: str) -> Column:
    """One global statistic as a scalar subquery column (mean, median, min, max)."""
    if stat == "median":
        return exact_median(df, col).select("median").scalar()
    fn = {"mean": F.avg, "min": F.min, "max": F.max}[stat]
    return df.select(fn(col)).scalar()


def global_medians(df: DataFrame, cols: Sequence[str]) -> dict[str, Column]:
    """The medians of several columns from the same passes, as scalar subquery columns."""
    q = quantiles_of(df, cols, [0.5])
    return {c: q.where(F.col("column") == c).select("q").scalar() for c in cols}


def fill_stat(df: DataFrame, col: str, stat: str = "median", flag: bool = False, post=None,
              source: DataFrame | None = None, value: Column | None = None) -> DataFrame:
    """I4: NULL -> global mean/median of the observed values (of ``source``, default ``df``), or
    the ``value`` found with others'."""
    v = value if value is not None else global_stat(source if source is not None else df, col, stat)
    return _flagged(df, col, post(v) if post else v, flag)


def group_stat(df: DataFrame, col: str, by: Sequence[str] | str, stat: str = "mean", out: str | None = None) -> DataFrame:
    """A4/A5: per-group mean or exact median (NULLs skipped)."""
    by = [by] if isinstance(by, str) else list(by)
    out = out or f"{col}_{stat}"
    if stat == "median":
        return exact_median(df.where(F.col(by[0]).isNotNull()) if len(by) == 1 else df, col, by, out)
    fn = {"mean": F.avg, "min": F.min, "max": F.max}[stat]
    return df.groupBy(*by).agg(fn(col).alias(out))


def fill_group_stat(df: DataFrame, col: str, by: Sequence[str] | str, stat: str = "mean", flag: bool = False,
                    source: DataFrame | None = None) -> DataFrame:
    """NULL -> statistic of its group (one aggregate + an equi-join, no per-group loop).

    The statistic table has one row per group and is a stage table, so its size is known when
    the join is planned: a small one is broadcast and ``df`` is not shuffled, as by AQE it
    would be to one task a group (few groups leave many partitions empty)."""
    by = [by] if isinstance(by, str) else list(by)
    st = cut_lineage(group_stat(source if source is not None else df, col, by, stat, out="_gstat"), "group_stat")
    j = df.join(st, on=by, how="left")
    return _flagged(j, col, F.col("_gstat"), flag).drop("_gstat").select(*df.columns, *([f"{col}_imputed"] if flag else []))


def fill_group_means(df: DataFrame, cols: Sequence[str], by: str, source: DataFrame | None = None, flag: bool = False) -> DataFrame:
    """I8 for several columns of one grouping: one aggregate and one join for all, as in
    ``fill_group_stat``."""
    src = source if source is not None else df
    st = cut_lineage(src.groupBy(by).agg(*[F.avg(c).alias(f"_gm_{c}") for c in cols]), "group_stat")
    j = df.join(st, by, "left")
    for c in cols:
        j = _flagged(j, c, F.col(f"_gm_{c}"), flag)
    return j.select(*df.columns, *([f"{c}_imputed" for c in cols] if flag else []))


def bernoulli_probs(df: DataFrame, cols: Sequence[str]) -> Column:
    """Observed means of several 0/1 columns in one pass, as one struct scalar."""
    return df.select(F.struct(*[F.avg(c).alias(c) for c in cols])).scalar()


def fill_bernoulli(
    df: DataFrame,
    col: str,
    key: str,
    p: Column | float,
    salt: str | None = None,
    where: Column | None = None,
    flag: bool = False,
) -> DataFrame:
    """NULL -> 1 with probability p (draw ``u(key, salt) < p``), else 0.

    ``where`` restricts which NULL rows are drawn (the rest stay NULL).
    """
    p = F.lit(p) if not isinstance(p, Column) else p
    draw = F.when(u(key, salt or f"bern:{col}") < p, F.lit(1)).otherwise(F.lit(0))
    if where is not None:
        draw = F.when(where, draw)
    return _flagged(df, col, draw, flag)


def category_cdf(df: DataFrame, col: str) -> DataFrame:
    """Frequencies of the non-NULL values with cumulative bounds in value order: one row
    per distinct value, summed up over buckets of values (no single-task window)."""
    freq = df.where(F.col(col).isNotNull()).groupBy(F.col(col).alias("_v")).agg(F.count(F.lit(1)).alias("_c"))
    c = cumulative_before(freq, "_v", ["_c"])
    return c.select("_v", (F.col("_c_before") / F.col("_c_total")).alias("_plo"), ((F.col("_c_before") + F.col("_c")) / F.col("_c_total")).alias("_phi"))


def fill_empirical(
    df: DataFrame, col: str, key: str, salt: str | None = None, flag: bool = False, buckets: int = UNIFORM_BUCKETS,
    source: DataFrame | None = None,
) -> DataFrame:
    """NULL -> a draw from the observed distribution of ``col`` (inverse CDF of ``u``).

    The CDF table (K categories) is expanded to the uniform buckets each category
    overlaps, so the lookup is an equi-join on the bucket plus a range check
    against K + B rows. Rows that are not NULL carry no bucket and pass through.
    """
    cdf = category_cdf(source if source is not None else df, col)
    nb = F.lit(buckets)
    cdf_b = cdf.withColumn(
        "_bkt",
        F.explode(F.sequence(F.floor(F.col("_plo") * nb).cast("int"),
                             F.least(F.floor(F.col("_phi") * nb), nb - 1).cast("int"))),
    )
    miss = F.col(col).isNull()
    # filled rows get a negative bucket spread by key: they match nothing and, if the
    # join is not broadcast, do not pile up in the NULL-key partition
    m = df.withColumn("_u", F.when(miss, u(key, salt or f"emp:{col}"))).withColumn(
        "_bkt", F.when(miss, uniform_bucket(F.col("_u"), buckets)).otherwise(-1 - F.pmod(F.xxhash64(key), F.lit(buckets)))
    )
    cond = (m["_bkt"] == cdf_b["_bkt"]) & (m["_u"] >= cdf_b["_plo"]) & (m["_u"] < cdf_b["_phi"])
    j = m.join(cdf_b, cond, "left")
    out = _flagged(j, col, F.col("_v"), flag)
    return out.select(*df.columns, *([f"{col}_imputed"] if flag else []))


def fill_donor(
    df: DataFrame,
    col: str,
    key: str,
    recipient: Column,
    donor: Column,
    salt: str | None = None,
    flag: bool = False,
    buckets: int = UNIFORM_BUCKETS,
) -> DataFrame:
    """Hot-deck draw. Rows matching ``recipient`` get ``col`` from a donor row
    drawn uniformly with replacement among rows matching ``donor``.

    Donors are numbered 1..n in hash-uniform order (distributed positions); the
    recipient joins on ``floor(u * n) + 1``. With no donor, the value is kept.
    """
    salt = salt or f"donor:{col}"
    donors = df.where(donor).select(F.col(key).alias("_dk"), F.col(col).alias("_dv"))
    donors = donors.withColumn("_du", u("_dk", f"{salt}:order"))
    numbered = with_positions(donors, ["_du", "_dk"], uniform_bucket(F.col("_du"), buckets), out="_dpos")
    n_donors = donors.select(F.count(F.lit(1))).scalar()
    rec = df.where(recipient).withColumn("_pick", (F.floor(u(key, salt) * n_donors) + 1).cast("long"))
    got = rec.join(numbered.select("_dpos", "_dv"), rec._pick == numbered._dpos, "left")
    extra = [f"{col}_imputed"] if flag else []
    got = got.withColumn(col, F.coalesce(F.col("_dv").cast(df.schema[col].dataType), F.col(col)))
    rest = df.where(~recipient | recipient.isNull())
    if flag:
        got = got.withColumn(f"{col}_imputed", F.col("_dv").isNotNull().cast("int"))
        rest = rest.withColumn(f"{col}_imputed", F.lit(0))
    cols = [*df.columns, *extra]
    return rest.select(*cols).unionByName(got.select(*cols))
