"""Splits, exact samples, permutations, resamples and scaling.

All randomness is the hash uniform ``u(key, salt)``: a split, sample or
permutation is a pure function of the keys, identical at any partitioning,
after a lost executor, and in the DuckDB oracle. ``rand()``/``randomSplit``
would not be (they depend on partition layout).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.core import u
from .positions import UNIFORM_BUCKETS, first_n, uniform_bucket, with_positions


def split_column(key: str, weights: Sequence[float], salt: str = "split") -> Column:
    """Bucket 0..len(weights)-1 drawn with the given probabilities (row-wise,
    so bucket sizes are random as in R ``sample(0:2, n, prob=...)``)."""
    total = float(sum(weights))
    edges, acc = [], 0.0
    for w in weights[:-1]:
        acc += w / total
        edges.append(acc)
    x = u(key, salt)
    e = F.lit(len(weights) - 1)
    for i in reversed(range(len(edges))):
        e = F.when(x < F.lit(edges[i]), F.lit(i)).otherwise(e)
    return e.cast("int")


def split(df: DataFrame, key: str, weights: Sequence[float], salt: str = "split", out: str = "split") -> DataFrame:
    """Add the split bucket column."""
    return df.withColumn(out, split_column(key, weights, salt))


def sample_exact(df: DataFrame, key: str, n: int | Column, salt: str = "sample",
                 buckets: int = UNIFORM_BUCKETS) -> DataFrame:
    """Exactly ``n`` rows without replacement: the n smallest ``(u, key)``.
    Distributed first-n selection (no global sort, no limit on one task)."""
    s = df.withColumn("_u", u(key, salt))
    return first_n(s, ["_u", key], uniform_bucket(F.col("_u"), buckets), n).drop("_u")


def sample_fraction_exact(df: DataFrame, key: str, fraction: float, salt: str = "sample") -> DataFrame:
    """X2 as in the study: ``floor(fraction * nrow)`` rows (R truncates the size)."""
    n = F.floor(df.select(F.count(F.lit(1))).scalar() * F.lit(fraction))
    return sample_exact(df, key, n, salt)


def permute_columns(
    df: DataFrame,
    key: str,
    cols: Sequence[str],
    salt: str = "perm",
    by: Sequence[str] | str | None = None,
    buckets: int = UNIFORM_BUCKETS,
) -> DataFrame:
    """Each column of ``cols`` independently shuffled across rows (within
    ``by`` groups, e.g. a scenario), the other columns kept.

    Row i in ``u(key, salt:dst)`` order receives the value of row i in
    ``u(key, salt:<col>)`` order: a uniformly random permutation that is exact
    (every value used once), built from bucketed positions and one equi-join per
    column on (group, position). No row ever leaves its shuffle partition alone.
    """
    by = [by] if isinstance(by, str) else list(by or [])
    base = df.withColumn("_ud", u(key, f"{salt}:dst"))
    out = with_positions(base, ["_ud", key], uniform_bucket(F.col("_ud"), buckets), by=by, out="_pd").drop("_ud", "_pd_n")
    for c in cols:
        src = df.select(*by, key, c).withColumn("_us", u(key, f"{salt}:{c}"))
        src = with_positions(src, ["_us", key], uniform_bucket(F.col("_us"), buckets), by=by, out="_pd")
        src = src.select(*by, "_pd", F.col(c).alias(f"_perm_{c}"))
        out = out.join(src, on=[*by, "_pd"], how="inner").withColumn(c, F.col(f"_perm_{c}")).drop(f"_perm_{c}")
    return out.drop("_pd").select(*df.columns)


def replicate(df: DataFrame, n: int, out: str = "replicate") -> DataFrame:
    """``n`` stacked copies with a replicate id 1..n (salt draws with it).
    The copies are made by an explode inside each partition, not by a join."""
    return df.withColumn(out, F.explode(F.sequence(F.lit(1), F.lit(n))))


def min_max_bounds(df: DataFrame, cols: Sequence[str]) -> Column:
    """Bounds of several columns in one aggregate, as one struct scalar."""
    return df.select(
        F.struct(*[F.min(c).cast("double").alias(f"{c}_min") for c in cols],
                 *[F.max(c).cast("double").alias(f"{c}_max") for c in cols])
    ).scalar()


def min_max(df: DataFrame, cols: Sequence[str], suffix: str = "_nrm", fit_on: DataFrame | None = None,
            replace: bool = False) -> DataFrame:
    """``(x - min)/(max - min)`` into ``<col><suffix>``; a constant column gives
    0.0 (adds nothing to distances). Bounds come from ``fit_on`` (default: ``df``)
    in one aggregate attached as a scalar subquery."""
    b = min_max_bounds(fit_on if fit_on is not None else df, cols)
    new = {}
    for c in cols:
        lo, hi = b.getField(f"{c}_min"), b.getField(f"{c}_max")
        v = F.coalesce(F.try_divide(F.col(c).cast("double") - lo, hi - lo), F.when(F.col(c).isNotNull(), F.lit(0.0)))
        new[c if replace else f"{c}{suffix}"] = v
    return df.withColumns(new)
