"""Column-level operators: projection, decode/recode, filters, casts."""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def select_except(df: DataFrame, exclude: Iterable[str]) -> DataFrame:
    """All columns but ``exclude`` (R ``setdiff(names(dt), ...)`` + ``.SDcols``)."""
    ex = set(exclude)
    return df.select(*[c for c in df.columns if c not in ex])


def feature_columns(df: DataFrame, exclude: Iterable[str]) -> list[str]:
    """the column list minus keys/labels, in table order."""
    ex = set(exclude)
    return [c for c in df.columns if c not in ex]


def encode_flag(df: DataFrame, col: str, positive: str, out: str, keep_null: bool = True) -> DataFrame:
    """1 where ``col == positive`` else 0; NULL stays NULL (R ``ifelse``)."""
    v = F.when(F.col(col) == F.lit(positive), F.lit(1)).otherwise(F.lit(0))
    if keep_null:
        v = F.when(F.col(col).isNull(), F.lit(None)).otherwise(v)
    return df.withColumn(out, v.cast("int"))


def decode_flags(df: DataFrame, specs: Sequence[tuple[str, str, str]], drop: bool = True) -> DataFrame:
    """P6 + P4: several ``(col, positive, out)`` decodes, then drop the sources."""
    for col, positive, out in specs:
        df = encode_flag(df, col, positive, out)
    return df.drop(*[s[0] for s in specs]) if drop else df


def recode(df: DataFrame, col: str, mapping: Mapping, default=None) -> DataFrame:
    """Value map, e.g. {1: 0, 0: 1} to invert a 0/1 flag; others -> ``default``."""
    e = None
    for k, v in mapping.items():
        e = (F.when(F.col(col) == F.lit(k), F.lit(v)) if e is None else e.when(F.col(col) == F.lit(k), F.lit(v)))
    e = e.otherwise(F.lit(default)) if default is not None else e
    return df.withColumn(col, e.cast(df.schema[col].dataType))


def invert_flag(df: DataFrame, col: str) -> DataFrame:
    """P7 as in the reference: ``ifelse(x == 1, 0, 1)`` (NULL stays NULL)."""
    return df.withColumn(
        col, F.when(F.col(col).isNull(), F.lit(None)).when(F.col(col) == 1, F.lit(0)).otherwise(F.lit(1)).cast("int")
    )


def conditional_update(df: DataFrame, cond: Column, col: str, value: Column) -> DataFrame:
    """``dt[cond, col := value]``; rows not matching (or NULL cond) keep their value."""
    return df.withColumn(col, F.when(cond, value).otherwise(F.col(col)))


def _keys(other: DataFrame, on: str | Sequence[str]) -> DataFrame:
    return other.select(*([on] if isinstance(on, str) else on)).distinct()


def keep_in(df: DataFrame, other: DataFrame, on: str | Sequence[str]) -> DataFrame:
    """P9 ``%in%``: rows whose key occurs in ``other`` (left semi join, no duplicates). The
    keys of ``other`` are made distinct first, so a join task sorts or holds each once."""
    return df.join(_keys(other, on), on=on, how="left_semi")


def keep_not_in(df: DataFrame, other: DataFrame, on: str | Sequence[str]) -> DataFrame:
    """P9 ``%notin%``: rows whose key does not occur in ``other`` (left anti join)."""
    return df.join(_keys(other, on), on=on, how="left_anti")


def complete_cases(df: DataFrame, subset: Sequence[str] | None = None) -> DataFrame:
    """P10: R ``na.omit``: rows without NULL or NaN in the columns.

    One condition a column: the optimizer restates a filter for every alias above it, and
    ``dropna``'s single condition over all columns has a form for each set of aliases (2^p)."""
    types = dict(df.dtypes)
    for name in subset or df.columns:
        c = F.col(name)
        df = df.where(c.isNotNull() & ~F.isnan(c) if types.get(name) in ("double", "float") else c.isNotNull())
    return df


def cast_columns(df: DataFrame, types: Mapping[str, str]) -> DataFrame:
    """``as.integer``/``as.numeric`` casts by name."""
    return df.withColumns({c: F.col(c).cast(t) for c, t in types.items()})


def row_mean(cols: Sequence[str]) -> Column:
    """R ``rowMeans`` without ``na.rm``: any NULL gives NULL."""
    total = None
    for c in cols:
        total = F.col(c).cast("double") if total is None else total + F.col(c).cast("double")
    return total / F.lit(float(len(cols)))
