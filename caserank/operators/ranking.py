"""Ranks, top-k, argmin and consensus ranking.

Rank tables have one row per feature or basket (p or B rows), so an ordered
window without a partition is allowed here: it runs over p rows, never over data.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .columns import row_mean


def rank_by(df: DataFrame, metric: str, ascending: bool = True, tiebreak: Sequence[str] = (), out: str = "rank",
            by: Sequence[str] = ()) -> DataFrame:
    """``1:n`` after sorting by ``metric`` (R sort then ``1:19``); ties by ``tiebreak``.
    NULL metrics sort last."""
    m = F.col(metric).asc_nulls_last() if ascending else F.col(metric).desc_nulls_last()
    w = Window.partitionBy(*by).orderBy(m, *[F.col(t) for t in tiebreak])
    return df.withColumn(out, F.row_number().over(w).cast("int"))


def top_k(df: DataFrame, metric: str, k: int, by: Sequence[str] = (), ascending: bool = False,
          tiebreak: Sequence[str] = ()) -> DataFrame:
    """The k best rows per group (``row_number() <= k``; a limit that is the feature)."""
    r = rank_by(df, metric, ascending, tiebreak, out="_rk", by=by)
    return r.where(F.col("_rk") <= k).drop("_rk")


def best_row(df: DataFrame, metric: str, by: Sequence[str] = (), ascending: bool = True,
             tiebreak: Sequence[str] = ()) -> DataFrame:
    """argmin/argmax row per group (``sorted[1, ]``), via ``min_by`` on a struct."""
    cols = [c for c in df.columns if c not in by]
    key = F.struct(F.col(metric) if ascending else -F.col(metric), *[F.col(t) for t in tiebreak])
    g = df.groupBy(*by).agg(F.min_by(F.struct(*cols), key).alias("_best"))
    return g.select(*by, "_best.*")


def consensus_rank(rank_tables: Sequence[DataFrame], id_col: str, rank_cols: Sequence[str] | None = None,
                   out_avg: str = "avg_place", out_place: str = "place") -> DataFrame:
    """M23/M24 (J6 + P16 + W1): join the rank tables on ``id_col``, average the
    ranks per row (any NULL rank gives NULL, like ``rowMeans``), place = rank of
    the average (ties by id). An id that a table lacks keeps its row, with a NULL
    rank there, and is placed last."""
    joined = reduce(lambda a, b: a.join(b, on=id_col, how="full"), rank_tables)
    cols = list(rank_cols) if rank_cols else [c for c in joined.columns if c != id_col]
    r = joined.withColumn(out_avg, row_mean(cols))
    return rank_by(r, out_avg, ascending=True, tiebreak=[id_col], out=out_place)
