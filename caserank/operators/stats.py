"""Correlation operators.

Pearson with one target is ``covar_samp / (stddev_samp * stddev_samp)``: central-moment
aggregates merge stably across partitions, and a constant column gives NULL via
``try_divide`` (Spark's ``corr`` raises DIVIDE_BY_ZERO under ANSI). A p x p
matrix is a blocked product, one p x p set of sums a partition; only those p^2 numbers
reach the driver (for the basket clustering, M3).
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage, ship_package
from .columns import complete_cases
from .positions import cumulative_before


def _pearson(a, b):
    """Pearson over the rows where both are non-NULL (pairwise complete)."""
    a = F.col(a) if isinstance(a, str) else a
    b = F.col(b) if isinstance(b, str) else b
    a_, b_ = F.when(b.isNotNull(), a), F.when(a.isNotNull(), b)
    sd = F.stddev_samp(a_) * F.stddev_samp(b_)
    return F.when(sd > 0, F.try_divide(F.covar_samp(a, b), sd))


def corr_matrix(df: DataFrame, cols: Sequence[str], complete_only: bool = False) -> DataFrame:
    """Long-form Pearson matrix ``(var_a, var_b, corr)``, p^2 rows.

    Each partition multiplies its rows' blocks, centred by the column means, into one
    p x p set of sums (rows, sums, squares and products where both columns are there), so
    a row costs a matrix product and the shuffle is p(p+1)/2 rows a partition, summed with
    map-side combine, whatever p is. ``complete_only`` drops rows with a NULL in any of
    ``cols`` first (R ``use="complete.obs"``); otherwise NULLs are skipped pairwise. A
    column whose spread over a pair's rows is no more than rounding gives NULL (R: NA).
    """
    ship_package(df.sparkSession)
    cols = list(cols)
    p = len(cols)
    src = df.select(*[F.col(c).cast("double").alias(f"c{k}") for k, c in enumerate(cols)])
    if complete_only:
        src = complete_cases(src)
    means = src.select(F.array(*[F.coalesce(F.avg(f"c{k}"), F.lit(0.0)) for k in range(p)])).first()[0]  # p numbers
    i, j = np.triu_indices(p)

    def run(batches):
        total = np.zeros((6, p, p))
        centre = np.array(means)
        for b in batches:
            x = np.stack([c.to_numpy(zero_copy_only=False) for c in b.columns], 1).astype(np.float64) - centre if b.num_rows else np.zeros((0, p))
            here = ~np.isnan(x)
            x, m = np.where(here, x, 0.0), here.astype(np.float64)
            sums, squares = x.T @ m, (x * x).T @ m
            total += np.stack([m.T @ m, sums, sums.T, squares, squares.T, x.T @ x])
        yield pa.RecordBatch.from_arrays([pa.array(i.astype(np.int32)), pa.array(j.astype(np.int32)), *[pa.array(t[i, j]) for t in total]], names)

    names = ["i", "j", "n", "sx", "sy", "qx", "qy", "xy"]
    parts = src.mapInArrow(run, "i int, j int, " + ", ".join(f"{c} double" for c in names[2:]))
    agg = parts.groupBy("i", "j").agg(*[F.sum(c).alias(c) for c in names[2:]])

    def spread(q, s):
        v = F.col(q) - F.col(s) * F.try_divide(F.col(s), F.col("n"))
        return F.when(v > 1e-13 * F.col(q), v)

    cov = F.col("xy") - F.col("sx") * F.try_divide(F.col("sy"), F.col("n"))
    corr = F.try_divide(cov, F.sqrt(spread("qx", "sx")) * F.sqrt(spread("qy", "sy")))
    agg = agg.select("i", "j", corr.alias("corr"))
    names_ = df.sparkSession.createDataFrame([(i, c) for i, c in enumerate(cols)], "k int, var string")
    na = names_.select(F.col("k").alias("i"), F.col("var").alias("var_a"))
    nb = names_.select(F.col("k").alias("j"), F.col("var").alias("var_b"))
    upper = agg.join(F.broadcast(na), "i").join(F.broadcast(nb), "j")  # p-row name tables
    # the diagonal is 1 unless the column is constant (R: NA)
    upper = upper.withColumn("corr", F.when(F.col("i") == F.col("j"),
                                            F.when(F.col("corr").isNotNull(), F.lit(1.0))).otherwise(F.col("corr")))
    lower = upper.where(F.col("i") != F.col("j")).select(
        F.col("var_b").alias("var_a"), F.col("var_a").alias("var_b"), "corr")
    return upper.select("var_a", "var_b", "corr").unionByName(lower)


def target_correlation(
    df: DataFrame, target: str, features: Sequence[str], key: str | None = None, spearman: bool = True
) -> DataFrame:
    """M2: per feature Pearson (and Spearman) correlation with ``target``.

    Returns ``(var, cor_lin, abs_cor_lin[, cor_spear, abs_cor_spear])``. Spearman is
    Pearson over average ranks (ties averaged): features are unpivoted to a long
    table, collapsed to distinct (feature, value, label) with their counts, ranked per
    feature with distributed positions, and correlated from those counts.
    """
    features = list(features)
    lin = df.select(*[_pearson(F.col(f).cast("double"), F.col(target).cast("double")).alias(f) for f in features])
    lin_long = lin.select(
        F.explode(F.array(*[F.struct(F.lit(f).alias("var"), F.col(f).alias("cor_lin")) for f in features])).alias("_p")
    ).select("_p.*").withColumn("abs_cor_lin", F.abs("cor_lin"))
    if not spearman:
        return lin_long
    if key is None:
        raise ValueError("Spearman needs a row key to pair ranks")
    # complete pairs only, as R's cor() with no NA present
    base = df.select(key, F.col(target).cast("double").alias("_y"), *[F.col(f).cast("double").alias(f) for f in features])
    long = base.unpivot([key, "_y"], features, "var", "_x").where(F.col("_x").isNotNull() & F.col("_y").isNotNull())
    # equal pairs become one row; ranks are centred, so their product sums need no means
    pairs = cut_lineage(long.groupBy("var", "_x", "_y").agg(F.count(F.lit(1)).alias("_n")), "rank_pairs")

    def centred_ranks(col: str, out: str) -> DataFrame:
        d = cumulative_before(pairs.groupBy("var", col).agg(F.sum("_n").alias("_w")), col, ["_w"], "var")
        return d.select("var", col, F.col("_w").alias(f"{out}_w"), (F.col("_w_before") + (F.col("_w") - F.col("_w_total")) / 2.0).alias(out))

    rx, ry = centred_ranks("_x", "_a"), centred_ranks("_y", "_b")
    # summed per label value before the label's ranks come in: no join on a hot label
    by_y = pairs.join(rx, ["var", "_x"]).groupBy("var", "_y").agg(F.sum(F.col("_n") * F.col("_a")).alias("_s"))
    xy = by_y.join(ry, ["var", "_y"]).groupBy("var").agg(F.sum(F.col("_s") * F.col("_b")).alias("_xy"), F.sum(F.col("_b_w") * F.col("_b") ** 2).alias("_yy"))
    xx = rx.groupBy("var").agg(F.sum(F.col("_a_w") * F.col("_a") ** 2).alias("_xx"))
    sp = xy.join(xx, "var").select("var", F.try_divide(F.col("_xy"), F.sqrt("_xx") * F.sqrt("_yy")).alias("cor_spear"))
    return lin_long.join(sp, on="var", how="left").withColumn("abs_cor_spear", F.abs("cor_spear"))


def grouped_target_correlation(df: DataFrame, target: str, features: Sequence[str], by: str) -> DataFrame:
    """M2 within groups: ``(by, var, cor_lin, abs_cor_lin)``, NULL where a feature is
    constant in a group. One aggregate over (group, feature) with map-side combine."""
    long = df.select(by, F.col(target).cast("double").alias("_y"), *[F.col(f).cast("double").alias(f"_x_{f}") for f in features])
    pairs = F.explode(F.array(*[F.struct(F.lit(f).alias("var"), F.col(f"_x_{f}").alias("x")) for f in features])).alias("_p")
    cor = long.select(by, "_y", pairs).groupBy(by, F.col("_p.var").alias("var")).agg(_pearson(F.col("_p.x"), F.col("_y")).alias("cor_lin"))
    return cor.withColumn("abs_cor_lin", F.abs("cor_lin"))


# --- M3: correlation baskets -------------------------------------------------


def row_distances(corr_long: DataFrame) -> DataFrame:
    """Euclidean distance between rows of the correlation matrix, as a long table
    ``(var_a, var_b, dist)`` built by a self-join on the column variable (p^3 rows)."""
    a = corr_long.select(F.col("var_a").alias("x"), F.col("var_b").alias("c"), F.col("corr").alias("ra"))
    b = corr_long.select(F.col("var_a").alias("y"), F.col("var_b").alias("c"), F.col("corr").alias("rb"))
    return (
        a.join(b, on="c", how="inner")
        .groupBy("x", "y")
        .agg(F.sqrt(F.sum((F.col("ra") - F.col("rb")) ** 2)).alias("dist"))
        .withColumnRenamed("x", "var_a")
        .withColumnRenamed("y", "var_b")
    )


def complete_linkage(dist: np.ndarray) -> list[tuple[int, int, float]]:
    """Agglomerative clustering with complete linkage on a p x p distance matrix, by the
    nearest-neighbour chain: p^2 steps, on p points only.

    Returns the merge list (cluster a, cluster b, height) by height, a cluster named by its
    smallest member and a < b. A chain goes from a cluster to its nearest (ties: the one
    before on the chain, then the smallest) until two are each other's nearest; under complete
    linkage such a pair merges in the greedy order as well."""
    p = dist.shape[0]
    d = dist.astype(float).copy()
    np.fill_diagonal(d, np.inf)
    least = list(range(p))  # the smallest member of the cluster kept in a row
    active = np.ones(p, bool)
    merges, chain = [], []
    while len(merges) < p - 1:
        if not chain:
            chain = [int(np.flatnonzero(active)[0])]
        here = chain[-1]
        row = np.where(active, d[here], np.inf)
        row[here] = np.inf
        near = int(np.argmin(row))
        if len(chain) > 1 and row[chain[-2]] <= row[near]:
            near = chain[-2]
            chain = chain[:-2]
            a, b = sorted((here, near), key=lambda c: least[c])
            merges.append((least[a], least[b], float(d[a, b])))
            d[a] = d[:, a] = np.maximum(d[a], d[b])
            d[a, a] = np.inf
            active[b] = False
        else:
            chain.append(near)
    return sorted(merges, key=lambda m: m[2])


def cut_tree(p: int, merges: list[tuple[int, int, float]], k: int) -> list[int]:
    """R ``cutree(tree, k)``: apply the first p-k merges; clusters numbered 1..k by
    first appearance in observation order."""
    parent = list(range(p))

    def find(i):
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    for a, b, _ in merges[: max(p - k, 0)]:
        ra, rb = find(a), find(b)
        parent[rb] = ra
    ids, out = {}, []
    for i in range(p):
        r = find(i)
        if r not in ids:
            ids[r] = len(ids) + 1
        out.append(ids[r])
    return out


def _feature_distances(df: DataFrame, features: list[str]) -> np.ndarray:
    dist = row_distances(corr_matrix(df, features).fillna(0.0, subset=["corr"]))
    pos = {f: i for i, f in enumerate(features)}
    m = np.zeros((len(features), len(features)))
    for r in dist.collect():  # p^2 numbers
        m[pos[r.var_a], pos[r.var_b]] = r.dist
    return m


def correlation_baskets(df: DataFrame, features: Sequence[str], k: int = 4) -> DataFrame:
    """M3: group features into ``k`` baskets by complete-linkage clustering of the
    rows of their correlation matrix. Returns ``(var, basket_id)``."""
    features = list(features)
    ids = cut_tree(len(features), complete_linkage(_feature_distances(df, features)), k)
    return df.sparkSession.createDataFrame([(f, int(i)) for f, i in zip(features, ids)], "var string, basket_id int")


def merge_table(df: DataFrame, features: Sequence[str]) -> DataFrame:
    """M3: the feature tree behind the baskets: ``(step, var_a, var_b, size, height)``, one
    row per merge by height, a cluster named by its first feature; ``size`` after the merge."""
    features = list(features)
    size = [1] * len(features)
    rows = []
    for step, (a, b, height) in enumerate(complete_linkage(_feature_distances(df, features)), 1):
        size[a] += size[b]
        rows.append((step, features[a], features[b], size[a], height))
    return df.sparkSession.createDataFrame(rows, "step int, var_a string, var_b string, size int, height double")
