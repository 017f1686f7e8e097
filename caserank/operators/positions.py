"""Exact global positions, quantiles and first-n selection without a single-task sort.

An un-partitioned ``Window.orderBy`` moves every row into one task; Spark's
exact ``percentile`` keeps every distinct value of a group in one buffer. Both
break when one group holds a third of 100 TB. The operators here split the
order, at every size alike, into *buckets* that are monotone in the sort order and data-defined
(never a physical partition id, which AQE may coalesce differently in two
branches of one plan):

* uniform orders (by the hash uniform ``u``): bucket = ``floor(u * B)``;
* value orders: digits. A range of values is cut into ``DIGITS`` equal parts, alternately
  on the plain and on a logarithmic scale; a part with more than ``RANGE_ROWS`` rows is a
  range of its own, between its least and its greatest value, and is cut again. One
  aggregate counts a level for all columns and groups at once, combined map-side. No
  sketch is needed and no task's share grows with the data: more rows mean more
  levels, of which each makes a part up to ``DIGITS`` times smaller.

Quantiles descend only into the parts that hold a wanted rank, so after the first level
they read little more than counts; ranks and running sums cut every part that is too
large, number rows inside each by a window, and add offsets from the small table of
parts. A value that a third of all rows share is a part of its own, however many rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Buckets of uniform orders: no sketch is needed, so many of them cost little.
UNIFORM_BUCKETS = 4096
#: Parts that a level cuts a range into, and rows that a range may hold uncut.
DIGITS, RANGE_ROWS = 1024, 8192
_HUGE = 1.7976931348623157e308


def _cols(xs) -> list[str]:
    if xs is None:
        return []
    if isinstance(xs, str):
        return [xs]
    return list(xs)


def uniform_bucket(u_col: Column, buckets: int = UNIFORM_BUCKETS) -> Column:
    """Bucket of a uniform [0,1) column; monotone in u."""
    if buckets <= 1:
        return F.lit(0)
    return F.least(F.floor(u_col * F.lit(buckets)), F.lit(buckets - 1)).cast("int")


def _bucket_offsets(df: DataFrame, by: list[str], bucket: str, weight: str | None) -> DataFrame:
    """(by, bucket, _bstart, _btotal): rows (or weight) before each bucket within its group."""
    w = F.sum(weight) if weight else F.count(F.lit(1))
    tot = df.groupBy(*by, bucket).agg(w.cast("long").alias("_bcount"))
    win = Window.partitionBy(*by).orderBy(bucket).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return (
        tot.withColumn("_bend", F.sum("_bcount").over(win))
        .withColumn("_bstart", F.col("_bend") - F.col("_bcount"))
        .withColumn("_btotal", F.sum("_bcount").over(Window.partitionBy(*by)))
        .drop("_bend")
    )


def _digit(x: str, lo: str, hi: str, level: int) -> Column:
    """0 .. DIGITS - 1: which part of [lo, hi], lo < hi, a value inside lies in; non-decreasing
    in the value, 0 at lo and the last at hi."""
    x_, lo_, hi_ = (F.greatest(F.least(F.col(c), F.lit(_HUGE)), F.lit(-_HUGE)) for c in (x, lo, hi))
    finite = hi_ - lo_ <= F.lit(_HUGE)  # halves keep the difference of two huge values finite
    rise, span = F.when(finite, x_ - lo_).otherwise(x_ / 2 - lo_ / 2), F.when(finite, hi_ - lo_).otherwise(hi_ / 2 - lo_ / 2)
    share = F.try_divide(F.log1p(rise), F.log1p(span)) if level % 2 else F.try_divide(rise, span)
    return F.least(F.floor(share * DIGITS), F.lit(DIGITS - 1)).cast("int")


def _same(a: DataFrame, b: DataFrame, on: Sequence[str], how: str) -> DataFrame:
    """A join on columns of equal names where NULL equals NULL; keeps ``a``'s copies."""
    cond = F.lit(True)
    for c in on:
        cond = cond & a[c].eqNullSafe(b[c])
    j = a.join(b, cond, how)
    return j if how == "left_semi" else j.drop(*[b[c] for c in on])


def _kept(df: DataFrame, name: str) -> DataFrame:
    from ..session import cut_lineage

    return cut_lineage(df, name)


def with_positions(
    df: DataFrame,
    order_by: Sequence[str],
    bucket: Column,
    by: Sequence[str] | str | None = None,
    out: str = "pos",
) -> DataFrame:
    """Add a 1-based position ``out`` of each row within its ``by`` group.

    ``order_by`` must be a total order (end it with a unique key) and ``bucket``
    must be non-decreasing along it. Adds ``<out>_n``: the group size.
    """
    by = _cols(by)
    order_by = _cols(order_by)
    b = df.withColumn("_bkt", bucket)
    offs = _bucket_offsets(b, by, "_bkt", None)
    win = Window.partitionBy(*by, "_bkt").orderBy(*order_by)
    numbered = b.withColumn("_rn", F.row_number().over(win))
    return (
        numbered.join(offs, on=[*by, "_bkt"], how="inner")
        .withColumn(out, (F.col("_bstart") + F.col("_rn")).cast("long"))
        .withColumn(f"{out}_n", F.col("_btotal"))
        .drop("_bkt", "_rn", "_bstart", "_bcount", "_btotal")
    )


def first_n(
    df: DataFrame,
    order_by: Sequence[str],
    bucket: Column,
    n,
    by: Sequence[str] | str | None = None,
) -> DataFrame:
    """Rows whose position (in ``order_by`` within ``by``) is <= n; exact.

    Only the single bucket that straddles n is numbered; buckets wholly before
    it pass as they are, so the work is one count pass plus one filter pass.
    ``n`` may be an int or a Column over ``by`` columns / ``_btotal`` (group size).
    """
    by = _cols(by)
    order_by = _cols(order_by)
    b = df.withColumn("_bkt", bucket)
    offs = _bucket_offsets(b, by, "_bkt", None)
    n_col = F.lit(n) if not isinstance(n, Column) else n
    offs = offs.withColumn("_need", n_col.cast("long"))
    j = b.join(offs, on=[*by, "_bkt"], how="inner")
    whole = j.where(F.col("_bstart") + F.col("_bcount") <= F.col("_need"))
    edge = j.where((F.col("_bstart") < F.col("_need")) & (F.col("_bstart") + F.col("_bcount") > F.col("_need")))
    win = Window.partitionBy(*by, "_bkt").orderBy(*order_by)
    edge = edge.withColumn("_rn", F.row_number().over(win)).where(
        F.col("_bstart") + F.col("_rn") <= F.col("_need")
    ).drop("_rn")
    drop = ["_bkt", "_bstart", "_bcount", "_btotal", "_need"]
    return whole.drop(*drop).unionByName(edge.drop(*drop))


def exact_quantiles(
    df: DataFrame,
    value: str,
    probs: Sequence[float],
    by: Sequence[str] | str | None = None,
) -> DataFrame:
    """Type-7 (R default, Spark ``percentile``, DuckDB ``quantile_cont``) quantiles.

    Returns one row per (by..., p) with columns ``p``, ``q`` and ``n`` (non-null
    count). NULL and NaN values are skipped; a group without others yields no row.
    """
    return quantiles_of(df, [value], probs, by).drop("column")


def quantiles_of(df: DataFrame, values: Sequence[str], probs: Sequence[float], by: Sequence[str] | str | None = None) -> DataFrame:
    """``exact_quantiles`` of several columns in the same passes: (by..., column, p, q, n)."""
    by, values = _cols(by), list(values)
    x = F.explode(F.array(*[F.struct(F.lit(v).alias("column"), F.col(v).cast("double").alias("_x")) for v in values])).alias("_v")
    base = df.select(*by, x).select(*by, "_v.*").where(F.col("_x").isNotNull() & ~F.isnan("_x"))
    key = [*by, "column"]
    ranges = base.groupBy(*key).agg(F.count(F.lit(1)).alias("_n"), F.min("_x").alias("_lo"), F.max("_x").alias("_hi"))
    h = [(F.col("_n") - 1) * F.lit(float(p)) for p in probs]
    ranks = F.array_distinct(F.flatten(F.array(*[F.array(F.floor(v), F.ceil(v)) for v in h])))
    nodes = _kept(ranges.withColumns({"n": F.col("_n"), "_before": F.lit(0).cast("long"), "_ranks": ranks}), "digits")
    groups, found, level = nodes.select(*key, "n"), [], 0
    while True:
        # ranges of one value answer at once, small ones by their values, the others are cut
        one, few = F.col("_lo") == F.col("_hi"), F.col("_n") <= RANGE_ROWS
        found.append(nodes.where(one).select(*key, F.explode("_ranks").alias("_r"), F.col("_lo").alias("_q")))
        inside = (F.col("_x") >= F.col("_lo")) & (F.col("_x") <= F.col("_hi"))
        small = nodes.where(~one & few).select(*key, "_lo", "_hi", "_before", "_ranks")
        held = _same(base, small, key, "inner").where(inside).groupBy(*key, "_lo", "_before", "_ranks").agg(F.sort_array(F.collect_list("_x")).alias("_xs"))
        found.append(held.select(*key, F.explode("_ranks").alias("_r"), "_xs", "_before").select(
            *key, "_r", F.get("_xs", (F.col("_r") - F.col("_before")).cast("int")).alias("_q")))
        big = nodes.where(~one & ~few).select(*key, "_lo", "_hi", "_before", "_ranks")
        if big.isEmpty():
            break
        parts = _same(base, big, key, "inner").where(inside).withColumn("_d", _digit("_x", "_lo", "_hi", level)).groupBy(
            *key, F.col("_lo").alias("_from"), "_before", "_ranks", "_d").agg(F.count(F.lit(1)).alias("_n"), F.min("_x").alias("_lo"), F.max("_x").alias("_hi"))
        w = Window.partitionBy(*key, "_from").orderBy("_d").rowsBetween(Window.unboundedPreceding, -1)  # DIGITS rows
        parts = parts.withColumn("_before", F.col("_before") + F.coalesce(F.sum("_n").over(w), F.lit(0)))
        own = F.filter("_ranks", lambda r: (r >= F.col("_before")) & (r < F.col("_before") + F.col("_n")))
        nodes = _kept(parts.withColumn("_ranks", own).where(F.size("_ranks") > 0).drop("_from", "_d"), "digits")
        level += 1
    hits = found[0]
    for f in found[1:]:
        hits = hits.unionByName(f)
    each = F.explode(F.array(*[F.struct(F.lit(float(p)).alias("p")) for p in probs])).alias("_p")
    want = groups.select(*key, "n", each).select(*key, "n", "_p.p").withColumn("_h", (F.col("n") - 1) * F.col("p")).withColumn(
        "_r", F.explode(F.array_distinct(F.array(F.floor("_h"), F.ceil("_h")))))
    got = _same(want, hits, [*key, "_r"], "inner").groupBy(*key, "p", "n", "_h").agg(F.min_by("_q", "_r").alias("_a"), F.max_by("_q", "_r").alias("_b"))
    # equal ends need no difference, which infinite ones do not have
    q = F.when(F.col("_a") == F.col("_b"), F.col("_a")).otherwise(F.col("_a") + (F.col("_h") - F.floor("_h")) * (F.col("_b") - F.col("_a")))
    return got.select(*key, "p", q.alias("q"), F.col("n").cast("long").alias("n"))


def exact_median(df: DataFrame, value: str, by=None, out: str = "median") -> DataFrame:
    """Exact median per group: (by..., out)."""
    return exact_quantiles(df, value, [0.5], by).select(*_cols(by), F.col("q").alias(out))


def value_parts(d: DataFrame, by: Sequence[str], x: str, rows: int | None = None) -> DataFrame:
    """``d`` with ``_part``: arrays of digits that are ordered as ``x`` within each ``by`` group;
    rows of one part are at most ``rows`` (``RANGE_ROWS``), or of one value."""
    rows, by, level = rows or RANGE_ROWS, list(by), 0
    d = d.withColumn("_part", F.array().cast("array<int>")).withColumn("_dx", F.col(x).cast("double"))
    key = [*by, "_part"]
    counted = lambda t: _kept(t.groupBy(*key).agg(F.count(F.lit(1)).alias("_dn"), F.min("_dx").alias("_dlo"), F.max("_dx").alias("_dhi")), "parts")
    nodes = counted(d)
    while True:
        big = nodes.where((F.col("_dn") > rows) & (F.col("_dlo") < F.col("_dhi"))).select(*key, "_dlo", "_dhi")
        if big.isEmpty():
            break
        d = _same(d, big, key, "left").withColumn("_part", F.when(F.col("_dlo").isNotNull(), F.concat("_part", F.array(_digit("_dx", "_dlo", "_dhi", level)))).otherwise(F.col("_part")))
        d = d.drop("_dlo", "_dhi")
        level += 1
        nodes = counted(d.where(F.size("_part") == level))
    return d.drop("_dx")


def cumulative_before(
    d: DataFrame,
    x: str,
    weights: Sequence[str],
    by: Sequence[str] | str | None = None,
) -> DataFrame:
    """For a table with one row per distinct (by..., x), add ``<w>_before``: the sum
    of weight ``w`` over rows of the same group with a strictly smaller ``x``, and
    ``<w>_total``. Distributed: prefix sums over parts + a window inside each part."""
    by = _cols(by)
    out_by = by
    if not by:
        d = d.withColumn("_g", F.lit(0))
        by = ["_g"]
    db = value_parts(_kept(d, "distinct"), by, x)  # an aggregate; read once a level
    tot = db.groupBy(*by, "_part").agg(*[F.sum(w).alias(f"_bt_{w}") for w in weights])
    wb = Window.partitionBy(*by).orderBy("_part").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    wall = Window.partitionBy(*by)
    for w in weights:
        tot = tot.withColumn(f"_bs_{w}", F.sum(f"_bt_{w}").over(wb) - F.col(f"_bt_{w}")).withColumn(
            f"{w}_total", F.sum(f"_bt_{w}").over(wall)
        )
    win = Window.partitionBy(*by, "_part").orderBy(x).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    for w in weights:
        db = db.withColumn(f"_in_{w}", F.sum(w).over(win) - F.col(w))
    j = _same(db, tot, [*by, "_part"], "inner")
    for w in weights:
        j = j.withColumn(f"{w}_before", F.col(f"_bs_{w}") + F.col(f"_in_{w}"))
    drop = ["_part", *[f"_{p}_{w}" for w in weights for p in ("bt", "bs", "in")]]
    j = j.drop(*drop)
    return j.drop("_g") if not out_by else j


def average_rank(df: DataFrame, x: str, by: Sequence[str] | str | None = None, out: str = "rank") -> DataFrame:
    """Per distinct (by..., x) its average rank among the group's non-NULL values
    (R ``rank(ties='average')``): ``#smaller + (#equal + 1) / 2``."""
    by = _cols(by)
    d = df.where(F.col(x).isNotNull()).groupBy(*by, x).agg(F.count(F.lit(1)).alias("_w"))
    c = cumulative_before(d, x, ["_w"], by)
    return c.select(*by, x, (F.col("_w_before") + (F.col("_w") + 1) / 2.0).alias(out))
