"""Hash uniform, exact quantiles, positions, first-n, average ranks (both the
one-bucket and the bucketed path), and invariance to partitioning."""
import duckdb
import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from caserank.functions.core import u
from caserank.operators import positions
from caserank.operators.positions import (average_rank, exact_quantiles, first_n, uniform_bucket,
                                          with_positions)


def _skewed(spark, n=3000):
    rng = np.random.default_rng(7)
    x = rng.lognormal(3, 1, n).round(2)
    x[: n // 3] = 42.0  # a hot value holding a third of the rows
    g = np.where(np.arange(n) % 5 == 0, "b", "a")
    pdf = pd.DataFrame({"id": np.arange(n), "g": g, "x": x})
    pdf.loc[pdf.index % 97 == 0, "x"] = None
    return spark.createDataFrame(pdf), pdf


def test_u_matches_duckdb(spark):
    df = spark.range(50).withColumn("u", u("id", "salt"))
    got = [r.u for r in df.orderBy("id").collect()]
    ref = duckdb.sql("select ('0x'||substr(md5(i::varchar||'|salt'),1,13))::bigint/4503599627370496.0::double "
                     "from range(50) t(i) order by i").fetchall()
    assert got == [r[0] for r in ref]
    assert all(0 <= v < 1 for v in got)


def test_exact_quantiles_match_numpy_both_paths(spark, monkeypatch):
    df, pdf = _skewed(spark)
    probs = [0.1, 0.25, 0.5, 0.9]
    for rows, digits in ((10_000, 1024), (16, 1024), (1, 3)):  # no cut, one or two levels, many levels
        monkeypatch.setattr(positions, "RANGE_ROWS", rows)
        monkeypatch.setattr(positions, "DIGITS", digits)
        res = {(r.g, r.p): r.q for r in exact_quantiles(df, "x", probs, by="g").collect()}
        for g, part in pdf.dropna().groupby("g"):
            for p in probs:
                assert abs(res[(g, p)] - np.quantile(part.x, p)) < 1e-9
        glob = {r.p: r.q for r in exact_quantiles(df, "x", probs).collect()}
        for p in probs:
            assert abs(glob[p] - np.quantile(pdf.x.dropna(), p)) < 1e-9


def test_positions_are_a_permutation_and_partition_invariant(spark):
    df, _ = _skewed(spark)
    d = df.withColumn("uu", u("id", "p"))
    outs = []
    for parts in (1, 7):
        p = with_positions(d.repartition(parts), ["uu", "id"], uniform_bucket(F.col("uu"), 8), by="g")
        outs.append({r.id: r.pos for r in p.collect()})
        sizes = p.groupBy("g").agg(F.max("pos").alias("m"), F.count("*").alias("n"), F.countDistinct("pos").alias("d"))
        for r in sizes.collect():
            assert r.m == r.n == r.d
    assert outs[0] == outs[1]


def test_first_n_exact(spark):
    df, pdf = _skewed(spark)
    d = df.withColumn("uu", u("id", "s"))
    got = sorted(r.id for r in first_n(d, ["uu", "id"], uniform_bucket(F.col("uu"), 16), 123).collect())
    ref = d.orderBy("uu", "id").limit(123).toPandas().id.sort_values().tolist()
    assert got == ref


def test_average_rank_matches_pandas(spark, monkeypatch):
    df, pdf = _skewed(spark)
    for buckets_df, rows, digits in ((df, 10_000, 1024), (df.repartition(3), 20, 1024), (df, 2, 4)):
        monkeypatch.setattr(positions, "RANGE_ROWS", rows)
        monkeypatch.setattr(positions, "DIGITS", digits)
        r = {(x.g, x.x): x.rank for x in average_rank(buckets_df, "x", by="g").collect()}
        for g, part in pdf.dropna().groupby("g"):
            ranks = part.x.rank(method="average")
            for v, rk in zip(part.x, ranks):
                assert abs(r[(g, v)] - rk) < 1e-9


def test_digits_of_hard_values(spark, monkeypatch):
    """Heavy tails, tiny and huge spans, infinities, NaN, hot values, NULL groups."""
    monkeypatch.setattr(positions, "RANGE_ROWS", 3)
    rng = np.random.default_rng(5)
    hard = {
        "powers": 2.0 ** np.arange(-300, 300), "tiny": np.arange(40) * 5e-324, "huge": np.r_[np.linspace(-1.7, 1.7, 41) * 1e308, -np.inf, np.inf],
        "tail": np.exp(rng.normal(0, 20, 200)), "hot": np.r_[np.full(300, 7.0), 1.0, 2.0, 9.0], "near": 1.0 + np.arange(50) * 2.0 ** -52, None: -np.arange(30.0) ** 3,
    }
    rows = [(g, float(v)) for g, x in hard.items() for v in x] + [("hot", None), ("hot", float("nan")), ("none", None)]
    df = spark.createDataFrame(rows, "g string, x double").repartition(4)
    probs = [0.0, 0.3, 0.5, 1.0]
    got = {(r.g, r.p): (r.q, r.n) for r in exact_quantiles(df, "x", probs, by="g").collect()}
    for g, x in hard.items():
        for p in probs:
            order = np.sort(x)
            h = (len(x) - 1) * p
            a, b = float(order[int(np.floor(h))]), float(order[int(np.ceil(h))])
            want = a if a == b else a + (h - np.floor(h)) * (b - a)
            assert got[g, p] == (want, len(x)), (g, p)
    assert len(got) == len(hard) * len(probs)
    ranks = {(r.g, r.x): r["rank"] for r in average_rank(df.where("not isnan(x)"), "x", by="g").collect()}
    for g, x in hard.items():
        want = pd.Series(x).rank(method="average")
        assert all(ranks[g, float(v)] == r for v, r in zip(x, want))


def test_several_columns_in_one_run(spark):
    df, pdf = _skewed(spark, 500)
    both = positions.quantiles_of(df.withColumn("y", F.col("id") * 2.5), ["x", "y"], [0.25, 0.75])
    got = {(r["column"], r.p): r.q for r in both.collect()}
    assert np.allclose([got["x", 0.25], got["x", 0.75]], np.quantile(pdf.x.dropna(), [0.25, 0.75]))
    assert np.allclose([got["y", 0.25], got["y", 0.75]], np.quantile(pdf.id * 2.5, [0.25, 0.75]))
