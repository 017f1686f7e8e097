"""Labels (edge cases), imputation properties, sampling properties."""
import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from caserank.operators.impute import clip, fill_constant, fill_donor, fill_empirical, fill_group_stat, fill_stat
from caserank.operators.label import success_label
from caserank.operators.sampling import min_max, permute_columns, sample_exact, split


def test_success_label_edges(spark):
    cases = spark.createDataFrame([(1, 100.0), (2, 0.0), (3, 0.0), (4, 100.0), (5, 100.0)], "case_id long, toa double")
    pay = spark.createDataFrame(
        [(1, 1, 10.0, 1), (2, 1, 5.0, 1), (3, 1, 0.0, 1), (4, 1, 1.0, 1), (4, 2, 1.0, 1), (9, 1, 1.0, 1)],
        "case_id long, month int, payment_amount double, number_of_payment int")
    r = {x.case_id: x for x in success_label(cases, pay, keep_parts=True).collect()}
    assert r[1].suc == 1                       # 10% paid
    assert r[2].suc1 == 1                      # TOA = 0, paid > 0: +Inf
    assert r[3].suc1 is None and r[3].suc is None  # 0/0
    assert r[4].suc1 == 0 and r[4].suc2 == 1 and r[4].suc == 1
    assert 5 not in r                          # case without payments drops out
    assert r[9].suc is None                    # payments of an unknown case: NULL TOA


def _gappy(spark, n=2000):
    rng = np.random.default_rng(3)
    pdf = pd.DataFrame({"id": np.arange(n), "cat": rng.integers(1, 8, n).astype(float),
                        "v": rng.normal(10, 3, n), "g": rng.integers(0, 3, n), "age": rng.integers(18, 80, n)})
    pdf.loc[rng.random(n) < 0.2, "cat"] = np.nan
    pdf.loc[rng.random(n) < 0.2, "v"] = np.nan
    pdf.loc[rng.random(n) < 0.1, "age"] = -1
    return spark.createDataFrame(pdf).withColumn("cat", F.col("cat").cast("int")), pdf


def test_fills_leave_no_null_and_keep_observed(spark):
    df, pdf = _gappy(spark)
    for out in (fill_constant(df, "v", 0.0), fill_stat(df, "v", "median"), fill_group_stat(df, "v", "g", "mean"),
                fill_group_stat(df, "v", "g", "median")):
        o = out.toPandas().set_index("id").sort_index()
        assert o.v.isna().sum() == 0
        keep = pdf.set_index("id").v.notna()
        assert np.allclose(o.v[keep], pdf.set_index("id").v[keep])
    e = fill_empirical(df, "cat", "id").toPandas().set_index("id").sort_index()
    assert e.cat.isna().sum() == 0 and set(e.cat.unique()) <= set(pdf.cat.dropna().astype(int))
    obs = pdf.set_index("id").cat.notna()
    assert (e.cat[obs] == pdf.set_index("id").cat[obs]).all()


def test_empirical_draw_follows_frequencies(spark):
    df, pdf = _gappy(spark, 20000)
    e = fill_empirical(df, "cat", "id").toPandas()
    drawn = e[pdf.cat.isna().values].cat.value_counts(normalize=True).sort_index()
    obs = pdf.cat.dropna().value_counts(normalize=True).sort_index()
    assert np.abs(drawn.values - obs.values).max() < 0.03


def test_donor_and_clip(spark):
    df, pdf = _gappy(spark)
    d = fill_donor(df, "age", "id", recipient=F.col("age") == -1, donor=F.col("age") != -1).toPandas()
    assert (d.age == -1).sum() == 0 and d.age.between(18, 80).all() and len(d) == len(pdf)
    c = clip(spark.createDataFrame([(1, -2.0), (2, 3.0), (3, None)], "id int, x double"), "x", lower=0.0).collect()
    assert [r.x for r in sorted(c, key=lambda r: r.id)] == [0.0, 3.0, None]


def test_sampling_properties(spark):
    df, pdf = _gappy(spark)
    s = split(df, "id", [0.6, 0.2, 0.2]).groupBy("split").count().toPandas()
    assert s["count"].sum() == len(pdf) and set(s.split) == {0, 1, 2}
    assert sample_exact(df, "id", 777).count() == 777
    p = permute_columns(df.select("id", "v", "g"), "id", ["v"], by="g").toPandas()
    for g, part in pdf.groupby("g"):
        a = np.sort(part.v.fillna(-999).values)
        b = np.sort(p[p.g == g].v.fillna(-999).values)
        assert np.array_equal(a, b)
    assert not np.array_equal(p.sort_values("id").v.fillna(-9).values, pdf.v.fillna(-9).values)
    m = min_max(spark.createDataFrame([(1, 5.0, 1.0), (2, 5.0, 3.0)], "id int, c double, x double"), ["c", "x"]).collect()
    assert [r.c_nrm for r in m] == [0.0, 0.0] and sorted(r.x_nrm for r in m) == [0.0, 1.0]
