"""kNN vs NumPy brute force (incl. removal metrics), logit p-values vs NumPy IRLS,
aliased columns, relative influence, PAM/CLARA on separable data."""
import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from caserank.operators import models as M
from caserank.operators.cluster import clara, pam
from caserank.operators.knn import knn_removal_importance, neighbours


def _xy(n, p, seed):
    rng = np.random.default_rng(seed)
    X = rng.random((n, p)).round(2)
    y = (X[:, 0] + 0.3 * rng.random(n) > 0.6).astype(int)
    pdf = pd.DataFrame(X, columns=[f"f{i}" for i in range(p)])
    pdf.insert(0, "id", np.arange(n))
    pdf["y"] = y
    return pdf


def _brute(tr, te, feats, k):
    out = {}
    for _, q in te.iterrows():
        d = np.round(np.sqrt(((tr[feats].values - q[feats].values.astype(float)) ** 2).sum(1)), 9)
        order = np.lexsort((tr.id.values, d))[:k]
        out[int(q.id)] = list(tr.id.values[order])
    return out


def test_neighbours_match_brute_force_across_blocks(spark):
    pdf = _xy(700, 4, 1)
    tr, te = pdf[pdf.id % 4 != 0], pdf[pdf.id % 4 == 0]
    feats = ["f0", "f1", "f2", "f3"]
    nb = neighbours(spark.createDataFrame(tr), spark.createDataFrame(te), "id", feats, "y", 7,
                    removals=[["f0"], ["f1", "f2"]], train_block=100, query_chunk=40).toPandas()
    for m, fs in enumerate([feats, ["f1", "f2", "f3"], ["f0", "f3"]]):
        ref = _brute(tr, te, fs, 7)
        got = nb[nb.metric == m].sort_values(["qkey", "rank"]).groupby("qkey").nkey.apply(list).to_dict()
        assert got == ref


def test_removal_importance_has_all_models(spark):
    pdf = _xy(400, 3, 2)
    df = spark.createDataFrame(pdf)
    r = knn_removal_importance(df.where("id % 3 <> 0"), df.where("id % 3 = 0"), "id", ["f0", "f1", "f2"], "y", 5,
                               {"f0": ["f0"], "f1": ["f1"], "f2": ["f2"]}).toPandas().set_index("name")
    assert set(r.index) == {"All", "f0", "f1", "f2"} and abs(r.loc["All", "prop_of_err"] - 1) < 1e-12
    assert r.loc["f0", "prop_of_err"] > 1  # f0 drives the label


def _irls(X, y):
    X = np.column_stack([X, np.ones(len(X))])
    b = np.zeros(X.shape[1])
    for _ in range(50):
        mu = 1 / (1 + np.exp(-X @ b))
        W = mu * (1 - mu)
        H = X.T @ (X * W[:, None])
        b = b + np.linalg.solve(H, X.T @ (y - mu))
    mu = 1 / (1 + np.exp(-X @ b))
    cov = np.linalg.inv(X.T @ (X * (mu * (1 - mu))[:, None]))
    return b, np.sqrt(np.diag(cov))


def test_logit_pvalues_and_aliasing(spark):
    from math import erfc, sqrt
    pdf = _xy(800, 3, 3)
    pdf["f3"] = pdf.f0 + pdf.f1  # exactly aliased
    df = spark.createDataFrame(pdf)
    feats = ["f0", "f1", "f2", "f3"]
    assert M.aliased_columns(df, feats) == ["f3"]
    fitted = M.fit_logit(df, feats, "y")
    pv = {r.var: r.pval for r in M.logit_pvalues(spark, fitted, feats).collect()}
    b, se = _irls(pdf[["f0", "f1", "f2"]].values, pdf.y.values)
    for i, f in enumerate(["f0", "f1", "f2"]):
        assert abs(pv[f] - erfc(abs(b[i] / se[i]) / sqrt(2))) < 1e-6
    assert pv["f3"] is None


def test_relative_influence_sums_to_100(spark):
    pdf = _xy(300, 3, 4)
    m = M.fit_gbt_classifier(spark.createDataFrame(pdf), ["f0", "f1", "f2"], "y", max_iter=5, max_depth=2,
                             min_instances=5)
    imp = M.importance(m, ["f0", "f1", "f2"])
    assert abs(sum(v for _, v in imp) - 100) < 1e-9 and imp[0][0] == "f0"


def test_pam_and_clara_separate_blobs(spark):
    rng = np.random.default_rng(6)
    centers = np.array([[0, 0], [10, 10], [0, 10]])
    X = np.concatenate([c + rng.normal(0, 0.5, (60, 2)) for c in centers])
    med = pam(X, 3)
    assert sorted(int(m // 60) for m in med) == [0, 1, 2]
    pdf = pd.DataFrame({"id": np.arange(len(X)), "a": X[:, 0], "b": X[:, 1]})
    out, medoids = clara(spark.createDataFrame(pdf), "id", ["a", "b"], k=3, samples=5, sampsize=40)
    lab = out.toPandas().sort_values("id").cluster.values
    assert medoids.count() == 3
    for blob in range(3):
        assert len(set(lab[blob * 60:(blob + 1) * 60])) == 1
