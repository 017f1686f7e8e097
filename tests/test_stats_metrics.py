"""Correlation, baskets (vs a brute-force linkage), ROC/AUC (vs pairwise brute force)."""
import itertools

import numpy as np
import pandas as pd

from caserank.operators.metrics import evaluate_binary, roc_points
from caserank.operators.stats import complete_linkage, corr_matrix, cut_tree, merge_table, target_correlation


def test_corr_matrix_numpy_and_constant(spark):
    rng = np.random.default_rng(1)
    pdf = pd.DataFrame(rng.normal(size=(500, 3)), columns=["a", "b", "c"])
    pdf["b"] = pdf.a * 0.5 + pdf.b
    pdf["k"] = 1.0
    cm = {(r.var_a, r.var_b): r.corr for r in corr_matrix(spark.createDataFrame(pdf), ["a", "b", "c", "k"]).collect()}
    ref = np.corrcoef(pdf[["a", "b", "c"]].T.values)
    for i, x in enumerate("abc"):
        for j, y in enumerate("abc"):
            assert abs(cm[(x, y)] - ref[i, j]) < 1e-9
    assert cm[("k", "a")] is None and cm[("k", "k")] is None


def test_spearman_matches_pandas(spark):
    rng = np.random.default_rng(2)
    pdf = pd.DataFrame({"id": range(400), "y": rng.integers(0, 2, 400), "x": rng.integers(0, 20, 400).astype(float)})
    r = target_correlation(spark.createDataFrame(pdf), "y", ["x"], key="id").first()
    assert abs(r.cor_spear - pdf.x.rank().corr(pdf.y.rank())) < 1e-9
    assert abs(r.cor_lin - pdf.x.corr(pdf.y)) < 1e-9


def _naive_complete(dist, k):
    clusters = [{i} for i in range(len(dist))]
    while len(clusters) > k:
        best = None
        for a, b in itertools.combinations(range(len(clusters)), 2):
            d = max(dist[i, j] for i in clusters[a] for j in clusters[b])
            if best is None or d < best[0]:
                best = (d, a, b)
        _, a, b = best
        clusters[a] |= clusters.pop(b)
    lab = {}
    for c in clusters:
        for i in c:
            lab[i] = c
    ids, out = {}, []
    for i in range(len(dist)):
        key = min(lab[i])
        ids.setdefault(key, len(ids) + 1)
        out.append(ids[key])
    return out


def test_complete_linkage_matches_brute_force():
    rng = np.random.default_rng(4)
    pts = rng.normal(size=(12, 3))
    dist = np.sqrt(((pts[:, None] - pts[None]) ** 2).sum(-1))
    for k in (2, 4, 6):
        assert cut_tree(12, complete_linkage(dist), k) == _naive_complete(dist, k)


def test_auc_and_threshold_brute_force(spark):
    rng = np.random.default_rng(5)
    n = 300
    pdf = pd.DataFrame({"g": rng.integers(0, 2, n), "y": rng.integers(0, 2, n)})
    pdf["s"] = (pdf.y + rng.normal(0, 1, n)).round(1)  # many ties
    ev = {r.g: r for r in evaluate_binary(spark.createDataFrame(pdf), "s", "y", "g").collect()}
    for g, part in pdf.groupby("g"):
        pos, neg = part[part.y == 1].s.values, part[part.y == 0].s.values
        auc = ((pos[:, None] > neg[None, :]).sum() + 0.5 * (pos[:, None] == neg[None, :]).sum()) / (len(pos) * len(neg))
        assert abs(ev[g].auc - auc) < 1e-12
        best = None
        for t in sorted(part.s.unique()):
            pred = part.s >= t
            sens = (pred & (part.y == 1)).sum() / len(pos)
            spec = (~pred & (part.y == 0)).sum() / len(neg)
            d = (1 - sens) ** 2 + (1 - spec) ** 2
            if best is None or d < best[0] - 1e-15:
                best = (d, t, (pred != (part.y == 1)).mean())
        assert ev[g].threshold == best[1] and abs(ev[g].class_error - best[2]) < 1e-12
    assert roc_points(spark.createDataFrame(pdf), "s", "y", "g").count() == pdf.groupby(["g", "s"]).ngroups


def test_corr_matrix_skips_missing_values_in_pairs_at_any_width(spark):
    rng = np.random.default_rng(6)
    x = rng.normal(size=(300, 60)) @ rng.normal(size=(60, 60)) + 1e6
    x[rng.random(x.shape) < 0.1] = np.nan
    x[:, 7] = 0.1  # constant
    cols = [f"v{k}" for k in range(60)]
    df = spark.createDataFrame([tuple(None if np.isnan(v) else float(v) for v in r) for r in x], ", ".join(f"{c} double" for c in cols)).repartition(3)
    for complete in (False, True):
        some = 60 if not complete else 8
        ref = pd.DataFrame(x[:, :some], columns=cols[:some])
        ref = (ref.dropna() if complete else ref).corr()
        got = {(r.var_a, r.var_b): r.corr for r in corr_matrix(df, cols[:some], complete_only=complete).collect()}
        assert len(got) == some * some
        for (a, b), v in got.items():
            assert v is None if "v7" in (a, b) else abs(v - ref.loc[a, b]) < 1e-9


def test_nearest_neighbour_chain_gives_greedy_merges():
    for seed in range(20):
        x = np.random.default_rng(seed).normal(size=(12, 3))
        d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1))
        groups, heights = [{k} for k in range(12)], []
        merges = complete_linkage(d)
        while len(groups) > 1:
            h, a, b = min((max(d[i, j] for i in groups[a] for j in groups[b]), a, b) for a, b in itertools.combinations(range(len(groups)), 2))
            step = merges[len(heights)]
            assert {step[0], step[1]} == {min(groups[a]), min(groups[b])} and step[0] < step[1]
            heights.append(h)
            groups[a] |= groups.pop(b)
        assert np.allclose([m[2] for m in merges], heights)


def test_merge_table(spark):
    rng = np.random.default_rng(9)
    a = rng.normal(size=400)
    pdf = pd.DataFrame({"a": a, "b": a + 0.01 * rng.normal(size=400), "c": rng.normal(size=400)})
    rows = merge_table(spark.createDataFrame(pdf), ["a", "b", "c"]).orderBy("step").collect()
    assert [(r.step, r.var_a, r.var_b, r["size"]) for r in rows] == [(1, "a", "b", 2), (2, "a", "c", 3)] and rows[0].height < rows[1].height
