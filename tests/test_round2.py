"""Exactness of kNN at any scale, permutations with NULLs, PAM swaps, sessions without a
shared folder, one path for positions, and rank tables with missing ids."""
import collections

import numpy as np
import pytest
from pyspark.sql import functions as F

from caserank.operators.cluster import clara, pam
from caserank.operators.importance import BASELINE, permuted_beside, scenarios
from caserank.operators.knn import knn_regress_k_grid, knn_removal_importance, neighbours
from caserank.operators import positions
from caserank.operators.positions import average_rank, exact_quantiles
from caserank.operators.ranking import consensus_rank
from caserank.functions.core import label_number, strip_suffix
from caserank.session import ensure_checkpoint_dir


def brute_neighbours(q, t, feats, k, exclude_self=False):
    out = {}
    for key, x in q.items():
        d = sorted((round(float(np.sqrt(sum((x[f] - y[f]) ** 2 for f in feats))), 9), nk) for nk, y in t.items() if not (exclude_self and nk == key))
        out[key] = d[:k]
    return out


@pytest.mark.parametrize("scale", [1.0, 1e5, 1e9])
@pytest.mark.parametrize("exclude_self", [False, True])
def test_knn_is_complete_and_exact(spark, scale, exclude_self):
    r = np.random.default_rng(int(scale) % 97)
    pts = {i: (r.random(3) * scale).tolist() for i in range(120)}
    for i in range(0, 30, 3):
        pts[i + 1] = list(pts[i])  # exact duplicates
    df = spark.createDataFrame([(i, *v, float(i)) for i, v in pts.items()], "id long, a double, b double, c double, y double")
    nb = neighbours(df, df, "id", ["a", "b", "c"], "y", 5, train_block=32, query_chunk=32, exclude_self=exclude_self)
    got = collections.defaultdict(list)
    for x in nb.orderBy("qkey", "rank").collect():
        got[x.qkey].append((x.dist, x.nkey))
    want = brute_neighbours(pts, pts, range(3), 5, exclude_self)
    assert got.keys() == want.keys()
    for key in want:
        assert [n for _, n in got[key]] == [n for _, n in want[key]]
        assert np.allclose([d for d, _ in got[key]], [d for d, _ in want[key]], rtol=1e-12, atol=2e-9)


def test_knn_removal_against_brute_force(spark):
    r = np.random.default_rng(4)
    rows = [(i, *r.random(4).tolist(), int(r.random() < 0.5)) for i in range(150)]
    df = spark.createDataFrame(rows, "id long, a double, b double, c double, d double, y int")
    train, test = df.where("id < 100"), df.where("id >= 100")
    groups = {"a": ["a"], "b": ["b"], "basket": ["c", "d"]}
    got = {x.name: x.class_error for x in knn_removal_importance(train, test, "id", ["a", "b", "c", "d"], "y", 7, groups).collect()}
    pts = {x[0]: x[1:5] for x in rows}
    label = {x[0]: x[5] for x in rows}
    names = ["a", "b", "c", "d"]
    for name, removed in {"All": [], **groups}.items():
        feats = [i for i, f in enumerate(names) if f not in removed]
        nb = brute_neighbours({i: pts[i] for i in range(100, 150)}, {i: pts[i] for i in range(100)}, feats, 7)
        wrong = [int(np.mean([label[n] for _, n in v]) >= 0.5) != label[i] for i, v in nb.items()]
        assert abs(got[name] - np.mean(wrong)) < 1e-12, name


def test_knn_grid_runs_all_resamples(spark):
    df = spark.range(60).select("id", (F.col("id") % 7).cast("double").alias("a"), (F.col("id") * 1.5).alias("y"))
    got = knn_regress_k_grid(df, "id", ["a"], "y", [1, 3], resamples=20).collect()
    assert len(got) == 40 and {r.replicate for r in got} == set(range(1, 21))


def test_permutation_keeps_every_value_with_nulls(spark):
    rows = [(i, None if i % 2 else float(i), float(i % 5)) for i in range(40)]
    df = spark.createDataFrame(rows, "id long, x double, z double")
    beside = permuted_beside(df, "id", ["x", "z"])
    got = beside.collect()
    assert len(got) == 40
    for c in ("x", "z"):
        assert collections.Counter(r[f"_p_{c}"] for r in got) == collections.Counter(r[c] for r in got)
    by = collections.defaultdict(list)
    for r in scenarios(beside, ["x", "z"], {"x": ["x"], "both": ["x", "z"]}).collect():
        by[r.scenario].append((r.x, r.z))
    assert sorted(by) == sorted([BASELINE, "x", "both"]) and all(len(v) == 40 for v in by.values())
    assert sum(x is None for x, _ in by["x"]) == 20 and sorted(z for _, z in by["x"]) == sorted(z for _, z in by[BASELINE])


def slow_pam(X, k):
    D = np.sqrt(((X[:, None] - X[None]) ** 2).sum(-1))
    med = [int(np.argmin(D.sum(1)))]
    while len(med) < k:
        gain = np.maximum(D[:, med].min(1)[:, None] - D, 0).sum(0)
        gain[med] = -1
        med.append(int(np.argmax(gain)))
    while True:
        cost = D[:, med].min(1).sum()
        best = min(((D[:, med[:m] + [h] + med[m + 1:]].min(1).sum(), m, h) for m in range(k) for h in range(len(X)) if h not in med))
        if best[0] >= cost - 1e-12:
            return cost
        med[best[1]] = best[2]


@pytest.mark.parametrize("k", [1, 2, 4])
def test_pam_reaches_the_same_cost_as_plain_swaps(k):
    X = np.random.default_rng(k).random((30, 3))
    D = np.sqrt(((X[:, None] - X[None]) ** 2).sum(-1))
    assert abs(D[:, pam(X, k)].min(1).sum() - slow_pam(X, k)) < 1e-9


def test_clara_assigns_each_row_to_its_nearest_medoid(spark):
    r = np.random.default_rng(2)
    pts = np.vstack([r.normal(c, 0.05, (60, 2)) for c in ((0, 0), (1, 0), (0, 1))])
    rows = [(i, float(a), float(b)) for i, (a, b) in enumerate(pts)] + [(999, None, 0.0)]
    out, med = clara(spark.createDataFrame(rows, "id long, a double, b double"), "id", ["a", "b"], k=3, samples=5, sampsize=60)
    m = np.array([[x.a, x.b] for x in med.orderBy("cluster").collect()])
    for x in out.collect():
        assert x.cluster == (None if x.a is None else int(np.argmin(((m - [x.a, x.b]) ** 2).sum(1))) + 1)
    assert len({x.cluster for x in out.where("id < 60").collect()}) == 1


def test_quantiles_and_ranks_over_many_buckets(spark, monkeypatch):
    monkeypatch.setattr(positions, "RANGE_ROWS", 40)
    r = np.random.default_rng(8)
    v = np.round(r.normal(0, 3, 3000), 2)
    df = spark.createDataFrame([(int(i % 3), float(x)) for i, x in enumerate(v)], "g int, x double")
    for g in range(3):
        own = v[np.arange(3000) % 3 == g]
        got = {x.p: x.q for x in exact_quantiles(df, "x", [0.1, 0.5, 0.9], by="g").where(F.col("g") == g).collect()}
        assert np.allclose([got[p] for p in (0.1, 0.5, 0.9)], np.quantile(own, [0.1, 0.5, 0.9]))
    one = df.where("g = 0")
    order = np.sort(v[np.arange(3000) % 3 == 0])
    for x in average_rank(one, "x").collect():
        lo, hi = np.searchsorted(order, x.x, "left"), np.searchsorted(order, x.x, "right")
        assert x["rank"] == (lo + 1 + hi) / 2


def test_missing_ids_stay_in_the_consensus(spark):
    a = spark.createDataFrame([("p", 1), ("q", 2)], "var string, r1 int")
    b = spark.createDataFrame([("p", 1), ("s", 2)], "var string, r2 int")
    got = {x["var"]: (x.avg_place, x.place) for x in consensus_rank([a, b], "var", ["r1", "r2"]).collect()}
    assert got == {"p": (1.0, 1), "q": (None, 2), "s": (None, 3)}


def test_labels(spark):
    r = spark.createDataFrame([(0.12345, "toa_nrm"), (2.5, "abc")], "x double, s string").select(label_number("x", 3).alias("x"), strip_suffix("s").alias("s")).collect()
    assert [tuple(x) for x in r] == [(0.123, "toa"), (2.5, "abc")]


def test_no_local_folder_on_a_cluster():
    class Conf:
        def get(self, *_):
            return None

    class Context:
        master = "spark://somewhere:7077"

        def getCheckpointDir(self):
            return None

    class Session:
        conf, sparkContext = Conf(), Context()

    with pytest.raises(RuntimeError):
        ensure_checkpoint_dir(Session())


def test_fill_formula_comes_from_the_data(spark):
    from caserank.operators.models import best_params, fill_model, grid_search_regressor, hold_out, select_features, top_features

    r = np.random.default_rng(0)
    rows = [(i, *(float(x) for x in r.random(4))) for i in range(600)]
    rows = [(i, a, b, c, d, None if i % 10 == 0 else 5 * a + 3 * b, i) for i, a, b, c, d in rows]
    df = spark.createDataFrame(rows, "case_id long, a double, b double, c double, d double, y double, n int")
    train, hold = hold_out(df, "case_id", "y", ["a", "b", "c", "d"])
    assert train.count() + hold.count() == 540 and train.join(hold, "case_id").count() == 0
    grid = grid_search_regressor(train, hold, ["a", "b", "c", "d"], "y", "gbt", {"max_depth": [1, 3]}, {"max_iter": 5, "min_instances": 5})
    assert grid.count() == 8 and set(top_features(grid, ["max_depth"], 2)) == {"a", "b"}
    assert {x["var"] for x in select_features(grid).where("selected = 1").collect()} >= {"a", "b"}
    assert best_params(grid, ["max_depth"], "mse")["max_depth"] == 3
    out, err = fill_model(df, "y", ["a", "b"], "gbt", max_iter=5, min_instances=5)
    assert out.schema == df.schema and out.where("y IS NULL").count() == 0 and err.first().mse < 1
    assert out.where("case_id % 10 <> 0").orderBy("case_id").collect() == df.where("y IS NOT NULL").orderBy("case_id").collect()
