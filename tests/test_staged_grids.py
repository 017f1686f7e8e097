"""Staged ensembles, node tables and resumable grids."""
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from caserank.operators import grid as G
from caserank.operators import models as M
from caserank.operators import trees as T
from caserank.operators.metrics import evaluate_binary, regression_error

X = ["a", "b", "c"]


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(600, 3)).round(2)
    y = (x[:, 0] + x[:, 1] ** 2 + rng.normal(size=600) > 1).astype(int)
    data = [(i, *map(float, r), int(t), float(r[0] * 3 + r[1] + i % 7)) for i, (r, t) in enumerate(zip(x, y))]
    return spark.createDataFrame(data, "id long, a double, b double, c double, y int, z double").repartition(2, "id").cache()


def one(df, cols):
    r = df.first()
    return [r[c] for c in cols]


def test_prefixes_equal_separate_fits(spark, rows):
    train, hold = rows.where("id % 3 > 0"), rows.where("id % 3 = 0")
    cols = ["class_error", "threshold", "auc"]
    got = M.grid_search_classifier(train, hold, X, "y", {"step_size": [0.1, 0.3], "max_iter": [2, 5, 9]}, {"max_depth": 3, "min_instances": 5, "subsampling": 0.6})
    assert got.count() == 6 * len(X)
    for step in (0.1, 0.3):
        for m in (2, 5, 9):
            frame = M.fit_frame(train, X, "y").coalesce(1)
            own = M.estimator("classifier", "y", 3, step_size=step, max_iter=m, max_depth=3, min_instances=5, subsampling=0.6).fit(frame)
            want = one(evaluate_binary(M.score(own, hold, X), "score", "y"), cols)
            part = got.where((F.col("step_size") == step) & (F.col("max_iter") == m))
            assert one(part, cols) == pytest.approx(want, abs=1e-12)
            assert {r["var"]: r["rel_inf"] for r in part.collect()} == pytest.approx(dict(M.importance(own, X)), abs=1e-9)


def test_regression_grids_equal_separate_fits(spark, rows):
    train, hold = rows.where("id % 3 > 0"), rows.where("id % 3 = 0")
    grids = {"gbt": {"max_depth": [2], "max_iter": [1, 4], "min_instances": [5]}, "rf": {"num_trees": [3, 6], "min_instances": [20]}}
    for kind, grid in grids.items():
        got = M.grid_search_regressor(train, hold, X, "z", kind, grid, post=F.rint).collect()
        assert len(got) == 2 * len(X)
        for r in got:
            own = M.estimator(kind, "z", 3, **{n: r[n] for n in grid}).fit(M.fit_frame(train, X, "z").coalesce(1))
            scored = M.score(own, hold, X).withColumn("score", F.rint("score"))
            assert [r.mse, r.mean_abs_prop] == pytest.approx(one(regression_error(scored, "score", "z"), ["mse", "mean_abs_prop"]), rel=1e-9)


def test_node_table_sums_to_importances(spark, rows):
    frame = M.fit_frame(rows, X, "z")
    forest = M.estimator("rf", "z", 3, num_trees=5, min_instances=20).fit(frame)
    nodes = T.node_table(spark, forest)
    purity = {r["var"]: r["inc_node_purity"] for r in T.inc_node_purity(nodes, X).collect()}
    # the forest's importances average each tree's share; the unnormalised sums per tree give them back
    by_tree = {}
    for r in T.impurity_decrease(nodes).collect():
        by_tree.setdefault(r["tree"], np.zeros(3))[r["feature"]] += r["decrease"]
    share = sum(d / d.sum() for d in by_tree.values())
    assert share / share.sum() == pytest.approx(forest.featureImportances.toArray(), abs=1e-12)
    assert [purity[v] for v in X] == pytest.approx(sum(by_tree.values()) / 5)
    # by definition: what a split takes off the sum of squares
    root = [r for r in nodes.where("node = 0 and tree = 0").collect()][0]
    assert root["feature"] is not None and root["gain"] * root["rows"] > 0
    boosted = M.estimator("gbt", "z", 3, max_iter=4, max_depth=2, min_instances=5).fit(frame)
    e = T.ensemble(spark, boosted, 3)
    assert e.influence(4) == pytest.approx(100 * boosted.featureImportances.toArray())


def test_forest_grows_to_its_node_size(spark, rows):
    deep = M.estimator("rf", "z", 3, num_trees=2, min_instances=2).fit(M.fit_frame(rows, X, "z"))
    assert max(t.depth for t in deep.trees) > 5
    sizes = T.node_table(spark, deep).where("feature is null").agg(F.min("rows")).first()[0]
    assert sizes >= 2


def test_killed_run_fits_only_missing_points(spark, rows, tmp_path):
    points = [{"p": k} for k in range(6)]
    done = []

    def fit(point):
        if point["p"] == 4 and len(done) < 10:
            raise RuntimeError("killed")
        done.append(point["p"])
        return [(float(point["p"]), "x")]

    store = G.GridStore(spark, "t", ["s"], "p double, v string", str(tmp_path))
    with pytest.raises(RuntimeError, match="killed"):
        G.run_grid(store, points, fit, workers=2)
    first = list(done)
    assert 4 not in first
    done += [None] * 10
    again = G.run_grid(G.GridStore(spark, "t", ["s"], "p double, v string", str(tmp_path)), points, fit, workers=2)
    assert sorted(r["p"] for r in again.collect()) == [0, 1, 2, 3, 4, 5]
    assert sorted(first + done[len(first) + 10:]) == [0, 1, 2, 3, 4, 5]  # no point twice
    G.run_grid(store, points, lambda p: 1 / 0)  # nothing left to fit
    assert G.run_grid(store, points[:2], lambda p: 1 / 0).count() == 2
    assert G.GridStore(spark, "t", ["other inputs"], "p double, v string", str(tmp_path)).table().count() == 0


def test_grid_search_is_kept_by_state(spark, rows, monkeypatch):
    grid, state = {"max_depth": [1, 2], "max_iter": [1, 2]}, [math.pi]
    a = M.grid_search_classifier(rows, rows, X, "y", grid, state=state).collect()
    monkeypatch.setattr(M, "fit_frame", None)  # a second run must not fit
    b = M.grid_search_classifier(rows, rows, X, "y", grid, state=state).collect()
    assert sorted(a) == sorted(b) and len(a) == 4 * len(X)


def test_split_by_category_is_followed(spark):
    """Only a set of categories separates the values; a threshold on their numbers cannot."""
    from pyspark.ml.feature import VectorAssembler, VectorIndexer

    data = [(float(k % 6), float(k % 6 in (0, 3, 5)) * 10 + (k % 4) * 0.1) for k in range(240)]
    df = VectorAssembler(inputCols=["g"], outputCol="raw").transform(spark.createDataFrame(data, "g double, z double"))
    frame = VectorIndexer(inputCol="raw", outputCol="features", maxCategories=10).fit(df).transform(df)
    model = M.estimator("gbt", "z", 1, max_iter=2, max_depth=1, min_instances=5).fit(frame.select("features", "z"))
    e = T.ensemble(spark, model, 1)
    assert (e.categories >= 0).any()
    got = e.stages(np.arange(6.0)[:, None], [2], False)[:, 0]
    want = {r["g"]: r["prediction"] for r in model.transform(frame).select("g", "prediction").distinct().collect()}
    assert got == pytest.approx([want[float(k)] for k in range(6)])


def test_factors_carry_their_levels_into_the_fit(spark):
    """Only a set of levels separates the classes; the numbers of the levels are in no order."""
    rows = [(k, k % 9, float(k % 4), int(k % 9 in (0, 4, 5, 8))) for k in range(360)]
    df = spark.createDataFrame(rows, "id long, land int, x double, y int")
    levels = M.nominal_levels(df, ["land", "id"])
    assert levels == {"land": list(range(9))}  # too many ids to be a factor
    frame = M.fit_frame(df, ["land", "x"], "y", levels)
    attrs = frame.schema["features"].metadata["ml_attr"]["attrs"]
    assert [a["name"] for a in attrs["nominal"]] == ["_a_land"] and len(attrs["nominal"][0]["vals"]) == 10
    stump = {"max_iter": 1, "max_depth": 1, "min_instances": 5, "subsampling": 1.0}
    one = M.fit_gbt_classifier(df, ["land", "x"], "y", levels, **stump)
    scored = M.score(one, df, ["land", "x"], levels=levels)
    assert evaluate_binary(scored, "score", "y").first().auc == 1.0 and scored.schema["land"] == df.schema["land"]
    plain = M.fit_gbt_classifier(df, ["land", "x"], "y", **stump)
    assert evaluate_binary(M.score(plain, df, ["land", "x"]), "score", "y").first().auc < 0.9
    new = spark.createDataFrame([(1, 77, 0.0), (2, None, 0.0)], "id long, land int, x double")
    assert M.score(one, new, ["land", "x"], levels=levels).count() == 2  # levels that training did not have
    got = M.grid_search_classifier(df, df, ["land", "x"], "y", {"max_iter": [1, 2]}, {**stump}, levels=levels)
    assert {r.auc for r in got.collect()} == {1.0}


def test_out_of_bag_means_by_hand(spark, rows):
    frame = M.fit_frame(rows, X, "z", None, "id").cache()
    models = M.fit_bagged_forest(frame, "id", "z", 3, num_trees=7, min_instances=20, bags=3)
    assert [m.getNumTrees for m in models] == [3, 2, 2]
    weights = {r.id: [r.w0, r.w1, r.w2] for r in rows.select("id", *[M.bag_weight("id", b).alias(f"w{b}") for b in range(3)]).collect()}
    share = np.mean([w[0] == 0 for w in weights.values()])
    assert 0.3 < share < 0.44 and 0.9 < np.mean([w[0] for w in weights.values()]) < 1.1
    each = {r.id: [r._p0, r._p1, r._p2] for r in models[2].transform(models[1].transform(models[0].transform(frame))).collect()}
    for r in M.out_of_bag(models, frame, "id").collect():
        parts = [(p * t, t) for p, t, w in zip(each[r.id], [3, 2, 2], weights[r.id]) if w == 0]
        want = sum(p for p, _ in parts) / sum(t for _, t in parts) if parts else None
        assert r.score == (None if want is None else pytest.approx(want))
    got = M.grid_search_forest(rows, "id", X, "z", {"min_instances": [20], "num_trees": [4, 7]}, bags=3).collect()
    assert len(got) == 6
    own = M.out_of_bag(models, frame, "id").where("score is not null")
    assert {r.mse for r in got if r.num_trees == 7}.pop() == pytest.approx(regression_error(own, "score", "z").first().mse)
    assert sum(r.rel_inf for r in got if r.num_trees == 7) == pytest.approx(100)
