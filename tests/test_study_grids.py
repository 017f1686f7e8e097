"""The model queries run the study's grids, point by point."""
import math

import pytest

from caserank.operators import models as M
from caserank.plans import ranking_study as RS
from caserank.plans import study
from conftest import SF001


def points(grid):
    return math.prod(len(set(v)) for v in grid.values())


class Stop(Exception):
    pass


def test_boosting_runs_both_stages_in_full(spark, monkeypatch):
    seen = []

    def grid_search(train, valid, features, label, grid, fixed, state, levels):
        seen.append((grid, fixed))
        if len(seen) == 2:
            raise Stop
        return spark.createDataFrame([(3.0, 200.0, 0.4, 0.1)], "max_depth double, min_instances double, subsampling double, class_error double")

    monkeypatch.setattr(M, "grid_search_classifier", grid_search)
    monkeypatch.setattr(RS, "model_sets", lambda spark, sf: spark.range(3).withColumnRenamed("id", "split"))
    monkeypatch.setattr(RS, "factor_levels", lambda spark, sf: {})
    with pytest.raises(Stop):
        RS.boosting_grid_2(spark, SF001)
    (one, fixed), (two, won) = seen
    assert points(one) == 500 and fixed == {"max_iter": 100, "step_size": 0.1}
    assert points(two) == 81 and min(two["max_iter"]) == 200 and max(two["max_iter"]) == 1000
    assert won == {"max_depth": 3, "min_instances": 200, "subsampling": 0.4}


def test_fills_run_their_grids_in_full(spark, monkeypatch):
    seen, fits = [], []
    fill = M.fill_model

    def forest(train, key, features, target, grid, state, levels):
        return grid_search(train, None, features, target, "rf", grid)

    def grid_search(train, hold, features, target, kind, grid, fixed=None, post=None, state=(), levels=None):
        seen.append((kind, points(grid), grid, fixed))
        best = {n: 2.0 if n in ("num_trees", "max_iter") else float(v[0]) for n, v in grid.items()}
        rows = [(*best.values(), 1.0, 1.0, v, 50.0) for v in ("principal", "interest")]
        return spark.createDataFrame(rows, ", ".join(f"{n} double" for n in best) + ", mse double, mean_abs_prop double, var string, rel_inf double")

    def fill_model(*a, **k):
        fits.append(k)
        return fill(*a, **k)

    monkeypatch.setattr(M, "grid_search_regressor", grid_search)
    monkeypatch.setattr(M, "grid_search_forest", forest)
    monkeypatch.setattr(M, "fill_model", fill_model)
    study.model_imputed_cases(spark, SF001)
    assert [(kind, n) for kind, n, *_ in seen] == [("rf", 25), ("gbt", 1000), ("gbt", 50)]
    assert seen[0][2]["num_trees"] == [600, 700, 800, 900, 1000] and seen[2][2]["max_iter"] == [200, 300, 400, 500, 600]
    assert seen[1][3] == {"max_iter": 100, "step_size": 0.1} and seen[2][3] == {"max_depth": 1, "min_instances": 100, "subsampling": 0.2}
    assert fits[0]["num_trees"] == 2 and fits[1]["max_iter"] == 2 and fits[1]["step_size"] == 0.1 and fits[1]["max_depth"] == 1
