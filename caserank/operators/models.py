"""Model operators on MLlib (M8, M8b-d, M9, M14-M16, I11, I12).

Fits are distributed MLlib jobs; the driver submits grid points from a bounded thread pool
(``grid``) and holds model parameters and tree nodes. Scoring is ``model.transform`` (map-side,
no shuffle); metrics come from ``operators.metrics`` (distributed).

Parameter names follow the study: depth -> ``maxDepth``, min node size ->
``minInstancesPerNode``, bag fraction -> ``subsamplingRate``, shrinkage ->
``stepSize``, number of trees -> ``maxIter``/``numTrees``.
"""

from __future__ import annotations

import itertools
import math
import uuid
from collections.abc import Sequence
from contextlib import contextmanager

import numpy as np
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import GBTRegressor, GeneralizedLinearRegression, RandomForestRegressor
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.core import u
from .columns import complete_cases
from .grid import WORKERS, GridStore, run_grid
from .metrics import evaluate_binary, regression_error
from .ranking import top_k
from .stats import corr_matrix
from .trees import ensemble, staged_scores

SEED = 42
MAX_BINS = 64
#: Rows a partition of a fit holds at least.
FIT_ROWS = 100_000
FOREST_DEPTH = 30
#: Levels up to which a factor is split by sets of levels.
MAX_LEVELS = 256


def nominal_levels(train: DataFrame, columns: Sequence[str]) -> dict[str, list]:
    """The levels of factor columns, as the training rows have them, in value order. A
    column of more than ``MAX_LEVELS`` stays an ordered number and is left out."""
    out = {}
    for c in columns:
        found = [r[0] for r in train.select(c).where(F.col(c).isNotNull()).distinct().limit(MAX_LEVELS + 1).collect()]
        if found and len(found) <= MAX_LEVELS:
            out[c] = sorted(found)
    return out


def feature(name: str, levels: dict[str, list] | None = None) -> Column:
    """A feature as a double; a factor as the number of its level, one more for a level or
    NULL that training did not have."""
    own = (levels or {}).get(name)
    if own is None:
        return F.col(name).cast("double")
    text = isinstance(own[0], str)
    place = F.array_position(F.array(*[F.lit(v if text else float(v)) for v in own]), F.col(name).cast("string" if text else "double"))
    return F.when(place > 0, place - 1).otherwise(F.lit(len(own))).cast("double")


def assemble(df: DataFrame, features: Sequence[str], out: str = "features", levels: dict[str, list] | None = None) -> DataFrame:
    """Add the feature vector; the feature columns keep their own types. Factors (``levels``)
    carry their nominal attribute into the vector's schema."""
    columns = []
    for f in features:
        own = (levels or {}).get(f)
        nominal = own and {"ml_attr": {"type": "nominal", "name": f, "vals": [*map(str, own), "other level"]}}
        columns.append(feature(f, levels).alias(f"_a_{f}", metadata=nominal) if own else feature(f).alias(f"_a_{f}"))
    names = [f"_a_{f}" for f in features]
    return VectorAssembler(inputCols=names, outputCol=out, handleInvalid="keep").transform(df.select("*", *columns)).drop(*names)


def fit_frame(train: DataFrame, features: Sequence[str], label: str, levels: dict[str, list] | None = None, *keep: str) -> DataFrame:
    """What a fit reads: the feature vector and the label as a double."""
    return assemble(train, features, levels=levels).select(*keep, "features", F.col(label).cast("double").alias(label))


def max_bins(levels: dict[str, list] | None) -> int:
    return max([MAX_BINS, *[len(v) + 1 for v in (levels or {}).values()]])


def _boosted(cls, label, max_iter=50, max_depth=3, step_size=0.1, min_instances=20, subsampling=0.8, bins=MAX_BINS):
    return cls(featuresCol="features", labelCol=label, maxIter=int(max_iter), maxDepth=int(max_depth), stepSize=float(step_size),
               minInstancesPerNode=int(min_instances), subsamplingRate=float(subsampling), maxBins=bins, seed=SEED)


def _forest(label, num_trees=50, min_instances=100, mtry: int = 1, bins=MAX_BINS):
    """Trees grow until a node is too small: MLlib's deepest allowed depth, not its default."""
    return RandomForestRegressor(featuresCol="features", labelCol=label, numTrees=int(num_trees), minInstancesPerNode=int(min_instances),
                                 maxDepth=FOREST_DEPTH, featureSubsetStrategy=str(mtry), maxBins=bins, seed=SEED)


def estimator(kind: str, label: str, n_features: int, **params):
    """The MLlib estimator of a kind of model (``classifier``, ``gbt``, ``rf``); a
    forest tries a third of the features at a split by default."""
    if kind == "rf":
        return _forest(label, **{"mtry": max(1, n_features // 3), **params})
    return _boosted(GBTClassifier if kind == "classifier" else GBTRegressor, label, **params)


def fit_gbt_classifier(train: DataFrame, features, label, levels: dict | None = None, **params):
    """M8: boosted trees for a 0/1 label (bernoulli deviance = logistic loss)."""
    return estimator("classifier", label, len(features), bins=max_bins(levels), **params).fit(fit_frame(train, features, label, levels))


def fit_gbt_regressor(train, features, target, levels: dict | None = None, **params):
    """Boosted trees, squared loss (gaussian)."""
    return estimator("gbt", target, len(features), bins=max_bins(levels), **params).fit(fit_frame(train, features, target, levels))


def fit_rf_regressor(train, features, target, levels: dict | None = None, **params):
    """Random forest regression; ``mtry`` features per split (default p/3)."""
    return estimator("rf", target, len(features), bins=max_bins(levels), **params).fit(fit_frame(train, features, target, levels))


def score(model, df: DataFrame, features, out: str = "score", levels: dict | None = None) -> DataFrame:
    """M8d: ``predict(type="response")``: positive-class probability for a
    classifier, the fitted value for a regressor. Keeps the input columns."""
    t = model.transform(assemble(df, features, levels=levels))
    if "probability" in t.columns:
        t = t.withColumn(out, vector_to_array("probability")[1])
    else:
        t = t.withColumn(out, F.col("prediction"))
    return t.drop("features", "rawPrediction", "probability", "prediction")


def importance(model, features, out: str = "rel_inf") -> list[tuple[str, float]]:
    """Relative influence in percent (sums to 100), largest first."""
    imp = model.featureImportances.toArray()
    total = imp.sum() or 1.0
    pairs = [(f, float(100.0 * v / total)) for f, v in zip(features, imp)]
    return sorted(pairs, key=lambda t: (-t[1], features.index(t[0])))


def importance_table(spark, model, features, out: str = "rel_inf") -> DataFrame:
    rows = [(f, v, i + 1) for i, (f, v) in enumerate(importance(model, features))]
    return spark.createDataFrame(rows, f"var string, {out} double, rank int")


@contextmanager
def _held(df: DataFrame):
    """The rows in memory (or on disk), in as few partitions as their number asks for: the
    fits of a grid read them many times, and a job over few rows is mostly its tasks."""
    parts = df.rdd.getNumPartitions()
    kept = df.coalesce(max(1, min(parts, -(-df.count() // FIT_ROWS)))).persist()
    try:
        yield kept
    finally:
        kept.unpersist()


def _stages(grid: dict[str, Sequence], kind: str) -> tuple[list[dict], list[int]]:
    """The points to fit and the numbers of rounds to read off each: a boosted model's
    first trees are the model with fewer rounds, so only the most rounds are fitted."""
    staged = sorted({int(v) for v in grid.get("max_iter", [])}) if kind != "rf" else []
    names = [n for n in grid if not (staged and n == "max_iter")]
    return [dict(zip(names, v)) for v in itertools.product(*[grid[n] for n in names])], staged


def _grid(kind: str, train: DataFrame, hold: DataFrame, features, label, grid: dict[str, Sequence], fixed: dict | None, measure, metrics: Sequence[str],
          state: Sequence, workers: int, levels: dict | None) -> DataFrame:
    """Fit every point of ``grid`` and measure it: ``measure(scored)`` gives one row of
    ``metrics`` per stage. Long table, one row per (grid point, feature): params...,
    metrics..., var, rel_inf."""
    features, fixed, names = list(features), dict(fixed or {}), list(grid)
    spark = train.sparkSession
    points, staged = _stages(grid, kind)
    schema = ", ".join([f"{n} double" for n in names] + [f"{m} double" for m in metrics] + ["var string", "rel_inf double"])
    store = GridStore(spark, f"{kind}-{label}", [kind, label, features, fixed, staged, levels, SEED, MAX_BINS, *state], schema)
    if not store.missing(points):
        return run_grid(store, points, lambda point: [], workers)
    vectors = fit_frame(train, features, label, levels)
    values = hold.select(*[feature(f, levels).alias(f) for f in features], F.col(label).alias("_y"))
    with _held(vectors) as vectors, _held(values) as values:
        def fit(point: dict) -> list[tuple]:
            params = {**fixed, **point, **({"max_iter": staged[-1]} if staged else {})}
            model = estimator(kind, label, len(features), bins=max_bins(levels), **params).fit(vectors)
            e = ensemble(spark, model, len(features))
            stages = staged or [len(e.root)]
            scored = staged_scores(e, values, features, stages, {"gbt": "boosted", "rf": "forest"}.get(kind, kind), ["_y"])
            found = {r["stage"]: r for r in measure(scored).collect()}  # one row a stage
            out = []
            for stage in stages:
                own = {**params, "max_iter": stage} if staged else params
                rel = e.influence(stage)
                out += [(*[float(own[n]) for n in names], *[found[stage][m] for m in metrics], features[j], float(rel[j]))
                        for j in sorted(range(len(features)), key=lambda j: (-rel[j], j))]
            return out

        return run_grid(store, points, fit, workers)


def grid_search_classifier(train, valid, features, label, grid: dict[str, Sequence], fixed: dict | None = None, state: Sequence = (),
                           workers: int = WORKERS, levels: dict | None = None) -> DataFrame:
    """M14 (one stage): fit every grid point on ``train``, evaluate on ``valid`` (class
    error at the closest-top-left threshold). All numbers of rounds (``max_iter``) of a
    point come from one fit. Finished points are kept by ``state``, which has to name the
    inputs, and are not fitted again; without a state every call has a table of its own."""
    measure = lambda scored: evaluate_binary(scored, "score", "_y", by="stage")
    return _grid("classifier", train, valid, features, label, grid, fixed, measure, ["class_error", "threshold", "auc"], state or [uuid.uuid4().hex], workers,
                 levels)


def grid_search_regressor(train, hold, features, target, kind: str, grid: dict[str, Sequence], fixed: dict | None = None, post=None,
                          state: Sequence = (), workers: int = WORKERS, levels: dict | None = None) -> DataFrame:
    """M14 for regressors (``kind``: rf or gbt): fit every grid point on ``train``, measure
    it on ``hold``, after ``post`` (rounding, say). Long table, one row per (grid point,
    feature): params..., mse, mean_abs_prop, var, rel_inf. Kept by ``state`` as above."""
    def measure(scored):
        return regression_error(scored.withColumn("score", post(F.col("score"))) if post else scored, "score", "_y", by="stage")

    return _grid(kind, train, hold, features, target, grid, fixed, measure, ["mse", "mean_abs_prop"], state or [uuid.uuid4().hex], workers, levels)


def bag_weight(key: str, bag: int) -> Column:
    """How often a row is drawn into a bag, by hash of (row, bag): a Poisson(1) count, the limit
    of drawing as many rows as there are with replacement. 0 in 36.8 percent of the rows."""
    draw, below, term = u(key, f"bag:{bag}"), 0.0, math.exp(-1.0)
    bounds = []
    for n in range(1, 12):
        below += term
        bounds.append(below)
        term /= n
    return sum((draw >= F.lit(b)).cast("int") for b in bounds).cast("double")


def fit_bagged_forest(rows: DataFrame, key: str, label: str, n_features: int, num_trees: int, min_instances: int, mtry: int | None = None,
                      bags: int = 20, bins: int = MAX_BINS) -> list:
    """M8c with known bags: the trees are dealt to ``bags`` forests, each fitted on the rows of
    its own bag (``bag_weight``), so which trees have not seen a row can be told."""
    bags = min(int(bags), int(num_trees))
    out = []
    for b in range(bags):
        share = int(num_trees) // bags + (b < int(num_trees) % bags)
        est = estimator("rf", label, n_features, num_trees=share, min_instances=min_instances, bins=bins, **({"mtry": mtry} if mtry else {}))
        est = est.setBootstrap(False).setWeightCol("_w").setSeed(SEED + b).setPredictionCol(f"_p{b}")
        out.append(est.fit(rows.withColumn("_w", bag_weight(key, b)).where("_w > 0")))
    return out


def out_of_bag(models: list, rows: DataFrame, key: str, out: str = "score") -> DataFrame:
    """Every row's mean over the trees whose bag has not seen it (NULL if all have)."""
    total, trees = F.lit(0.0), F.lit(0)
    for b, m in enumerate(models):
        unseen = bag_weight(key, b) == 0
        rows = m.transform(rows)
        total = total + F.when(unseen, F.col(f"_p{b}") * m.getNumTrees).otherwise(0.0)
        trees = trees + F.when(unseen, m.getNumTrees).otherwise(0)
    return rows.withColumn(out, F.try_divide(total, trees)).drop(*[f"_p{b}" for b in range(len(models))])


def grid_search_forest(train: DataFrame, key: str, features, target: str, grid: dict[str, Sequence], bags: int = 20, state: Sequence = (),
                       workers: int = WORKERS, levels: dict | None = None) -> DataFrame:
    """M14 for forests as the study measures them: on the out-of-bag predictions of the rows
    that were fitted. Long table, one row per (grid point, feature): params..., mse,
    mean_abs_prop, var, rel_inf (the share of IncNodePurity), inc_node_purity."""
    features, names = list(features), list(grid)
    spark = train.sparkSession
    points = [dict(zip(names, v)) for v in itertools.product(*[grid[n] for n in names])]
    schema = ", ".join([f"{n} double" for n in names] + ["mse double", "mean_abs_prop double", "var string", "rel_inf double", "inc_node_purity double"])
    store = GridStore(spark, f"oob-{target}", [target, features, bags, levels, SEED, MAX_BINS, *(state or [uuid.uuid4().hex])], schema)
    with _held(fit_frame(train, features, target, levels, key)) as rows:
        def fit(point: dict) -> list[tuple]:
            models = fit_bagged_forest(rows, key, target, len(features), bags=bags, bins=max_bins(levels), **point)
            e = regression_error(out_of_bag(models, rows, key).where("score is not null"), "score", target).first()
            purity = sum(ensemble(spark, m, len(features)).decrease.sum(0) for m in models) / sum(m.getNumTrees for m in models)
            share = 100.0 * purity / (purity.sum() or 1.0)
            return [(*map(float, point.values()), e.mse, e.mean_abs_prop, features[j], float(share[j]), float(purity[j]))
                    for j in sorted(range(len(features)), key=lambda j: (-share[j], j))]

        return run_grid(store, points, fit, workers)


def top_features(grid_result: DataFrame, params: Sequence[str], k: int = 6) -> list[str]:
    """W5 + A3: the features most often among the ``k`` most important of a fit, ``k`` of
    them (ties by mean importance, then name)."""
    top = top_k(grid_result, "rel_inf", k, by=list(params), tiebreak=["var"])
    share = top.groupBy("var").agg(F.count(F.lit(1)).alias("n"), F.avg("rel_inf").alias("m"))
    return [r["var"] for r in share.orderBy(F.desc("n"), F.desc("m"), "var").limit(k).collect()]


def best_params(grid_result: DataFrame, params: Sequence[str], metric: str = "class_error") -> dict:
    """A7 + W4: min metric per parameter tuple, then the best tuple (ties: first by params)."""
    g = grid_result.groupBy(*params).agg(F.min(metric).alias("_m"))
    r = g.orderBy("_m", *params).first()
    return {p: r[p] for p in params}


def select_features(grid_result: DataFrame, min_mean: float = 2.0) -> DataFrame:
    """M16 (A8): mean relative influence per feature over the grid and the ``> min_mean`` flag."""
    return grid_result.groupBy("var").agg(F.avg("rel_inf").alias("mean_rel_inf")).withColumn(
        "selected", (F.col("mean_rel_inf") > min_mean).cast("int"))


REGRESSORS = {"rf": fit_rf_regressor, "gbt": fit_gbt_regressor}


# --- M9: logistic regression with Wald p-values ------------------------------------


def aliased_columns(df: DataFrame, features: Sequence[str], tol: float = 1e-7) -> list[str]:
    """Columns that are (numerically) linear combinations of earlier columns or
    constant, found by sequential elimination on the p x p correlation matrix
    (one distributed aggregate; only p^2 numbers reach the driver)."""
    features = list(features)
    cm = {(r.var_a, r.var_b): r.corr for r in corr_matrix(df, features).collect()}
    kept, aliased = [], []
    for f in features:
        if cm[(f, f)] is None:
            aliased.append(f)
            continue
        if kept:
            C = np.array([[cm[(a, b)] for b in kept] for a in kept], dtype=float)
            c = np.array([cm[(a, f)] for a in kept], dtype=float)
            resid = 1.0 - c @ np.linalg.solve(C, c)
            if resid < tol:
                aliased.append(f)
                continue
        kept.append(f)
    return aliased


def fit_logit(train: DataFrame, features, label):
    """M9: binomial GLM (logit link) by IRLS. Aliased columns are dropped first (R
    reports them as NA); the rest are standardised with train moments (p-values of
    slopes are scale invariant) so the normal equations stay well conditioned.
    Returns (model, kept features, aliased features, standardisation struct)."""
    features = list(features)
    aliased = aliased_columns(train, features)
    kept = [f for f in features if f not in aliased]
    mom = train.select(F.struct(*[F.avg(f).alias(f"{f}_m") for f in kept],
                                *[F.stddev_samp(f).alias(f"{f}_s") for f in kept])).first()[0]
    z = train.withColumns({f: (F.col(f) - F.lit(mom[f"{f}_m"])) / F.lit(mom[f"{f}_s"]) for f in kept})
    glm = GeneralizedLinearRegression(family="binomial", link="logit", featuresCol="features", labelCol=label,
                                      maxIter=50, regParam=0.0)
    model = glm.fit(assemble(z, kept).withColumn(label, F.col(label).cast("double")))
    return model, kept, aliased, mom


def score_logit(fitted, df: DataFrame, out: str = "score") -> DataFrame:
    """M8d for the logit: P(label = 1)."""
    model, kept, _, mom = fitted
    z = df.withColumns({f"_z_{f}": (F.col(f) - F.lit(mom[f"{f}_m"])) / F.lit(mom[f"{f}_s"]) for f in kept})
    t = model.transform(VectorAssembler(inputCols=[f"_z_{f}" for f in kept], outputCol="features",
                                        handleInvalid="keep").transform(z))
    return t.withColumn(out, F.col("prediction")).drop("features", "prediction", *[f"_z_{f}" for f in kept])


def logit_pvalues(spark, fitted, features) -> DataFrame:
    """Wald p-values per feature (intercept excluded), aliased features NULL:
    ``(var, coef, pval)`` in feature order."""
    model, kept, aliased, mom = fitted
    s = model.summary
    pv = list(s.pValues)[: len(kept)]  # intercept is last
    coef = list(model.coefficients)
    by = {f: (float(c) / mom[f"{f}_s"], float(p)) for f, c, p in zip(kept, coef, pv)}
    rows = [(f, *(by[f] if f in by else (None, None))) for f in features]
    return spark.createDataFrame(rows, "var string, coef double, pval double")


# --- I11/I12: model fills ------------------------------------------------------------


def hold_out(df: DataFrame, key: str, target: str, features: Sequence[str], fraction: float = 0.6) -> tuple[DataFrame, DataFrame]:
    """X1 on the complete rows: the rows to fit on and the rows to measure on."""
    complete = complete_cases(df, [target, *features])
    part = u(key, f"fill:{target}") < fraction
    return complete.where(part), complete.where(~part)


def fill_model(df: DataFrame, target: str, features, model_kind: str, where=None, key: str = "case_id",
               post=None, train_fraction: float = 0.6, levels: dict | None = None, **params):
    """Fit a regressor on a ``train_fraction`` of the complete rows, and predict
    ``target`` where it is NULL (and ``where`` holds) in place: rows are scored where they
    are, without a join. Returns (filled df, hold-out errors (mse, mean_abs_prop))."""
    train, test = hold_out(df, key, target, features, train_fraction)
    m = REGRESSORS[model_kind](train, features, target, levels, **params)
    fitted = score(m, test, features, out="_pred", levels=levels)
    err = regression_error(fitted.withColumn("_pred", post(F.col("_pred"))) if post else fitted, "_pred", target)
    need = F.col(target).isNull()
    if where is not None:
        need = need & where
    for f in features:
        need = need & F.col(f).isNotNull()
    pred = F.col("_pred") if post is None else post(F.col("_pred"))
    out = score(m, df, features, out="_pred", levels=levels).withColumn(
        target, F.when(need, pred.cast(df.schema[target].dataType)).otherwise(F.col(target)))
    return out.select(*df.columns), err
