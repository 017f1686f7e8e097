"""Stage C: model-based importance and the consensus ranking.

Three model families on the labelled cases, each producing rank tables:

* boosting (M8, M14-M18, M21): two-stage grid on train/valid, final fit,
  permutation importance per feature and per basket on test, relative influence;
* logistic regression (M9, M17, M18, M21): Wald p-values, permutation importance;
* nearest neighbours (M6, M7): k selection, removal importance.

Plus the two correlation ranks (M2). ``consensus`` joins the nine feature ranks
(seven basket ranks), averages them and places them (M23, M24). Results are
kept per application and input as Parquet tables in the checkpoint folder,
so the registered queries share one computation and a lost executor never
recomputes a model fit's inputs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import models as M
from ..operators.importance import BASELINE, group_mean_rank, permutation_importance, rank_importance
from ..operators.knn import knn_removal_importance, knn_select_k
from ..operators.ranking import consensus_rank, rank_by
from ..operators.sampling import min_max, split
from ..operators.stats import correlation_baskets, target_correlation
from ..session import cut_lineage, input_state, shared
from . import study

KEY, LABEL, FEATURES = study.KEY, study.LABEL, study.FEATURES
# the study's grids: 500 fits of 100 trees, then 81 fits of 200 to 1,000 trees
GRID_1 = {"max_depth": [*range(1, 11)], "min_instances": [*range(100, 1001, 100)], "subsampling": [0.2, 0.4, 0.6, 0.8, 1.0]}
GRID_2 = {"step_size": [0.09, 0.08, 0.07, 0.06, 0.05, 0.04, 0.03, 0.02, 0.01], "max_iter": [*range(200, 1001, 100)]}
FIXED_1 = {"max_iter": 100, "step_size": 0.1}
KNN_KS = [10, 50, *range(100, 1001, 100)]

def model_sets(spark, sf) -> DataFrame:
    """Labelled cases with a 60/20/20 split column (hash uniform), materialised."""
    return shared(spark, sf, "sets", lambda: cut_lineage(
        split(study.labelled_cases(spark, sf), KEY, [0.6, 0.2, 0.2], salt="model-split"), "model_sets"))


def baskets(spark, sf) -> DataFrame:
    """M3 on the training rows: ``(var, basket_id)`` (p rows, built on the driver)."""
    return shared(spark, sf, "baskets", lambda: correlation_baskets(
        model_sets(spark, sf).where("split = 0"), FEATURES, k=4).cache())


def _groups(spark, sf) -> dict:
    b = {r.var: r.basket_id for r in baskets(spark, sf).collect()}
    g = {f: [f] for f in FEATURES}
    for i in sorted(set(b.values())):
        g[f"basket_{i}"] = [f for f in FEATURES if b[f] == i]
    return g


def _split_perm(perm: DataFrame):
    feat = perm.where(~F.col("scenario").startswith("basket_") & (F.col("scenario") != BASELINE))
    bask = perm.where(F.col("scenario").startswith("basket_")).withColumn(
        "basket_id", F.regexp_replace("scenario", "^basket_", "").cast("int"))
    return feat, bask


# --- boosting ---------------------------------------------------------------------


def factor_levels(spark, sf) -> dict:
    """The levels of the factor columns in the training rows."""
    return shared(spark, sf, "levels", lambda: M.nominal_levels(model_sets(spark, sf).where("split = 0"), study.FACTORS))


def label_grid(spark, sf, grid: dict, fixed: dict) -> DataFrame:
    """M14 + M15: one stage of the label's boosting grid on train/valid, kept by the input's
    state: a later run or query reads the points that are there and fits the rest."""
    def build():
        s = model_sets(spark, sf)
        return M.grid_search_classifier(s.where("split = 0"), s.where("split = 1"), FEATURES, LABEL, grid, fixed,
                                        state=["label", *input_state(spark, sf)], levels=factor_levels(spark, sf))
    return shared(spark, sf, f"label-grid-{grid}-{fixed}", build)


def boosting_grid_1(spark, sf, grid_1: dict = GRID_1, fixed_1: dict = FIXED_1) -> DataFrame:
    return label_grid(spark, sf, grid_1, fixed_1)


def stage_1_winner(spark, sf, grid_1: dict = GRID_1, fixed_1: dict = FIXED_1) -> dict:
    p = M.best_params(boosting_grid_1(spark, sf, grid_1, fixed_1), list(grid_1))
    return {"max_depth": int(p["max_depth"]), "min_instances": int(p["min_instances"]), "subsampling": float(p["subsampling"])}


def boosting_grid_2(spark, sf, grid_1: dict = GRID_1, grid_2: dict = GRID_2, fixed_1: dict = FIXED_1) -> DataFrame:
    return label_grid(spark, sf, grid_2, stage_1_winner(spark, sf, grid_1, fixed_1))


def boosted_model(spark, sf, grid_1: dict = GRID_1, grid_2: dict = GRID_2, fixed_1: dict = FIXED_1):
    """M8: the final fit with the winners of both stages."""
    def build():
        p2 = M.best_params(boosting_grid_2(spark, sf, grid_1, grid_2, fixed_1), list(grid_2))
        params = {**stage_1_winner(spark, sf, grid_1, fixed_1), "step_size": float(p2["step_size"]), "max_iter": int(p2["max_iter"])}
        return M.fit_gbt_classifier(model_sets(spark, sf).where("split = 0"), FEATURES, LABEL, factor_levels(spark, sf), **params)
    return shared(spark, sf, f"boosted-{grid_1}-{grid_2}-{fixed_1}", build)


def relative_influence(spark, sf, **grids) -> DataFrame:
    """Relative influence of every feature in the final fit, ranked."""
    return M.importance_table(spark, boosted_model(spark, sf, **grids), FEATURES)


def boosting_permutations(spark, sf, **grids) -> DataFrame:
    """M17 + M18: the final fit's statistics with each feature and basket shuffled."""
    def build():
        model, test, levels = boosted_model(spark, sf, **grids), model_sets(spark, sf).where("split = 2"), factor_levels(spark, sf)
        return cut_lineage(permutation_importance(lambda d: M.score(model, d, FEATURES, levels=levels), test, KEY, FEATURES, LABEL, _groups(spark, sf)), "boost_perm")
    return shared(spark, sf, f"boost-perm-{grids}", build)


def boosting_feature_ranks(spark, sf) -> DataFrame:
    feat, _ = _split_perm(boosting_permutations(spark, sf))
    r = rank_importance(feat).select(F.col("scenario").alias("var"), F.col("rank_ce").alias("boost_ce"),
                                     F.col("rank_auc").alias("boost_auc"))
    return r.join(relative_influence(spark, sf).select("var", F.col("rank").alias("boost_relinf")), "var")


def boosting_basket_ranks(spark, sf) -> DataFrame:
    _, bask = _split_perm(boosting_permutations(spark, sf))
    r = rank_importance(bask).select("basket_id", F.col("rank_ce").alias("boost_ce"), F.col("rank_auc").alias("boost_auc"))
    ri = group_mean_rank(relative_influence(spark, sf), baskets(spark, sf), "rel_inf", "boost_avg_relinf", ascending=False)
    return r.join(ri.select("basket_id", "boost_avg_relinf"), "basket_id")


# --- logistic regression ------------------------------------------------------------


def logit_fit(spark, sf) -> dict:
    """M9: the fit and its p-values, without the permutations of ``logit``."""
    def build():
        fitted = M.fit_logit(model_sets(spark, sf).where("split = 0"), FEATURES, LABEL)
        return {"fitted": fitted, "pvalues": M.logit_pvalues(spark, fitted, FEATURES).cache()}
    return shared(spark, sf, "logit-fit", build)


def logit(spark, sf) -> dict:
    def build():
        own = logit_fit(spark, sf)
        test = model_sets(spark, sf).where("split <> 0")  # 60/40 as in the study
        perm = cut_lineage(permutation_importance(lambda d: M.score_logit(own["fitted"], d), test, KEY, FEATURES, LABEL,
                                                  _groups(spark, sf), salt="logit-perm"), "logit_perm")
        return {**own, "perm": perm}
    return shared(spark, sf, "logit", build)


def logit_feature_ranks(spark, sf) -> DataFrame:
    lg = logit(spark, sf)
    feat, _ = _split_perm(lg["perm"])
    r = rank_importance(feat).select(F.col("scenario").alias("var"), F.col("rank_ce").alias("logit_ce"),
                                     F.col("rank_auc").alias("logit_auc"))
    pv = rank_by(lg["pvalues"], "pval", ascending=True, tiebreak=["var"], out="logit_pvals")
    return r.join(pv.select("var", "logit_pvals"), "var")


def logit_basket_ranks(spark, sf) -> DataFrame:
    lg = logit(spark, sf)
    _, bask = _split_perm(lg["perm"])
    r = rank_importance(bask).select("basket_id", F.col("rank_ce").alias("logit_ce"), F.col("rank_auc").alias("logit_auc"))
    pv = group_mean_rank(lg["pvalues"], baskets(spark, sf), "pval", "logit_pvals", ascending=True)
    return r.join(pv.select("basket_id", "logit_pvals"), "basket_id")


# --- J5: the joined statistic tables ---------------------------------------------------

RATIOS = ["class_error_ratio", "auc_ratio", "sensitivity_ratio", "specificity_ratio", "ce_greater"]


def boosting_feature_stats(spark, sf) -> DataFrame:
    """Permutation ratios of every feature joined to its relative influence."""
    perm = rank_importance(_split_perm(boosting_permutations(spark, sf))[0]).select(F.col("scenario").alias("var"), *RATIOS, "rank_ce", "rank_auc")
    return relative_influence(spark, sf).select("var", "rel_inf", F.col("rank").alias("rank_summary")).join(perm, "var", "left")


def boosting_basket_stats(spark, sf) -> DataFrame:
    """Permutation ratios of every basket joined to its mean relative influence."""
    perm = rank_importance(_split_perm(boosting_permutations(spark, sf))[1]).select("basket_id", *RATIOS, "rank_ce", "rank_auc")
    return group_mean_rank(relative_influence(spark, sf), baskets(spark, sf), "rel_inf", "rank_summary", ascending=False).join(perm, "basket_id", "left")


def logit_feature_stats(spark, sf) -> DataFrame:
    """Permutation ratios of every feature joined to its p-value."""
    lg = logit(spark, sf)
    perm = rank_importance(_split_perm(lg["perm"])[0]).select(F.col("scenario").alias("var"), *RATIOS, "rank_ce", "rank_auc")
    pv = rank_by(lg["pvalues"], "pval", ascending=True, tiebreak=["var"], out="rank_pvals")
    return perm.join(pv.select("var", "pval", "rank_pvals"), "var", "left")


def logit_basket_stats(spark, sf) -> DataFrame:
    """Permutation ratios of every basket joined to its mean p-value."""
    lg = logit(spark, sf)
    perm = rank_importance(_split_perm(lg["perm"])[1]).select("basket_id", *RATIOS, "rank_ce", "rank_auc")
    return perm.join(group_mean_rank(lg["pvalues"], baskets(spark, sf), "pval", "rank_pvals", ascending=True), "basket_id", "left")


# --- nearest neighbours ---------------------------------------------------------------


def _knn_sets(spark, sf) -> list[DataFrame]:
    """Train, valid and test rows, scaled by the bounds of the train rows."""
    s = model_sets(spark, sf)
    n = min_max(s, FEATURES, replace=True, fit_on=s.where("split = 0"))
    return [n.where(f"split = {part}") for part in (0, 1, 2)]


def knn_errors(spark, sf) -> DataFrame:
    """M6: the class error of every k, without the removals of ``knn``."""
    def build():
        train, valid, _ = _knn_sets(spark, sf)
        return cut_lineage(knn_select_k(train, valid, KEY, FEATURES, LABEL, KNN_KS), "knn_errors")
    return shared(spark, sf, "knn-errors", build)


def knn(spark, sf) -> dict:
    def build():
        train, _, test = _knn_sets(spark, sf)
        ks = knn_errors(spark, sf)
        best_k = int(ks.orderBy("class_error", "k").first().k)
        imp = cut_lineage(knn_removal_importance(train, test, KEY, FEATURES, LABEL, best_k, _groups(spark, sf)), "knn_imp")
        return {"ks": ks, "k": best_k, "removal": imp}
    return shared(spark, sf, "knn", build)


def knn_feature_ranks(spark, sf) -> DataFrame:
    imp = knn(spark, sf)["removal"].where(~F.col("name").startswith("basket_") & (F.col("name") != "All"))
    return rank_by(imp, "prop_of_err", ascending=False, tiebreak=["name"], out="knn_ce").select(
        F.col("name").alias("var"), "knn_ce")


def knn_basket_ranks(spark, sf) -> DataFrame:
    imp = knn(spark, sf)["removal"].where(F.col("name").startswith("basket_")).withColumn(
        "basket_id", F.regexp_replace("name", "^basket_", "").cast("int"))
    return rank_by(imp, "prop_of_err", ascending=False, tiebreak=["basket_id"], out="knn_ce").select("basket_id", "knn_ce")


# --- correlation ranks and consensus ------------------------------------------------------


def correlation_ranks(spark, sf) -> DataFrame:
    tc = target_correlation(model_sets(spark, sf), LABEL, FEATURES, key=KEY)
    tc = rank_by(tc, "abs_cor_lin", ascending=False, tiebreak=["var"], out="rank_lin")
    tc = rank_by(tc, "abs_cor_spear", ascending=False, tiebreak=["var"], out="rank_spear")
    return tc.select("var", "rank_lin", "rank_spear")


FEATURE_RANKS = ["rank_lin", "rank_spear", "knn_ce", "boost_ce", "boost_relinf", "boost_auc", "logit_ce", "logit_auc",
                 "logit_pvals"]
BASKET_RANKS = ["knn_ce", "boost_ce", "boost_avg_relinf", "boost_auc", "logit_ce", "logit_auc", "logit_pvals"]


def consensus_features(spark, sf) -> DataFrame:
    """Nine ranks per feature, their mean and the final place, with the basket."""
    t = consensus_rank([correlation_ranks(spark, sf), knn_feature_ranks(spark, sf), boosting_feature_ranks(spark, sf),
                        logit_feature_ranks(spark, sf)], "var", FEATURE_RANKS)
    return t.join(F.broadcast(baskets(spark, sf)), "var", "left").select("var", *FEATURE_RANKS, "avg_place", "place",
                                                                          "basket_id")


def consensus_baskets(spark, sf) -> DataFrame:
    """Seven ranks per basket, their mean and the final place."""
    t = consensus_rank([knn_basket_ranks(spark, sf), boosting_basket_ranks(spark, sf), logit_basket_ranks(spark, sf)],
                       "basket_id", BASKET_RANKS)
    return t.select("basket_id", *BASKET_RANKS, "avg_place", "place")
