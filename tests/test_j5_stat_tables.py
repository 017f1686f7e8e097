"""The study's joined statistic tables of the boosted and the logistic model."""
import __spark_entry__ as E
from caserank.plans import ranking_study as RS
from conftest import SF001


def test_joined_tables_by_feature_and_basket(spark, monkeypatch):
    perm = spark.createDataFrame([(s, *[float(r)] * 4, int(r > 1)) for s, r in (("All", 1), ("a", 3), ("b", 2), ("c", 0.5), ("basket_1", 4), ("basket_2", 0.25))],
                                 "scenario string, class_error_ratio double, auc_ratio double, sensitivity_ratio double, specificity_ratio double, ce_greater int")
    relinf = spark.createDataFrame([("a", 20.0, 2), ("b", 70.0, 1), ("c", 10.0, 3)], "var string, rel_inf double, rank int")
    pvalues = spark.createDataFrame([("a", 0.5), ("b", 0.1), ("c", 0.2)], "var string, pval double")
    monkeypatch.setattr(RS, "boosting_permutations", lambda *_: perm)
    monkeypatch.setattr(RS, "relative_influence", lambda *_: relinf)
    monkeypatch.setattr(RS, "logit", lambda *_: {"perm": perm, "pvalues": pvalues})
    monkeypatch.setattr(RS, "baskets", lambda *_: spark.createDataFrame([("a", 1), ("b", 1), ("c", 2)], "var string, basket_id int"))
    q = E.queries()
    got = lambda name, *c: sorted(tuple(r[x] for x in c) for r in q[name](spark, SF001).collect())
    assert got("j5_boosting_stats_by_feature", "var", "class_error_ratio", "rank_ce", "rel_inf", "rank_summary") == [("a", 3, 1, 20, 2), ("b", 2, 2, 70, 1), ("c", 0.5, 3, 10, 3)]
    assert got("j5_boosting_stats_by_basket", "basket_id", "class_error_ratio", "ce_greater", "mean_rel_inf", "rank_summary") == [(1, 4, 1, 45, 1), (2, 0.25, 0, 10, 2)]
    assert got("j5_logit_stats_by_feature", "var", "auc_ratio", "rank_auc", "pval", "rank_pvals") == [("a", 3, 3, 0.5, 3), ("b", 2, 2, 0.1, 1), ("c", 0.5, 1, 0.2, 2)]
    assert got("j5_logit_stats_by_basket", "basket_id", "class_error_ratio", "mean_pval", "rank_pvals") == [(1, 4, 0.3, 2), (2, 0.25, 0.2, 1)]
