"""Findings of round 3: filters that the optimizer restates once a column."""
from pyspark.sql import functions as F

import __spark_entry__ as E
from caserank.operators.cluster import clara
from caserank.operators.columns import complete_cases, keep_in, keep_not_in
from caserank.operators.impute import fill_group_means, fill_group_stat
from caserank.operators.models import hold_out
from caserank.operators.stats import corr_matrix
from caserank.plans import catalog
from caserank.plans import ranking_study as RS
from conftest import SF001


def _wide(spark, p=10):
    return spark.range(40).select("id", *[F.when((F.col("id") + k) % 31 > 0, F.col("id") * (k + 1) % 7).alias(f"x{k}") for k in range(p)])


def test_complete_cases_restates_one_condition_a_column(spark, tmp_path):
    _wide(spark).write.parquet(str(tmp_path / "t"))
    t = spark.read.parquet(str(tmp_path / "t"))
    named = complete_cases(t.select(*[F.col(f"x{k}").alias(f"c{k}") for k in range(10)])).select(*[F.col(f"c{k}").alias(f"d{k}") for k in range(10)])
    # a single condition over all ten has 2^10 forms under the aliases
    assert named._jdf.queryExecution().optimizedPlan().constraints().size() < 100
    assert named.count() == t.dropna().count() > 0
    odd = spark.createDataFrame([(1.0, 1, "a"), (float("nan"), 1, "a"), (None, 1, "a"), (1.0, None, "a"), (1.0, 1, None)], "x double, n int, s string")
    assert complete_cases(odd).collect() == odd.dropna().collect() and len(complete_cases(odd).collect()) == 1
    assert complete_cases(odd, ["n"]).count() == 4


def test_complete_correlation_and_clusters_of_many_columns(spark, tmp_path):
    p = 24  # one condition over all of them would not be planned within hours
    _wide(spark, p).write.parquet(str(tmp_path / "t"))
    t = spark.read.parquet(str(tmp_path / "t"))
    assert corr_matrix(t, [f"x{k}" for k in range(p)], complete_only=True).count() == p * p
    out, med = clara(t, "id", [f"x{k}" for k in range(p)], k=2, samples=2, sampsize=5)
    rows = t.dropna().count()
    assert out.where("cluster is not null").count() == rows and med.count() == min(2, rows)


def test_group_fills_join_a_stage_table(spark, tmp_path):
    rows = [(i, i % 2, float(i) if i % 3 else None) for i in range(60)] + [(90, None, None)]
    spark.createDataFrame(rows, "id long, g int, x double").write.parquet(str(tmp_path / "t"))
    t = spark.read.parquet(str(tmp_path / "t"))
    seen = {g: [x for _, h, x in rows if h == g and x is not None] for g in (0, 1)}
    for filled in (fill_group_stat(t, "x", "g", "mean"), fill_group_means(t, ["x"], "g")):
        plan = filled._jdf.queryExecution().sparkPlan().toString()
        # two groups: a shuffled join would bring all rows to two tasks
        assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan
        want = {i: x if x is not None or g is None else sum(seen[g]) / len(seen[g]) for i, g, x in rows}
        got = {r.id: r.x for r in filled.collect()}
        assert got.keys() == want.keys() and all(a == b if b is None else abs(a - b) < 1e-9 for a, b in ((got[i], want[i]) for i in want))


def test_membership_joins_distinct_keys(spark):
    a, b = spark.createDataFrame([(1,), (1,), (2,), (None,)], "k long"), spark.createDataFrame([(1, 0), (1, 1), (None, 2)], "k long, z int")
    assert sorted(r.k for r in keep_in(a, b, "k").collect()) == [1, 1]
    assert sorted((r.k is None, r.k) for r in keep_not_in(a, b, ["k"]).collect()) == [(False, 2), (True, None)]
    assert "Aggregate" in keep_in(a, b, "k")._jdf.queryExecution().optimizedPlan().toString()


def test_formula_fill_reads_its_columns_alone(spark):
    plan = catalog.QUERIES["i3_formula_fill"](spark, SF001)._jdf.queryExecution().optimizedPlan().toString()
    # computed here, not read from the table of all columns, and without the last payment
    assert "l_tax" in plan and "struct(l_shipdate" not in plan


def test_hold_out_restates_one_condition_a_column(spark, tmp_path):
    _wide(spark).write.parquet(str(tmp_path / "t"))
    t, names = spark.read.parquet(str(tmp_path / "t")), [f"x{k}" for k in range(1, 10)]
    parts = hold_out(t, "id", "x0", names)
    named = parts[0].select(*[F.col(f"x{k}").alias(f"c{k}") for k in range(10)])
    assert named._jdf.queryExecution().optimizedPlan().constraints().size() < 100
    assert parts[0].count() + parts[1].count() == t.dropna().count()


def test_pvalues_run_no_permutations(spark, monkeypatch):
    asked = []
    monkeypatch.setattr(RS, "permutation_importance", lambda *a, **k: asked.append(1))
    assert E.queries()["m9_logit_pvalues"](spark, SF001).count() == len(RS.FEATURES) and not asked


def test_best_k_runs_no_removals(spark, monkeypatch):
    def refuse(*args, **kw):
        raise AssertionError("the errors by k need no removals")

    monkeypatch.setattr(RS, "knn_removal_importance", refuse)
    monkeypatch.setattr("caserank.session._SHARED", {})
    monkeypatch.setattr(RS, "KNN_KS", [3, 5])
    assert E.queries()["w4_best_k_knn"](spark, SF001).first().k in (3, 5)
