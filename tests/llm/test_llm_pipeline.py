import public_tokenizers
import pyarrow as pa
from llm_cases import edge_docs, no_docs
from pyspark.sql import functions as F

import corpus_pipeline as cp
from caserank.llm import common, jaccard, mil, packing, quality_rules
from caserank.llm.common import stored

SF = "/root/testdata/sf0.01"


def test_stages_one_by_one(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    scores = {r.doc_id: r.score for r in mil.score(docs, mil.train_default(docs, spark.read.parquet(f"{SF}/labels.parquet"))).collect()}
    first = stored(cp.classifier_stage(spark, docs, SF), "t")
    assert first.columns == docs.columns and {r.doc_id for r in first.collect()} == {i for i, s in scores.items() if s >= mil.THRESHOLD}
    second = stored(cp.rules_stage(spark, first, SF), "t")
    judged = quality_rules.judge(first).withColumn("base", quality_rules.base_failed()).collect()
    assert second.columns == docs.columns and {r.doc_id for r in second.collect()} == {r.doc_id for r in judged if r.good and not r.base}
    third = stored(cp.near_duplicates_stage(spark, second, SF), "t")
    groups = jaccard.similar_components(second, words=5, percent=80).collect()
    assert third.columns == docs.columns and sorted(r.doc_id for r in third.collect()) == sorted({r.component_id for r in groups})
    assert third.count() < second.count()
    last = cp.packing_stage(spark, third, SF).collect()
    assert {r.doc_id for r in last} == {r.doc_id for r in third.collect()}
    # clean documents stay, but for near copies
    good = {i for i, q in labels.items() if q == 1}
    kept = {r.doc_id for r in second.collect()}
    short = {r.doc_id for r in judged if r.base}
    assert len(good & kept) >= 0.97 * len(good - short)


def test_run_on_small_table(spark):
    assert cp.run(spark, "/root/testdata/sf0.001").count() > 0
    assert [n for n, _ in cp.STAGES] == ["quality_classifier", "quality_rules", "ngram_jaccard_join", "best_fit_packing"]


def test_stages_on_edge_rows(spark):
    for docs in (edge_docs(spark), no_docs(spark)):
        for _, stage in cp.STAGES[:-1]:
            assert stage(spark, docs, SF).columns == docs.columns
        near = cp.near_duplicates_stage(spark, docs, SF)
        ids = [r.doc_id for r in near.collect()]
        assert len(ids) == len(set(ids)) and (not ids or {1, 2, 3, 5, 6, 8} <= set(ids) and 7 not in ids)
    assert packing.pack(no_docs(spark), public_tokenizers.path("byte_bpe_50k.json")).count() == 0


def test_near_copies_under_repeated_and_missing_ids(spark):
    a, b, c = ([f"{x}{i}" for i in range(60)] for x in "abc")
    text = lambda w, n="": " ".join([*w, n] if n else w)
    rows = [(1, text(a)), (2, text(b)), (2, text(a, "z")), (3, text(b, "y")), (3, text(b, "x")), (None, text(a)), (None, text(c)), (None, text(c)), (None, text(c, "w"))]
    near = cp.near_duplicates_stage(spark, spark.createDataFrame(rows, "doc_id long, text string"), SF)
    got = [(r.doc_id, r.text[0]) for r in near.collect()]
    assert sorted(got, key=str) == [(1, "a"), (2, "b"), (None, "c")]


def test_registered():
    import __spark_entry__ as e

    names = e.queries()
    assert sum(n.startswith("op") and n.split("_")[0][2:].isdigit() for n in names) == 13 and "pipeline" in names


def test_rows_of_one_id_and_text_leave_one_whatever_the_other_columns(spark):
    """The same row stays at any partitioning, and a column of the stage's own name is kept."""
    text = " ".join(f"w{i}" for i in range(60))
    rows = [(1, text, lang, src, f"own{k}") for k, (lang, src) in enumerate([("en", "a"), ("de", "b"), (None, "c"), ("fr", None)])]
    got = set()
    for parts in (1, 3):
        docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, _text_hash string").repartition(parts)
        out = cp.near_duplicates_stage(spark, docs, SF).collect()
        assert len(out) == 1 and tuple(out[0]) in {tuple(r) for r in rows}
        got.add(tuple(out[0]))
    assert len(got) == 1


def test_long_rows_go_to_python_few_at_a_time(spark):
    def largest(batches):
        yield pa.RecordBatch.from_arrays([pa.array([max(b.nbytes for b in batches)], pa.int64())], ["n"])

    rows = spark.range(0, 40, 1, 1).select(F.expr("repeat('x', 1 << 20)").alias("text"))
    before = spark.conf.get(common.BATCH)
    assert stored(common.mapped(rows, largest, "n long"), "t").first().n < 12 << 20 and spark.conf.get(common.BATCH) == before


def test_workers_keep_nothing_of_a_task_that_has_ended(spark):
    def fill(batches):
        common.KEPT.setdefault("test", {})["it"] = 1
        yield from batches

    def held(batches):
        for _ in batches:
            yield pa.RecordBatch.from_arrays([pa.array([len(common.KEPT.get("test", {}))], pa.int64())], ["id"])

    assert len(common.mapped(spark.range(0, 16, 1, 16), fill, "id long").collect()) == 16
    left = spark.range(0, 16, 1, 16).mapInArrow(held, "id long").collect()
    assert len(left) == 16 and not any(r.id for r in left)
