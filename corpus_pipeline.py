"""The corpus pipeline: a list of stages over the documents table, each a function
(spark, docs, sf_dir) -> DataFrame whose result is written as Parquet and read again
as the next stage's documents.

1. quality classifier: documents that score below the threshold go;
2. quality rules: documents that fail the base conditions or are judged bad go;
3. n-gram Jaccard join (words of five, similarity 0.8): of each group of near copies
   one row stays, that of the smallest id (rows without an id last), then of the smallest
   text hash; a row without shingles is near no other and stays once for its id and text;
4. best-fit packing: the rest as token sequences.

The first three return the columns of documents, whatever further columns there are and
however they are named. Null and empty texts: the classifier scores them like any text and
the rules drop them (fewer than 50 words), so neither the join nor the packing needs to
see them; where a stage is used alone, its operator's docstring says what it does. Rows of
one id and text are one document from the third stage on: the row with the least hash
over all columns stays, so the choice does not change between runs. An empty table passes
through every stage.
"""

from __future__ import annotations

import functools

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from caserank.llm import jaccard, mil, packing, quality_rules
from caserank.llm.common import release, stored, table, written

SHINGLE_WORDS, PERCENT = 5, 80
#: By application and input: the stage tables that the stage before has left.
_LEFT: dict[tuple, tuple[int, int]] = {}


def _stage(function):
    """A stage's result is written before the next stage begins, so its own stage tables
    have no reader left then and are deleted."""
    @functools.wraps(function)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        key = (spark.sparkContext.applicationId, sf_dir)
        release(*_LEFT.pop(key, (0, 0)))
        low = written()
        out = function(spark, docs, sf_dir)
        _LEFT[key] = (low, written())
        return out

    return run


@_stage
def classifier_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = mil.train_default(docs, table(spark, sf_dir, "labels", "doc_id", "quality"))
    return mil.accepted(docs, model, mil.THRESHOLD)


@_stage
def rules_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality_rules.passing(docs)


@_stage
def near_duplicates_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    stay = jaccard.representatives(docs, words=SHINGLE_WORDS, percent=PERCENT).select(F.col("doc_id").alias("_stay_id"), F.col("text_hash").alias("_stay_hash"))
    mark = "_text_hash"
    while mark in docs.columns:
        mark += "_"
    hashed = docs.withColumn(mark, F.xxhash64("text"))
    kept = hashed.join(stay, (F.col(mark) == F.col("_stay_hash")) & F.col("doc_id").eqNullSafe(F.col("_stay_id")), "left_semi")
    # rows of one id and text are one document: the one with the least hash of all columns stays
    row = [F.col(f"`{c}`") for c in docs.columns]
    return kept.groupBy("doc_id", mark).agg(F.min_by(F.struct(*row), F.xxhash64(*row)).alias("_row")).select("_row.*")


@_stage
def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [
    ("quality_classifier", classifier_stage),
    ("quality_rules", rules_stage),
    ("ngram_jaccard_join", near_duplicates_stage),
    ("best_fit_packing", packing_stage),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)


#: Model fitting, components and packing have no SQL form; tests hold the stages against brute force.
ORACLE_SQL = None
