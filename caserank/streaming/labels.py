"""The success label (D1) maintained incrementally with Structured Streaming.

Payments arrive as Parquet files in a folder; each micro-batch cleans the rows
(I1/I2, row-local), joins the static case table for TOA (stream-static join),
and updates the per-case running sums in the state store (grouped streaming
aggregation). The label is a projection of the running sums, so the output in
``update`` mode is exactly the batch ``success_label`` over all files seen.
"""

from __future__ import annotations

import os
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.label import MIN_COUNT, MIN_RATIO, ratio_test
from ..session import ensure_checkpoint_dir

PAYMENT_SCHEMA = "case_id long, month int, payment_amount double, number_of_payment int"


def streaming_labels(spark: SparkSession, payments_dir: str, cases: DataFrame, min_ratio: float = MIN_RATIO,
                     min_count: int = MIN_COUNT, key: str = "case_id") -> DataFrame:
    """A streaming DataFrame of ``(case_id, toa, sum_payments, sum_num_payments, suc)``."""
    from ..plans.study import clean_payments

    pay = clean_payments(spark.readStream.schema(PAYMENT_SCHEMA).parquet(payments_dir))
    j = pay.join(cases.select(key, "toa"), key, "left")
    sums = j.groupBy(key, "toa").agg(
        F.sum("payment_amount").alias("sum_payments"),
        F.sum("number_of_payment").cast("long").alias("sum_num_payments"),
    )
    suc1 = ratio_test(F.col("sum_payments"), F.col("toa"), min_ratio)
    suc2 = (F.col("sum_num_payments") >= F.lit(min_count)).cast("int")
    return sums.withColumn("suc", F.when(suc2 > suc1, suc2).otherwise(suc1))


def start_label_stream(spark: SparkSession, payments_dir: str, cases: DataFrame, out_dir: str, checkpoint: str | None = None, **kw):
    """Start the label stream in update mode: each micro-batch writes the labels that
    changed as Parquet under ``out_dir/batch=<id>``, so neither the driver nor one task
    ever holds the label table. A batch that is repeated after a failure overwrites its
    own folder. The state checkpoint lives under the shared checkpoint folder."""
    cp = checkpoint or os.path.join(ensure_checkpoint_dir(spark), "streams", f"labels-{uuid.uuid4().hex}")

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out_dir}/batch={batch_id}")

    return (streaming_labels(spark, payments_dir, cases, **kw).writeStream.outputMode("update")
            .foreachBatch(write).option("checkpointLocation", cp).start())


def latest_labels(spark: SparkSession, out_dir: str, key: str = "case_id") -> DataFrame:
    """The newest row of each case among the written batches."""
    rows = spark.read.parquet(out_dir)
    cols = [c for c in rows.columns if c not in (key, "batch")]
    return rows.groupBy(key).agg(F.max_by(F.struct(*cols), "batch").alias("_r")).select(key, "_r.*")
