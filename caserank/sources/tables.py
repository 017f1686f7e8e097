"""Sources and sinks (S1-S4): Parquet tables in, Parquet tables out."""

from __future__ import annotations

import os
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

def read_table(spark: SparkSession, directory: str, name: str) -> DataFrame:
    """Load a named table, ``<dir>/<name>.parquet`` (a file or a folder of parts).
    Only Spark's readers touch the path, so it may lie in any store they reach."""
    return spark.read.parquet(f"{directory}/{name.removesuffix('.parquet')}.parquet")


def write_table(df: DataFrame, directory: str, name: str, partition_by: Sequence[str] | None = None) -> str:
    """S3: save a result table (overwrite) and return its path."""
    path = os.path.join(directory, name)
    w = df.write.mode("overwrite")
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.parquet(path)
    return path


def lookup_table(spark: SparkSession, rows: Sequence[Sequence], schema: str) -> DataFrame:
    """A literal dimension table built on the driver.

    Its size is the length of ``rows`` (known on the driver), so joining it
    with ``F.broadcast`` is safe at any data size.
    """
    return F.broadcast(spark.createDataFrame([tuple(r) for r in rows], schema=schema))
