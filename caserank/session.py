"""Spark session helpers.

The library never creates its own cluster settings beyond what a local test run
needs: on a cluster the session is handed in and only read. The checkpoint
folder is taken from ``spark.checkpoint.dir`` (a shared file system on a
cluster); a local fallback is set only when the session has none, as in tests.
"""

from __future__ import annotations

import atexit
import os
import re
import shutil
import tempfile
import threading
import uuid

from pyspark.sql import SparkSession

LOCAL_CONF = {
    "spark.sql.shuffle.partitions": "8",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
    "spark.driver.memory": "16g",
    "spark.scheduler.mode": "FAIR",  # the fits of a grid run side by side
}


def local_session(cpus: int | str = 8, extra: dict | None = None) -> SparkSession:
    """A local[N] session for tests and the benchmark."""
    b = SparkSession.builder.master(f"local[{cpus}]").appName("caserank")
    for k, v in {**LOCAL_CONF, **(extra or {})}.items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The shared checkpoint folder. A local one is set only if none is configured and
    the session runs in this process; executors elsewhere could not read it."""
    d = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not d:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        d = tempfile.mkdtemp(prefix="caserank-ckpt-", dir=os.environ.get("CASERANK_LOCAL_TMP", "/tmp"))
        atexit.register(shutil.rmtree, d, ignore_errors=True)  # stage tables of a local run
        try:
            spark.conf.set("spark.checkpoint.dir", d)
        except Exception:  # a static conf on some deployments; the context setting below suffices
            pass
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(d)
    return d


_SHARED: dict = {}
_INPUTS = ("orders", "lineitem", "customer", "nation")


def input_state(spark: SparkSession, sf_dir: str) -> list:
    """What names the study's input tables and their present content: path and time of change."""
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    paths = [spark._jvm.org.apache.hadoop.fs.Path(f"{sf_dir}/{t}.parquet") for t in _INPUTS]
    return [sf_dir, *[p.getFileSystem(conf).getFileStatus(p).getModificationTime() for p in paths]]


def shared(spark: SparkSession, sf_dir: str, name: str, build):
    """``build()`` once per application, input folder and state of its tables: queries of
    one run share their stage tables; a new application or changed input builds anew."""
    key = (spark.sparkContext.applicationId, *input_state(spark, sf_dir), name)
    if key not in _SHARED:
        _SHARED[key] = build()
    return _SHARED[key]


def remove_folder(spark: SparkSession, path: str) -> None:
    """Delete a folder that this library wrote and has read for the last time."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def cut_lineage(df, name: str = "stage"):
    """Materialise ``df`` as a Parquet table in the shared checkpoint folder and
    read it back: one computation (an RDD checkpoint would compute twice), a
    columnar file later scans can prune and filter, and no lineage to replay
    after an executor loss. Never a local checkpoint."""
    spark = df.sparkSession
    d = ensure_checkpoint_dir(spark)
    path = os.path.join(d, "tables", f"{name}-{uuid.uuid4().hex}")
    df.write.mode("overwrite").parquet(path)
    out = spark.read.parquet(path)
    out.stage_folder = path  # for ``drop_stage``
    return out


def drop_stage(*tables) -> None:
    """Delete stage tables (results of ``cut_lineage``) after their last reader has run and
    its own result is written; nothing computed from them lazily may be read afterwards."""
    for df in tables:
        remove_folder(df.sparkSession, df.stage_folder)


_SHIPPED: set = set()
_SHIPPING = threading.Lock()  # fits of a grid run in threads


def ship_package(spark: SparkSession) -> None:
    """Make ``caserank`` importable in the Python workers of a local session (the
    pandas functions of kNN and CLARA are pickled by reference). On a cluster the
    package is deployed with the job (``--py-files`` or an installed wheel)."""
    sc = spark.sparkContext
    with _SHIPPING:
        if id(sc) in _SHIPPED or not sc.master.startswith("local"):
            return
        pkg_dir = os.path.dirname(os.path.abspath(__file__))
        base = tempfile.mkdtemp(prefix="caserank-pkg-")
        archive = shutil.make_archive(os.path.join(base, "caserank"), "zip", root_dir=os.path.dirname(pkg_dir),
                                      base_dir="caserank")
        sc.addPyFile(archive)
        _SHIPPED.add(id(sc))
