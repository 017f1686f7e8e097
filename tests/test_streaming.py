"""The streaming label equals the batch label over the same payment files."""
import tempfile

from pyspark.sql import functions as F

from caserank.operators.label import success_label
from caserank.plans import study
from caserank.sources.fixtures import cases_raw, payments_raw
from caserank.streaming.labels import latest_labels, start_label_stream
from conftest import SF001


def test_stream_equals_batch(spark):
    cases = cases_raw(spark, SF001).select("case_id", "toa")
    pay = payments_raw(spark, SF001)
    d = tempfile.mkdtemp(prefix="caserank-stream-")
    pay.where(F.col("month") % 2 == 0).write.mode("append").parquet(d)
    out = tempfile.mkdtemp(prefix="caserank-labels-")
    q = start_label_stream(spark, d, cases, out)
    q.processAllAvailable()
    pay.where(F.col("month") % 2 == 1).write.mode("append").parquet(d)
    q.processAllAvailable()
    got = {r.case_id: r.suc for r in latest_labels(spark, out).collect()}
    q.stop()
    ref = {r.case_id: r.suc for r in success_label(cases, study.clean_payments(pay)).collect()}
    assert got == ref
