"""Driver contract: entry() runs on sf0.001; every oracle key is a query; a sample
of fast queries agrees with DuckDB at sf0.001 (the full check runs at sf0.01
with tools/oracle_check.py)."""
import math

import duckdb
import pytest

import __spark_entry__ as E
from conftest import SF001

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
FAST = ["d1_success_label", "d2_label_crosstab", "i1_i2_clean_payments", "i7_empirical_fill", "i10_donor_fill",
        "x2_sample_exact", "x3_permute_column", "a14_box_stats", "m10_m11_m12_m20_evaluate_by_segment",
        "d3_segment_success", "p12_null_census", "a6_global_quantiles"]


def _norm(df):
    def v(x):
        if x is None or (isinstance(x, float) and math.isnan(x)):
            return None
        try:
            import pandas as pd
            if pd.isna(x):
                return None
        except (TypeError, ValueError):
            pass
        if hasattr(x, "item"):
            x = x.item()
        return round(float(x), 6) if isinstance(x, (int, float)) and not isinstance(x, bool) else x
    cols = sorted(df.columns)
    return sorted((tuple(v(x) for x in r) for r in df[cols].itertuples(index=False)),
                  key=lambda t: tuple((a is None, str(a)) for a in t))


def test_entry_runs(spark):
    df = E.entry(spark)
    rows = df.collect()
    assert len(rows) == 19 and {"var", "rank_lin", "rank_spear"} <= set(df.columns)
    assert sorted(r.rank_spear for r in rows) == list(range(1, 20))


def test_oracle_keys_are_queries():
    assert set(E.oracle_sql()) <= set(E.queries())


@pytest.mark.parametrize("name", FAST)
def test_fast_oracles_sf0001(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF001}/{t}.parquet')")
    s = E.queries()[name](spark, SF001).toPandas()
    d = con.execute(E.oracle_sql()[name]).df()
    assert sorted(s.columns) == sorted(d.columns)
    assert _norm(s) == _norm(d)
