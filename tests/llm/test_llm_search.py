import math

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from caserank.llm import impact_search as im


@settings(max_examples=40, deadline=None)
@given(st.integers(0, 2**31), st.integers(1, 60), st.integers(1, 9), st.sampled_from([1, 3, 50, 1000, 100_000]))
def test_no_member_is_dropped(seed, n, dim, size):
    r = np.random.default_rng(seed)
    v, q = r.integers(-size, size + 1, (n, dim)), r.integers(-size, size + 1, (4, dim))
    qi, row = im.ImpactBlock(v).candidates(q, np.full(4, -np.inf), 3)
    kept = set(zip(qi.tolist(), row.tolist()))
    s = q @ v.T
    for i in range(4):
        third = np.sort(s[i])[-min(3, n)]
        assert all((i, j) in kept for j in range(n) if s[i, j] >= third)


def brute(rows, k=10):
    fine = [(i, [math.floor(1024 * float(x)) for x in v]) for i, v in rows if i is not None and v and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    asked = {}
    for i, v in fine:
        if i % 100 == 0:
            asked[i] = min(asked.get(i, v), v)
    for i, q in asked.items():
        s = sorted((-sum(a * b for a, b in zip(q, v)), j) for j, v in fine if j != i and len(v) == len(q))
        out += [(i, r + 1, j, -x) for r, (x, j) in enumerate(s[:k])]
    return sorted(out)


def test_edges_and_ties(spark):
    r = np.random.default_rng(3)
    rows = [(i, [float(x) for x in np.float32(r.normal(0, 0.1, 6))]) for i in range(450)]
    rows += [(1000 + i, rows[7][1]) for i in range(30)]  # ties
    rows += [(500, None), (600, []), (601, [None] * 6), (700, [float("nan")] * 6), (701, [float("inf")] + [0.0] * 5), (None, [0.1] * 6), (800, [0.5, 0.5]), (802, [0.25, 0.5]), (900, [0.0] * 6)]
    rows += [rows[100], rows[101]]
    df = spark.createDataFrame([(i, v, "x", 3) for i, v in rows], "vec_id long, embedding array<double>, id string, block int").repartition(3)
    got = sorted(map(tuple, im.top_k(df, lambda i: i % 100 == 0).collect()))
    assert got == brute(rows)
    assert im.top_k(df.limit(0), lambda i: i % 100 == 0).count() == 0


def test_repeated_query_id_keeps_its_neighbours(spark):
    r = np.random.default_rng(5)
    rows = [(i, [float(x) for x in np.float32(r.normal(0, 0.1, 6))]) for i in range(450)]
    rows += [(100, [float(x) for x in np.float32(np.array(rows[100][1]) * r.uniform(2, 9))]) for _ in range(300)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(1)
    assert sorted(map(tuple, im.top_k(df, lambda i: i % 100 == 0).collect())) == brute(rows)


def test_query_against_brute_force(spark):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet").collect()]
    assert sorted(map(tuple, im.query(spark, "/root/testdata/sf0.001").collect())) == brute(rows)
