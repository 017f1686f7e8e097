import hashlib
import random
import re
import zlib
from fractions import Fraction

import numpy as np
import pytest
from llm_cases import EDGE, edge_docs, no_docs

from caserank.llm import periodic_runs as pr


def runs_by_definition(w, min_length, exponent):
    """Every period's maximal stretches by scanning, non-primitive ones left out."""
    out = {}
    n = len(w)
    for q in range(1, n):
        i = 0
        while i + q < n:
            if w[i] != w[i + q]:
                i += 1
                continue
            j = i
            while j + q < n and w[j] == w[j + q]:
                j += 1
            length = j + q - i
            if length >= max(min_length, exponent * q):
                out.setdefault((i, length), q)  # periods ascend
            i = j
    return sorted(((s, length, q) for (s, length), q in out.items()), key=lambda r: (r[0], r[2]))


@pytest.mark.parametrize("seed", range(60))
def test_against_definition(seed):
    rng = random.Random(seed)
    w = []
    while len(w) < rng.choice([0, 5, 40, 120, 400]):
        piece = [rng.randrange(rng.choice([1, 2, 3, 30])) for _ in range(rng.randrange(1, 14))]
        w += piece * rng.choice([1, 1, 2, 3, 4, 9]) + piece[:rng.randrange(len(piece) + 1)]
    for min_length, exponent in ((24, 3), (4, 2), (1, 2), (9, 4)):
        if min_length > 1 or len(w) < 130:
            assert pr.runs_of(np.array(w, np.int64), min_length, exponent) == runs_by_definition(w, min_length, exponent) if w else True


def test_filter_misses_no_text():
    rng = random.Random(5)
    texts = [[rng.randrange(3 if k % 2 else 10_000) for _ in range(rng.randrange(60))] for k in range(80)]
    texts += [list(range(40)) * 3, list(range(15)) * 2, list(range(16)) * 2]
    ends = np.cumsum([0, *map(len, texts)])
    got = set(pr.repeating(np.array(sum(texts, []), np.int64), ends, 16).tolist())
    grams = [[tuple(t[i:i + 16]) for i in range(len(t) - 15)] for t in texts]
    assert got == {k for k, g in enumerate(grams) if len(set(g)) < len(g)}
    assert pr.least_lcp(24, 3) == 16


def expected(doc_id, text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    n = len(w)
    if doc_id is not None and n:
        h = zlib.crc32(str(doc_id).encode())
        if h % 10 == 0:
            g = h // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    runs = runs_by_definition(w, 24, 3) if n < 3000 else pr.runs_of(np.unique(w, return_inverse=True)[1], 24, 3)
    best = min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=(None, None, None))
    gone = {i for s, length, q in runs for i in range(s + q, s + length)}
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    return (doc_id, len(runs), *best, 1000 * best[1] // best[2] if runs else None, sha("".join(f"{s},{length},{q}\n" for s, length, q in runs)),
            sha(" ".join(x for i, x in enumerate(w) if i not in gone)))


def test_query(spark):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    got = {r.doc_id: tuple(r)[:8] for r in pr.query(spark, sf).collect()}
    assert got == {i: expected(i, t) for i, t in docs}
    assert sum(r[1] > 0 for r in got.values()) > 5


def test_edge_rows_and_no_rows(spark):
    out = pr.periodic_runs(edge_docs(spark)).collect()
    assert len(out) == len(EDGE)
    for r in out:
        text = next(t for i, t, *_ in EDGE if i == r.doc_id)
        w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
        assert r.n_words == len(w)
        if len(w) < 3000:
            assert [tuple(x) for x in r.runs] == runs_by_definition(w, 24, 3)
            if r.runs:
                s, length, q = r.runs[0]
                assert r.collapsed == " ".join(w[:s + q] + w[s + length:])
    assert pr.periodic_runs(no_docs(spark)).count() == 0
