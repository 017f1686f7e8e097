import itertools
import random
import re
from collections import Counter

import duckdb
import pytest
from llm_cases import EDGE, edge_docs, no_docs

from caserank.llm import filter_audit as fa


def fails(text):
    t = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", t)
    return (len(w) < 100, 100 * len(set(w)) < 80 * len(w), 100 * len(re.findall("[A-Z]", t)) > 10 * len(t), bool(re.search(r"[#$%&*|]", t)))


def by_hand(masks):
    """(order, step) -> kept, removed, redundant, unique, shapley of a list of masks."""
    out, over = {}, Counter()
    for order in itertools.permutations(range(5)):
        left = list(masks)
        for k, f in enumerate(order):
            gone = [m for m in left if m >> f & 1]
            left = [m for m in left if not m >> f & 1]
            over[f] += len(gone)
            out["".join("ABCDE"[x] for x in order), k + 1] = [len(left), len(gone), sum(m >> f & 1 for m in masks) - len(gone), masks.count(1 << f), f]
    return {k: (*v[:4], over[v[4]]) for k, v in out.items()}


def test_swaps_visit_every_order():
    for n in range(6):
        order, seen = list(range(n)), set()
        seen.add(tuple(order))
        for at in fa.adjacent_swaps(n):
            order[at], order[at + 1] = order[at + 1], order[at]
            assert tuple(order) not in seen
            seen.add(tuple(order))
        assert seen == set(itertools.permutations(range(n)))


@pytest.mark.parametrize("seed", range(4))
def test_diagram_against_definition(seed):
    rng = random.Random(seed)
    masks = [rng.choice([0, 1, 3, 16, rng.randrange(32)]) for _ in range(rng.choice([0, 1, 40, 300]))]
    got = fa.audit_part({m: (n,) for m, n in Counter(masks).items()}, "ABCDE", 1)
    want = by_hand(masks)
    assert len(got) == 600
    assert {(r.filter_order, r.step): (r.kept, r.removed, r.redundant, r.unique_fails, r.shapley) for r in got.itertuples()} == want


def test_nodes_are_shared():
    d = fa.MaskDiagram(5, {}, 1)
    assert len(d.pairs) == 6  # one node a level where all counts are zero
    d.swap(2)
    assert d.all_pass() == [(0,)] * 6


def test_masks_of_edge_rows(spark):
    rows = fa.failure_masks(edge_docs(spark)).collect()
    key = lambda i: (i is None, i or 0)
    first = {}
    for i, t, *_ in EDGE:
        first[t or ""] = min(first.get(t or "", (True, 0)), key(i))
    want = Counter((i, lang or "", sum(b << k for k, b in enumerate((*fails(t), key(i) > first[t or ""])))) for i, t, lang, _ in EDGE)
    assert Counter((r._id, r.part, r.mask) for r in rows) == want


def test_audit_of_edge_rows_and_no_rows(spark):
    masks = fa.failure_masks(edge_docs(spark))
    got = {(r.part, r.filter_order, r.step): (r.kept, r.removed, r.redundant, r.unique_fails, r.shapley) for r in fa.audit(masks).collect()}
    by = {}
    for r in masks.collect():
        by.setdefault(r.part, []).append(r.mask)
    assert got == {(p, *k): v for p, m in by.items() for k, v in by_hand(m).items()}
    assert fa.audit(fa.failure_masks(no_docs(spark))).count() == 0


def test_query_against_sql(spark):
    sf = "/root/testdata/sf0.001"
    con = duckdb.connect()
    for t in ("documents", "labels"):
        con.execute(f"create view {t} as select * from '{sf}/{t}.parquet'")
    cols = ["part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]
    want = sorted(con.execute(f"select {', '.join(cols)} from ({fa.ORACLE})").fetchall())
    assert sorted(map(tuple, fa.query(spark, sf).select(*cols).collect())) == want and len(want) % 600 == 0
