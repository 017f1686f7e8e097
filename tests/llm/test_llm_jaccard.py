import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from llm_cases import EDGE, edge_docs, no_docs

from caserank.llm import jaccard as jc
from caserank.llm.common import words_of


def brute(docs, size=4, percent=85):
    sets = []
    for _, t in docs:
        w = words_of(t)
        sets.append({tuple(w[i:i + size]) for i in range(len(w) - size + 1)} if len(w) >= size else ({tuple(w)} if w else set()))
    root = list(range(len(docs)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and min(len(a), len(b)) * 100 >= percent * max(len(a), len(b)) and 100 * len(a & b) >= percent * len(a | b):
                root[find(i)] = find(j)
    low = {}
    for k, (i, _) in enumerate(docs):
        if i is not None:
            low[find(k)] = min(low.get(find(k), i), i)
    return sorted((str(i), len(sets[k]), str(low.get(find(k)) if sets[k] else i)) for k, (i, _) in enumerate(docs))


def flat(df):
    return sorted((str(r.doc_id), r.n_shingles, str(r.component_id)) for r in df.collect())


@settings(max_examples=200, deadline=None)
@given(st.integers(0, 2**31), st.integers(1, 400), st.integers(0, 40), st.integers(0, 40), st.sampled_from([80, 85, 95]))
def test_linked_sets_share_a_tile(seed, n, lost, added, percent):
    r = np.random.default_rng(seed)
    base = r.integers(0, 2**64, n + added, dtype=np.uint64)
    a, b = np.unique(base[:n]), np.unique(base[min(lost, n - 1):])
    both = len(np.intersect1d(a, b))
    is_linked = 100 * both >= percent * (len(a) + len(b) - both)
    assert jc.linked(a, b, percent) == is_linked
    if is_linked and jc.set_id(a) != jc.set_id(b):
        assert len(np.intersect1d(jc.tile_keys(a, percent), jc.tile_keys(b, percent)))


def near_copies(seed, n=160):
    r = np.random.default_rng(seed)
    docs = []
    for i in range(n):
        if docs and r.random() < 0.6:
            w = words_of(docs[r.integers(len(docs))][1]).copy()
            for _ in range(r.integers(0, 4)):
                if w:
                    w[r.integers(len(w))] = b"edit%d" % r.integers(50)
        else:
            w = [b"w%d" % x for x in r.integers(0, 60, r.integers(0, 120))]
        docs.append((i, b" ".join(w).decode()))
    return docs


@pytest.mark.parametrize("size,percent", [(4, 85), (5, 80)])
def test_components_against_brute_force(spark, size, percent, monkeypatch):
    monkeypatch.setattr(jc, "TILE_BLOCK", 4)
    docs = near_copies(size)
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(5)
    got = flat(jc.similar_components(df, words=size, percent=percent))
    assert got == brute(docs, size, percent) and len({c for _, _, c in got}) < len(docs)


def test_edges(spark):
    assert flat(jc.similar_components(edge_docs(spark))) == brute([(r[0], r[1]) for r in EDGE])
    assert jc.similar_components(no_docs(spark)).count() == 0


def test_chain_of_links(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101), (101, 100), (7, 7)], "x long, y long")
    got = {r.node: r.root for r in jc.components(links).collect()}
    assert got == {**{i: 0 for i in range(41)}, 100: 100, 101: 100}


def test_table_against_brute_force(spark):
    sf = "/root/testdata/sf0.001"
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    assert flat(jc.query(spark, sf)) == brute(docs)


def unrelated(n, size, seed=5):
    r = np.random.default_rng(seed)
    return [np.unique(r.integers(0, 2**64, size, dtype=np.uint64)) for _ in range(n)]


@pytest.mark.parametrize("size", [300, 4100, 9000])
def test_bitmaps_rule_out_unrelated_sets_of_any_size(size):
    a, b = unrelated(2, size)
    assert jc.overlap_bound(len(a), jc.bitmap(a)[None], len(b), jc.bitmap(b)[None])[0] < 0.7 * size
    longer = np.unique(np.concatenate([a, b[:size // 5]]))  # bitmaps of two sizes hold the bound
    assert jc.overlap_bound(len(a), jc.bitmap(a)[None], len(longer), jc.bitmap(longer, 4 * size)[None])[0] >= len(a)


@pytest.mark.parametrize("percent", [80, 85])
def test_unrelated_sets_share_no_tile(percent):
    """Those of the least size of a band have the most empty parts; as tiles these would be shared."""
    start = next(b for b in jc.bands(percent, 1 << 13) if b > 3000)
    tiles = [jc.tile_keys(s, percent) for s in unrelated(300, start)]
    keys, times = np.unique(np.concatenate(tiles), return_counts=True)
    assert (times == 1).all()


def test_pairs_of_long_unrelated_texts_are_not_kept(spark):
    sets = unrelated(3, 4000)
    near = np.unique(np.concatenate([sets[0][:3900], sets[1][:60]]))
    rows = [(i, s.tobytes()) for i, s in enumerate([*sets, near])]
    df = spark.createDataFrame(rows, "set long, arr binary")
    pairs = spark.createDataFrame([(i, j) for j in range(4) for i in range(j)], "x long, y long")
    assert [tuple(r) for r in jc._bounded(pairs, df, 80).collect()] == [(0, 3)]
