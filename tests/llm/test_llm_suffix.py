import math
import zlib
from collections import Counter, defaultdict

import numpy as np
from hypothesis import given
from hypothesis import strategies as st
from llm_cases import EDGE, edge_docs, no_docs

from caserank.llm import suffix_tree as pst
from caserank.llm.common import words_of


@given(st.lists(st.integers(0, 2**64 - 1)), st.sampled_from([np.uint64, np.int32, np.float32, bool]))
def test_squeeze(xs, kind):
    a = np.array(xs, np.uint64).astype(kind)
    assert np.array_equal(pst.unsqueeze(pst.squeeze(a)), a, equal_nan=kind is np.float32)
    s = np.unique(np.array(xs, np.uint64))
    assert np.array_equal(pst.unsqueeze_sorted(pst.squeeze_sorted(s)), s)


def brute(docs):
    """The model over dictionaries, by its definition."""
    END, START = b"</end>\n", b"<start>\n"
    texts = [(i, words_of(t) + [END], i is not None and zlib.crc32(str(i).encode()) % 7 == 2) for i, t in docs]
    c = [Counter(), Counter(), Counter()]
    N = [Counter(), Counter(), Counter()]
    occ = []
    for i, w, held in texts:
        for k, x in enumerate(w):
            ctx = [(), (w[k - 1] if k else START,)] + ([(w[k - 2] if k > 1 else START, w[k - 1])] if k else [])
            occ.append((i, held, x, ctx))
            if not held:
                for d, s in enumerate(ctx):
                    c[d][s, x] += 1
                    N[d][s] += 1
    total, known = N[0][()], len(c[0])

    def p(x, ctx, d, out, kept):
        if d == 0:
            return max(c[0][(), x] + 1 - out, 1) / max(total + known + 1 - out, 1)
        s = ctx[d]
        low = p(x, ctx, d - 1, out, kept) if d == 1 or kept.get(ctx[d - 1]) else p(x, ctx, 0, out, kept)
        mu = pst.MU[d - 1]
        return (max(c[d][s, x] - out, 0) + mu * low) / (max(N[d][s] - out, 0) + mu)

    kept = {}
    for d in (1, 2):
        gain = defaultdict(float)
        for _, held, x, ctx in occ:
            if not held and len(ctx) > d and N[d][ctx[d]] >= 2:
                low = p(x, ctx, d - 1, 1, kept) if d == 1 or kept.get(ctx[1]) else p(x, ctx, 0, 1, kept)
                gain[ctx[d]] += math.log(p(x, ctx, d, 1, kept)) - math.log(low)
        kept |= {s: g > pst.TAU for s, g in gain.items()}
    out, at = [], 0
    for i, w, held in texts:
        own = occ[at:at + len(w)]
        at += len(w)
        score = 0.0
        for _, _, x, ctx in own:
            d = 2 if len(ctx) > 2 and kept.get(ctx[2]) else 1 if kept.get(ctx[1]) else 0
            score += math.log10(p(x, ctx, d, 0, kept))
        base = sum(math.log10((c[0][(), x] + 1) / (total + known + 1)) for x in w)
        out.append((str(i), held, len(w), sum(c[0][(), x] > 0 for x in w), total, round(base, 4), round(score, 3)))
    return sorted(out), kept


def flat(rows):
    return sorted((str(r.doc_id), r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 4), round(r.score, 3)) for r in rows)


def close(a, b):
    assert len(a) == len(b)
    for x, y in zip(a, b):
        assert x[:5] == y[:5] and abs(x[5] - y[5]) < 1e-3 and abs(x[6] - y[6]) < 2e-2 + 1e-6 * abs(x[6]), (x, y)


def test_table_against_brute_force(spark):
    sf = "/root/testdata/sf0.001"
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    want, kept = brute(docs)
    assert sum(kept.values()) > 10 and not all(kept.values())
    rows = pst.query(spark, sf).collect()
    close(flat(rows), want)
    held = [r for r in rows if r.held_out]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)


def test_edges(spark):
    want, _ = brute([(r[0], r[1]) for r in EDGE])
    close(flat(pst.score(edge_docs(spark)).collect()), want)
    assert pst.score(no_docs(spark)).count() == 0
    only_held = spark.createDataFrame([(i, "a b") for i in range(60) if zlib.crc32(str(i).encode()) % 7 == 2], "doc_id long, text string")
    for r in pst.score(only_held).collect():
        assert r.n_known == 0 and r.train_tokens == 0 and r.base_score == 0.0
