import numpy as np
from llm_cases import EDGE, edge_docs, no_docs

from caserank.llm import mil
from caserank.llm.common import WordIndex


def test_gradients():
    r = np.random.default_rng(0)
    m = mil.AttentionMIL()
    x, first, y = r.normal(size=(9, mil.N_FEATURES)), np.array([0, 4, 5, 9]), np.array([1.0, 0.0, 1.0])

    def loss():
        p = m.forward(x, first)[0]
        return -(y * np.log(p) + (1 - y) * np.log(1 - p)).mean()

    grads = m._gradients(x, first, y)
    for name in m.NAMES:
        at = tuple(0 for _ in m.p[name].shape)
        keep, eps = m.p[name][at], 1e-6
        m.p[name][at] = keep + eps
        up = loss()
        m.p[name][at] = keep - eps
        down = loss()
        m.p[name][at] = keep
        assert abs((up - down) / (2 * eps) - grads[name][at]) < 1e-6, name


def test_passages():
    words = WordIndex(mil._word_stats)
    x, first = mil.passage_features(words, [None, "a b a a", "", "w " * 130])
    assert first.tolist() == [0, 1, 2, 3, 6] and x.shape == (6, mil.N_FEATURES)
    assert not x[0].any() and x[1, 12] == 0.25 and x[1, 13] == 0.5 and abs(x[5, 14] - 2 / 64) < 1e-6


def test_attention_finds_the_bad_passage():
    r = np.random.default_rng(1)
    bags, y = [], []
    for _ in range(300):
        x = r.normal(0, 0.1, (r.integers(1, 6), mil.N_FEATURES))
        bad = r.random() < 0.5
        if bad:
            x[r.integers(len(x)), 5] += 2
        bags.append(x)
        y.append(float(not bad))
    m = mil.AttentionMIL().train(bags, np.array(y))
    p = m.scores(np.concatenate(bags), np.concatenate(([0], np.cumsum([len(b) for b in bags]))))
    assert np.mean((p > 0.5) == np.array(y)) > 0.97


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    quality = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    rows = mil.query(spark, sf).collect()
    assert len(rows) == spark.read.parquet(f"{sf}/documents.parquet").count()
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in rows)
    aside = [r for r in rows if r.held_out and r.doc_id in quality]
    assert np.mean([r.predicted == quality[r.doc_id] for r in aside]) > 0.9


def test_edges(spark):
    labels = spark.createDataFrame([(1, 1), (6, 0), (5, 0), (7, 1), (8, None), (None, 1)], "doc_id long, quality int")
    model = mil.fit(edge_docs(spark), labels)
    rows = mil.score(edge_docs(spark), model).collect()
    assert len(rows) == len(EDGE) and all(0 <= r.score <= 1 for r in rows)
    assert mil.score(no_docs(spark), model).count() == 0
    assert mil.fit(no_docs(spark), labels.limit(0)).constant == 0.5 and mil.fit(edge_docs(spark), labels.where("quality = 1")).constant == 1.0
    assert mil.accepted(edge_docs(spark), model, 0.0).collect() == edge_docs(spark).collect()
