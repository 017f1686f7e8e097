import numpy as np
from llm_cases import EDGE, edge_docs, no_docs

from caserank.llm import langid


def small_models():
    words = {"x": ["abc", "abd", "bad", "cab"], "y": ["zyx", "xyz", "zzy"]}
    ids = {c: i + 2 for i, c in enumerate("abcdxyz")}
    counts = {}
    for lang, ws in words.items():
        keys, _ = langid._grams(ws * 3, ids)
        k, n = np.unique(keys, return_counts=True)
        counts[lang] = dict(zip(k.tolist(), n.tolist()))
    return langid.CharModels(["x", "y"], counts, ids), ids


def test_probabilities_sum_to_at_most_one():
    m, ids = small_models()
    chars = [langid.EDGE, *ids.values()]
    for context in ([langid.EDGE] * 4, [langid.EDGE, langid.EDGE, 2, 3], [8, 8, 8, 8], [2, 3, 4, 5]):
        key = 0
        for c in context:
            key = key << langid.BITS | c
        p = np.exp(m._log_probs(np.array([key << langid.BITS | c for c in chars]), langid.ORDER)).sum(0)
        assert (p <= 1 + 1e-9).all() and (p > 0.8).all()


def test_words_of_a_language_fit_it():
    m, _ = small_models()
    v = m.word_values(["abc", "zyx!", "12", "Bad"])
    assert v[0, 0] > v[0, 1] and v[1, 1] > v[1, 0] and not v[2].any() and v[3, 0] > v[3, 1] and v[3, 2] == 4


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    lang = {r.doc_id: r.lang for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = langid.query(spark, sf).collect()
    assert len(rows) == len(lang) and all(0 <= r.score <= 1 for r in rows)
    aside = [r for r in rows if r.held_out]
    assert np.mean([r.lang_pred == lang[r.doc_id] for r in aside]) > 0.98


def test_edges(spark):
    docs = edge_docs(spark)
    rows = langid.identify(docs, docs.where("doc_id < 8")).collect()
    assert len(rows) == len(EDGE)
    for r in rows:
        text = next(t for i, t, *_ in EDGE if i == r.doc_id)
        has = bool(text) and any(c.isalpha() for c in text)
        assert (r.lang_pred == "und") == (not has) and (r.lang_pred in ("en", "de", "und")) and 0 <= r.score <= 1
    assert {r.lang_pred for r in langid.identify(docs, no_docs(spark)).collect()} == {"und"}
    assert langid.identify(no_docs(spark), docs).count() == 0


def test_no_language_is_lost(spark):
    """A language of few rows is learned, wherever the hash of its texts puts them."""
    base = [(k, " ".join(f"the{(k + j) % 7} cat{j}" for j in range(20)), "en") for k in range(40)]
    for seed in range(9):
        rows = base + [(100, f"zażółć gęślą jaźń {'żźć' * (seed + 1)}", "pl")] * 3 + [(200, "12 34", "xx")]
        df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
        models, _, _ = langid.fit(df)
        assert sorted(models.langs) == ["en", "pl"]
        if seed == 0:
            assert [r.lang_pred for r in langid.identify(df.where("doc_id = 100"), df).collect()] == ["pl"] * 3
