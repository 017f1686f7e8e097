import re
from collections import Counter

from llm_cases import EDGE, edge_docs, no_docs

from caserank.llm import quality_rules as qr


def stats(t):
    t = t or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", t)
    win = list(zip(w, w[1:], w[2:]))
    c, covered = Counter(win), set()
    for k, x in enumerate(win):
        if c[x] > 1:
            covered |= {k, k + 1, k + 2}
    lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(w), sum(map(len, w)), sum(ch in "#*$%&|<>" for ch in t), len(lines) - len(set(lines)), len(covered)


def row(r):
    return r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words


EXTRA = ["a b c a b c", "a a a", "a a a a", "x\nx\n\n \n x\nx", "a b a b a b a", "| # * <|> \U0001F600 é", "one two three", "q\x1cq q\x1cq q\x1cq q\x1cq"]


def test_statistics_against_brute_force(spark):
    texts = [(100 + i, t, None, None) for i, t in enumerate(EXTRA)]
    docs = edge_docs(spark).select("doc_id", "text", "lang", "source").unionByName(spark.createDataFrame(texts, "doc_id long, text string, lang string, source string"))
    got = Counter((r._id, row(r)) for r in qr.text_stats(docs).collect())
    assert got == Counter((r[0], stats(r[1])) for r in EDGE + texts)


def test_query(spark):
    sf = "/root/testdata/sf0.01"
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    quality = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    rows = qr.query(spark, sf).collect()
    assert len(rows) == len(docs)
    right = total = 0
    for r in rows:
        assert row(r) == stats(docs[r.doc_id])
        assert r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words) and not (r.base_failed and r.kept)
        if r.doc_id in quality and not r.base_failed:
            total += 1
            right += r.kept == bool(quality[r.doc_id])
    assert right / total > 0.98


def test_main_path_is_native(spark):
    plan = qr.judge(edge_docs(spark))._jdf.queryExecution().toString() + qr.text_stats(edge_docs(spark))._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


def test_edges(spark):
    assert qr.judge(edge_docs(spark)).count() == len(EDGE)
    assert qr.judge(no_docs(spark)).count() == 0
    kept = qr.passing(edge_docs(spark))
    assert kept.columns == edge_docs(spark).columns and qr.passing(no_docs(spark)).count() == 0


def test_em_recovers_accuracies(spark):
    import numpy as np

    r = np.random.default_rng(5)
    y = r.random(4000) < 0.85
    votes = [np.where(r.random(4000) < (0.6 if j < 4 else 0.3), np.where(r.random(4000) < 0.9, np.where(y, 1, -1), np.where(y, -1, 1)), 0) for j in range(6)]
    rows = Counter(zip(*[v.tolist() for v in votes]))
    names = [f"v{j}" for j in range(6)]
    patterns = spark.createDataFrame([(*k, n) for k, n in rows.items()], ", ".join(f"{n} int" for n in names) + ", n long")
    m = qr.fit_votes(patterns, names, steps=25)
    assert abs(m.prior - y.mean()) < 0.05
    p = {tuple(x[:6]): x.p for x in patterns.withColumn("p", qr.posterior(names, m)).collect()}
    assert np.mean([(p[k] >= 0.5) == t for k, t in zip(zip(*[v.tolist() for v in votes]), y)]) > 0.95
