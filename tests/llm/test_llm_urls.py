import duckdb
from hypothesis import given, settings
from hypothesis import strategies as st

from caserank.llm import url_filter as uf


@settings(max_examples=30, deadline=None)
@given(st.integers(1, 300), st.integers(0, 3000), st.floats(0.01, 0.5))
def test_cascade_is_exact_over_its_universe(n, others, rate):
    listed, rest = {f"in{i}" for i in range(n)}, {f"out{i}" for i in range(others)}
    first = uf.Bloom(listed, n, rate, 1)
    c = uf._further_levels(first, listed, {x for x in rest if x in first})
    assert all(x in c for x in listed) and not any(x in c for x in rest)


def brute(url, rules, default="allow"):
    if url is None or "://" not in url:
        host = path = ""
    else:
        rest = url.split("://", 1)[1]
        cut = min([rest.find(c) for c in "/?#" if c in rest] or [len(rest)])
        host, path = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:cut]), rest[cut:]
        path = path[:min([path.find(c) for c in "?#" if c in path] or [len(path)])]
    fit = [(len(h + p), len(h), h + p, a) for h, p, a in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return (host, path, *(max(fit)[2:] if fit else (None, default)))


def test_edge_urls(spark):
    urls = [None, "", "no scheme", "://", "http://", "http://A.Example.ORG/es/x", "http://example.org/es", "http://example.org/en/1?q#f", "http://badexample.org/es/",
            "http://x.com/de/1", "http://com/de/", "http://com", "http://x.com?/de/", "http://a.b.c.d.example.org/en/19", "http://ÄB.org/", "http://org/" + "a/" * 5000,
            "http://x.com/fr/" + "y" * 20_000, "a://b://org/", "http://org./", "http://.org/", "http://x.org\n/y"]
    urls += urls[:6]
    df = spark.createDataFrame([(i, u, "x", "y") for i, u in enumerate(urls)], "page_id long, url string, host string, key string")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in uf.filter_urls(df, uf.RULES).collect()}
    assert got == {i: brute(u, uf.RULES) for i, u in enumerate(urls)}
    assert uf.filter_urls(df.limit(0), uf.RULES).count() == 0
    assert {r.verdict for r in uf.filter_urls(df, []).collect()} == {"allow"}
    assert {r.verdict for r in uf.filter_urls(df, [("com", "", "block")], default="allow").where("host like '%com'").collect()} == {"block"}


def test_query_against_sql(spark):
    sf = "/root/testdata/sf0.01"
    c = duckdb.connect()
    c.execute(f"create view pages as select * from '{sf}/pages.parquet'")
    assert sorted(map(tuple, uf.query(spark, sf).collect()), key=str) == sorted(c.execute(uf.ORACLE).fetchall(), key=str)
