import hashlib
import random

import numpy as np
import pytest
from llm_cases import EDGE, edge_docs, no_docs

from caserank.llm import suffix_dedup as sd


def by_definition(rows, width):
    """(id, text) rows with different ids, None last -> {id: (spans, kept)}."""
    seen, out = set(), {}
    for i, t in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0)):
        data = (t or "").encode()
        gone = bytearray(len(data))
        for s in range(len(data) - width + 1):
            piece = data[s:s + width]
            if piece in seen:
                gone[s:s + width] = b"\1" * width
            seen.add(piece)
        edges = np.flatnonzero(np.diff(np.frombuffer(b"\0" + gone + b"\0", np.int8))).tolist()
        out[i] = (list(zip(edges[::2], edges[1::2])), bytes(x for x, g in zip(data, gone) if not g))
    return out


def got(df, width):
    return {r.doc_id: ([tuple(s) for s in r.spans], bytes(r.kept)) for r in sd.without_repeats(df, width=width).collect()}


def made(rng, n=60):
    passages = ["".join(rng.choice("abcdefgh \n") for _ in range(rng.randrange(60, 400))) for _ in range(6)]
    rows = []
    for k in range(n):
        parts = []
        for _ in range(rng.randrange(1, 6)):
            kind = rng.randrange(4)
            p = rng.choice(passages)
            parts.append(p if kind == 0 else p[rng.randrange(len(p)):] if kind == 1
                         else "".join(rng.choice("abcdefgh é日") for _ in range(rng.randrange(200))) if kind == 2 else rng.choice(["ab", "x", "é "]) * rng.randrange(200))
        rows.append((k * 7 % n, "".join(parts)))
    return rows


@pytest.mark.parametrize("hot", [0, 3, 2_000])
def test_against_definition(spark, monkeypatch, hot):
    """All names hot, some, none: the same result."""
    monkeypatch.setattr(sd, "HOT", hot)
    rows = made(random.Random(hot))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    for width in (100, 41):
        assert got(df, width) == by_definition(rows, width)


def test_fragments_partition_the_stretches(monkeypatch):
    rng = random.Random(1)
    texts = [t.encode() for _, t in made(rng, 20)] + [b"", b"a" * 99, b"a" * 100, b"a" * 1000]
    data = np.frombuffer(b"".join(texts), np.uint8)
    ends = np.cumsum([0, *map(len, texts)])
    whole = [x.tolist() for x in sd.fragments(data, ends, 100)]
    names = {}
    covered = []
    for k, s, n, name in zip(*whole):
        for j in range(s, s + n):
            covered.append((k, j))
            assert names.setdefault(texts[k][j:j + 100], name) == name  # equal stretches, equal names
    assert covered == [(k, j) for k, t in enumerate(texts) for j in range(len(t) - 99)]
    monkeypatch.setattr(sd, "CACHED", 257)  # the borders of segments change no name
    for k, s, n, name in zip(*[x.tolist() for x in sd.fragments(data, ends, 100)]):
        assert all(names[texts[k][j:j + 100]] == name for j in range(s, s + n))


def test_edge_rows_and_no_rows(spark):
    rows = edge_docs(spark)
    out = sd.without_repeats(rows).collect()
    assert len(out) == len(EDGE)
    want = by_definition({(i, t) for i, t, *_ in EDGE}, 100)
    for r in out:
        assert ([tuple(s) for s in r.spans], bytes(r.kept)) == want[r.doc_id]
    assert sd.without_repeats(no_docs(spark)).count() == 0


def test_equal_rows_and_ids(spark):
    rng = random.Random(3)
    text = "".join(rng.choice("abcdefghij") for _ in range(300))
    rows = [(1, text), (1, text), (1, "other " + text), (2, text), (None, text), (None, text)]
    out = sd.without_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert len(out) == 6
    one = sorted(len(r.kept) for r in out if r.doc_id == 1)
    assert all(len(r.kept) == 0 for r in out if r.doc_id != 1)
    # the two equal rows of id 1 are one document: either both are whole or both follow the third
    assert one in ([len("other "), 300, 300], [0, 0, 306])


def test_query(spark):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    want = by_definition([tuple(r) for r in docs], 100)
    for r in sd.query(spark, sf).collect():
        spans, kept = want[r.doc_id]
        assert (r.n_removed, r.n_spans, r.kept_sha256) == (sum(b - a for a, b in spans), len(spans), hashlib.sha256(kept).hexdigest())
        assert r.n_bytes == r.n_removed + len(kept)
