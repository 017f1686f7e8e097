import collections
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st
from llm_cases import EDGE, edge_docs, no_docs

from caserank.llm import common, packing
from tokenizers import Tokenizer

PATH = public_tokenizers.path("byte_bpe_50k.json")


@given(st.integers(1, 20_000))
def test_cut_covers_and_only_the_first_is_short(n):
    got = packing.cut(n, 2048)
    assert [s for s, _ in got] == list(np.cumsum([0] + [x for _, x in got[:-1]])) and sum(x for _, x in got) == n
    assert all(x == 2048 for _, x in got[1:]) and 0 < got[0][1] <= 2048


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(alphabet=st.sampled_from("ab1. ,\n\t  é<|endoftext>'s日\x1c"), max_size=40), max_size=4))
def test_chunks_tokenise_as_the_library_does(texts):
    lib = Tokenizer.from_file(PATH)
    got = packing.ChunkTokenizer(PATH).encode(texts)
    assert [np.frombuffer(x, "<u4").tolist() for x in got] == [lib.encode(t, add_special_tokens=False).ids for t in texts]


def test_full_caches_change_no_ids(monkeypatch):
    lib, tok = Tokenizer.from_file(PATH), packing.ChunkTokenizer(PATH)
    monkeypatch.setattr(packing, "CACHE", 20)
    r = np.random.default_rng(2)
    words = [f"w{k}{'ab,'[k % 3]}" for k in range(40)]
    for _ in range(30):
        texts = [" ".join(r.choice(words, 12)), "  ".join(r.choice(words, 3))]
        assert [np.frombuffer(x, "<u4").tolist() for x in tok.encode(texts)] == [lib.encode(t, add_special_tokens=False).ids for t in texts]
    assert len(tok.plain) + len(tok.spaced) <= 20 + 30 and any(tok.older)


@settings(max_examples=40, deadline=None)
@given(st.lists(st.integers(1, 100), min_size=1, max_size=120))
def test_search_never_needs_more_bins_and_raises_squared_fill(sizes):
    a, b = packing.Bins(np.array(sizes), 100), packing.Bins(np.array(sizes), 100)
    a.best_fit()
    b.best_fit()
    b.improve()
    used = lambda x: sum(bool(m) for m in x.members)
    square = lambda x: sum(f * f for f in x.fill)
    assert used(b) <= used(a) and square(b) >= square(a)
    of, off, fill = b.places()
    for k in set(of.tolist()):
        own = sorted((off[i], sizes[i]) for i in np.flatnonzero(of == k))
        assert [o for o, _ in own] == list(np.cumsum([0] + [s for _, s in own[:-1]])) and sum(s for _, s in own) <= 100


def test_search_saves_bins_that_best_fit_needs():
    r, saved = np.random.default_rng(1), 0
    for _ in range(20):
        sizes = r.integers(20, 60, 200)
        a, b = packing.Bins(sizes, 100), packing.Bins(sizes, 100)
        a.best_fit()
        b.best_fit()
        b.improve()
        saved += len(a.members) - sum(bool(m) for m in b.members)
    assert saved > 0


def _fewest(sizes, capacity):
    """The fewest bins, by trying every document in every open bin."""
    sizes, best = sorted(sizes, reverse=True), [len(sizes)]

    def place(k, fills):
        if len(fills) >= best[0]:
            return
        if k == len(sizes):
            best[0] = len(fills)
            return
        for b in {f: i for i, f in enumerate(fills) if f + sizes[k] <= capacity}.values():
            place(k + 1, [*fills[:b], fills[b] + sizes[k], *fills[b + 1:]])
        place(k + 1, [*fills, sizes[k]])

    place(0, [])
    return best[0]


def test_small_groups_against_the_fewest_bins():
    r, exact, best_fit = np.random.default_rng(3), 0, 0
    for _ in range(150):
        sizes = r.integers(12, 70, r.integers(1, 14))
        of, off, fill = packing.pack_group(sizes, 100)
        a = packing.Bins(sizes, 100)
        a.best_fit()
        need, got = _fewest(sizes.tolist(), 100), len(set(of.tolist()))
        assert need <= got <= min(need + 1, len(a.members))
        exact, best_fit = exact + (got == need), best_fit + (len(a.members) == need)
    assert exact >= 145 and exact >= best_fit


def test_search_ends_with_nothing_left_to_gain():
    """No move or exchange that the search knows raises the squared fill at its end."""
    r = np.random.default_rng(4)
    for _ in range(15):
        sizes = r.integers(30, 60, 60)
        b = packing.Bins(sizes, 100)
        b.best_fit()
        b.improve()
        if sum(map(bool, b.members)) <= -(-int(sizes.sum()) // 100):
            continue
        free = 100 - np.array(b.fill)
        for g in range(len(b.members)):
            for to in range(len(b.members)):
                if g == to or not b.members[g] or not b.members[to] or not 0 < free[to] <= free[g]:
                    continue
                for x in b.members[g]:
                    assert sizes[x] > free[to]
                    for y in b.members[to]:
                        assert not 0 < sizes[x] - sizes[y] <= free[to]


def _check(rows, texts):
    lib = Tokenizer.from_file(PATH)
    want = collections.Counter()
    for doc_id, text in texts:
        ids = np.array(lib.encode(text or "", add_special_tokens=False).ids + [0], "<u4")
        for k, (s, n) in enumerate(packing.cut(len(ids))):
            want[doc_id, k, s, n, zlib.crc32(ids[s:s + n].tobytes())] += 1
    assert collections.Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows) == want
    places = collections.defaultdict(list)
    for r in rows:
        places[r.sequence_id].append((r.offset, r.length))
    for own in places.values():
        own.sort()
        assert [o for o, _ in own] == list(np.cumsum([0] + [n for _, n in own[:-1]])) and sum(n for _, n in own) <= 2048
    return len(places)


def test_edge_documents(spark):
    rows = packing.pack(edge_docs(spark), PATH).collect()
    _check(rows, [(r[0], r[1]) for r in EDGE])
    assert packing.pack(no_docs(spark), PATH).count() == 0


def test_whole_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()
    rows = packing.query(spark, "/root/testdata/sf0.001").collect()
    used = _check(rows, [(r.doc_id, r.text) for r in docs])
    assert used <= -(-sum(r.length for r in rows) // 2048) * 1.02 + 1


def test_words_with_marks_and_line_ends_go_by_their_words(monkeypatch):
    """Only other chunks are searched for pieces; the ids stay those of the library."""
    lib, tok, asked = Tokenizer.from_file(PATH), packing.ChunkTokenizer(PATH), []
    encode = tok._encode
    monkeypatch.setattr(tok, "_encode", lambda texts: asked.extend(texts) or encode(texts))
    texts = ["Straße und Größe, naïve&&& ende.\nNeu. café ɏes!?", "one\ntwo\n three, it's a\tb x2", "Ω ǅ 中文, ſ º"]
    for _ in range(2):
        got = tok.encode(texts)
        assert [np.frombuffer(x, "<u4").tolist() for x in got] == [lib.encode(t, add_special_tokens=False).ids for t in texts]
    assert not {" Straße", "Straße", " Größe,", " Größe", " naïve&&&", " ende.\nNeu.", " ende."} & set(asked)


def test_a_workers_tokenizer_goes_when_another_operator_runs(spark):
    df = spark.range(0, 4, 1, 1).selectExpr("id AS doc_id", "concat('text number ', id) AS text")
    packing.tokenised_pieces(df, PATH, 2048, 0, "doc_id", "text").count()

    def left(batches):
        list(batches)
        yield pa.RecordBatch.from_arrays([pa.array([len(common.KEPT["packing"])])], ["n"])

    assert common.mapped(df, left, "n long", "packing").first().n == 1
    assert common.mapped(df, left, "n long").first().n == 0


def test_words_with_marks_are_put_together_once(monkeypatch):
    tok = packing.ChunkTokenizer(PATH)
    texts = ["one, two! three.\nfour?  no", "one, two! three.\nfour? é; ", "one,", None, ""]
    once = tok.encode(texts)
    monkeypatch.setattr(packing, "_WORDS", lambda c: 1 / 0)
    assert tok.encode(texts) == once
