import hashlib

import numpy as np
import public_tokenizers
from hypothesis import given, settings
from hypothesis import strategies as st
from llm_cases import EDGE, edge_docs, no_docs

from caserank.llm import bpe
from tokenizers import Tokenizer

PATH = public_tokenizers.path("word_bpe_49k.json")
LIB = Tokenizer.from_file(PATH)
OWN = bpe.PairIndexBPE(PATH)


def same(texts):
    for t, packed in zip(texts, OWN.encode(texts)):
        ids = np.frombuffer(packed, "<u4").tolist()
        want = LIB.encode(t or "", add_special_tokens=False).ids
        assert ids == want, t[:80]
        assert OWN.decode(ids) == LIB.decode(want, skip_special_tokens=False)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(alphabet=st.sampled_from("abcdelnorst the'sßéÉΣσ1２3!?#<|endoftext|> \n\x1c\u2003日e\u0301"), max_size=60), max_size=5))
def test_like_the_library(texts):
    same(texts)


@settings(max_examples=100, deadline=None)
@given(st.lists(st.text(alphabet="aab", max_size=40), max_size=4))
def test_overlapping_pairs(texts):
    same(texts)


def test_documents_like_the_library(spark):
    same([r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()])


def test_edge_documents(spark):
    rows = bpe.encode(edge_docs(spark), PATH).collect()
    got = sorted((str(r.doc_id), list(r.ids), r.decoded) for r in rows)
    want = [(str(i), LIB.encode(t or "", add_special_tokens=False).ids) for i, t, *_ in EDGE]
    assert got == sorted((i, ids, LIB.decode(ids, skip_special_tokens=False)) for i, ids in want)
    assert bpe.encode(no_docs(spark), PATH).count() == 0


def test_query_digests(spark):
    for r in bpe.query(spark, "/root/testdata/sf0.001").limit(20).join(spark.read.parquet("/root/testdata/sf0.001/documents.parquet"), "doc_id").collect():
        ids = LIB.encode(r.text, add_special_tokens=False).ids
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256(LIB.decode(ids, skip_special_tokens=False).encode()).hexdigest()
