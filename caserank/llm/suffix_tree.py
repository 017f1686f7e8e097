"""Language-model scoring by a probabilistic suffix tree over words.

Contexts are the last one or two words before a token; the second word extends a context
of one. A context is kept when a divergence test passes: over its training
tokens, the left-out log likelihood under the context must beat that under its
shorter suffix by ``TAU`` nats in all (each token is scored as if it had not been
counted, so a context seen once, or whose followers look like its suffix's, fails).
Distributions are smoothed towards the suffix: P(w|s) = (c(s,w) + mu P(w|suffix)) /
(N(s) + mu), down to the add-one unigram model. A token's state is the longest kept suffix.

Work at scale: texts are cut into blocks of whole documents; a block holds word hashes.
What blocks need to know of the corpus (counts of words, of n-grams, gains of
contexts) goes through one exchange: each block sends each of its *distinct* 64-bit
keys once, with its own subtotal, to the bucket of the key; buckets add up and answer
every block that asked. A hot word, pair or passage is therefore one entry per block,
buckets are even by hash, and memory is bounded by the block and the bucket. Everything
is learned from all training documents; nothing is capped or sampled.

Edge cases: a null text is empty and has its end token only; a null id is never held
out; without training documents the base probability is 1/(V+1) with V = 0; repeated
rows count and are scored each; an empty table gives no rows; extra columns, however they
are named, are not read. Keys are 64-bit hashes.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import drop_stage, ship_package
from .common import WordIndex, held_out_py, mapped, mix64, stored, sums_by_text, table, text_batches, word_hashes, words_of

MU = (10.0, 2.0)
MIN_COUNT = 2
TAU = float(np.log(10))
BLOCK_BYTES = 6 << 20
END, START = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
_K = (np.uint64(0x9FB21C651E98DF25), np.uint64(0xA0761D6478BD642F))
WORDS, PAIRS, TRIPLES, GAIN1, GAIN2 = range(5)


def squeeze(a: np.ndarray) -> bytes:
    """Compressed bytes of an array, by byte planes (high bytes are mostly alike)."""
    a = np.ascontiguousarray(a)
    return a.dtype.str.encode() + b":" + zstandard.ZstdCompressor(level=3).compress(a.view(np.uint8).reshape(len(a), -1).T.tobytes() if len(a) else b"")


def unsqueeze(b: bytes) -> np.ndarray:
    kind, _, data = b.partition(b":")
    dtype = np.dtype(kind.decode())
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8)
    return np.ascontiguousarray(raw.reshape(dtype.itemsize, -1).T).reshape(-1).view(dtype)


def squeeze_sorted(keys: np.ndarray) -> bytes:
    return squeeze(np.diff(keys, prepend=np.uint64(0)))


def unsqueeze_sorted(b: bytes) -> np.ndarray:
    return np.cumsum(unsqueeze(b), dtype=np.uint64)


def _blocks(docs: DataFrame, modulus: int, remainder: int) -> DataFrame:
    """Blocks of whole documents: ids, held-out marks, lengths, vocabulary and codes."""
    def run(batches):
        words = WordIndex(word_hashes, words_of, 600_000)
        task, n = TaskContext.get().partitionId(), 0
        for b in text_batches(batches, "_text", BLOCK_BYTES):
            flat, ends = words(b.column(1).to_pylist())
            size = np.diff(ends)
            vocab, code = np.unique(words.table[flat], return_inverse=True) if len(flat) else (np.zeros(0, np.uint64), flat)
            held = np.array([held_out_py(i, modulus, remainder) for i in b.column(2).to_pylist()], bool)
            ids = pa.ListArray.from_arrays(pa.array([0, b.num_rows], pa.int32()), b.column(0))
            yield pa.RecordBatch.from_arrays(
                [pa.array([task << 32 | n]), ids, pa.array([squeeze(held)]), pa.array([squeeze(size.astype(np.int32))]), pa.array([squeeze_sorted(vocab)]),
                 pa.array([squeeze(code.astype(np.int32))]), pa.array([int((size + 1)[~held].sum())]), pa.array([int((~held).sum())])],
                ["block", "ids", "held", "sizes", "vocab", "codes", "train_tokens", "train_docs"])
            n += 1

    kind = docs.schema["_id"].dataType.simpleString()
    return mapped(docs, run, f"block long, ids array<{kind}>, held binary, sizes binary, vocab binary, codes binary, train_tokens long, train_docs long")


class Block:
    """A block's tokens (words, then one end for each document) and their keys."""

    def __init__(self, row: dict):
        self.id, self.held = row["block"], unsqueeze(row["held"])
        size = unsqueeze(row["sizes"]).astype(np.int64)
        vocab, code = unsqueeze_sorted(row["vocab"]), unsqueeze(row["codes"])
        self.n = size + 1
        self.ends = np.concatenate(([0], np.cumsum(self.n)))
        w = np.full(int(self.ends[-1]), END, np.uint64)
        is_word = np.ones(len(w), bool)
        is_word[self.ends[1:] - 1] = False
        w[is_word] = vocab[code] if len(code) else 0
        self.train = np.repeat(~self.held, self.n)
        before = np.empty_like(w)
        before[1:] = w[:-1]
        before[self.ends[:-1]] = START
        self.first = np.zeros(len(w), bool)
        self.first[self.ends[:-1]] = True
        self.before = before
        self.w = w
        self.words, self.of_word = np.unique(w, return_inverse=True)
        self._pairs()

    def _pairs(self):
        self.pair = mix64(self.before * _K[0] + self.w)
        self.pairs, self.of_pair = np.unique(self.pair, return_inverse=True)

    def local(self, which: np.ndarray, n: int) -> np.ndarray:
        return np.bincount(which[self.train], minlength=n).astype(np.int32)


def _messages(block: int, kind: int, keys: np.ndarray, values: np.ndarray, buckets: int):
    """One row per non-empty bucket; keys ascend, so buckets are runs."""
    if not len(keys):
        return
    bucket = ((keys >> np.uint64(40)) * np.uint64(buckets) >> np.uint64(24)).astype(np.int64)
    cuts = np.concatenate(([0], np.flatnonzero(np.diff(bucket)) + 1, [len(keys)]))
    for lo, hi in zip(cuts.tolist(), cuts[1:].tolist()):
        yield kind, int(bucket[lo]), block, squeeze_sorted(keys[lo:hi]), squeeze(values[lo:hi])


_MESSAGE = "kind int, bucket int, block long, keys binary, vals binary"
_ANSWER = "kind int, bucket int, block long, vals binary, known long"


def _as_table(rows, schema: str) -> pa.Table:
    kinds = {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary()}
    fields = [pa.field(n, kinds[t]) for n, t in (x.split() for x in schema.split(", "))]
    cols = list(zip(*rows)) or [()] * len(fields)
    return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(cols, fields)], schema=pa.schema(fields))


def _add_up(t: pa.Table) -> pa.Table:
    """A bucket: total of every key, answered to every block in the order it sent them."""
    rows = sorted(zip(t["block"].to_pylist(), t["keys"].to_pylist(), t["vals"].to_pylist()))
    kind, bucket = t["kind"][0].as_py(), t["bucket"][0].as_py()
    keys = [unsqueeze_sorted(k) for _, k, _ in rows]
    distinct, where = np.unique(np.concatenate(keys), return_inverse=True)
    values = np.concatenate([unsqueeze(v) for _, _, v in rows])
    total = np.bincount(where, values, len(distinct))
    total = total.astype(np.int64) if kind in (WORDS, PAIRS, TRIPLES) else total.astype(np.float32)
    if kind in (WORDS, PAIRS, TRIPLES) and (not len(total) or total.max() < 1 << 31):
        total = total.astype(np.int32)
    back, cuts = total[where], np.cumsum([0] + [len(k) for k in keys]).tolist()
    out = [(kind, bucket, r[0], squeeze(back[lo:hi]), 0) for r, lo, hi in zip(rows, cuts, cuts[1:])]
    if kind == WORDS:
        out.append((kind, bucket, -1, b"", int((total > 0).sum())))
    return _as_table(out, _ANSWER)


class Answers:
    """Totals by kind, in the order of the block's sorted keys."""

    def __init__(self, t: pa.Table):
        self.of: dict[int, list] = {}
        for kind, bucket, vals in sorted(zip(t["kind"].to_pylist(), t["bucket"].to_pylist(), t["vals"].to_pylist())):
            self.of.setdefault(kind, []).append(unsqueeze(vals))

    def __getitem__(self, kind: int) -> np.ndarray:
        return np.concatenate(self.of[kind]) if kind in self.of else np.zeros(0)


class Scorer:
    """Probabilities of a block's tokens, as far as the answers reach."""

    def __init__(self, block: Block, got: Answers, total: int, known: int, docs: int):
        self.b, self.got, self.total, self.known, self.docs = block, got, total, known, docs
        c1 = got[WORDS].astype(np.float64)
        self.c1 = c1[block.of_word]
        self.c2 = got[PAIRS].astype(np.float64)[block.of_pair]
        # a context is as frequent as its words in a row: every word is followed by a token
        before = np.empty_like(self.c1)
        before[1:] = self.c1[:-1]
        before[block.first] = docs
        self.n1 = before
        n2 = np.zeros_like(self.c1)
        n2[1:] = self.c2[:-1]
        n2[block.first] = 0  # a document's start has no second word before it
        self.n2 = n2
        self.asked = np.flatnonzero(n2 >= MIN_COUNT)
        self._c3 = None

    def p0(self, out: int) -> np.ndarray:
        return np.maximum(self.c1 + 1 - out, 1) / max(self.total + self.known + 1 - out, 1)

    def p1(self, out: int) -> np.ndarray:
        return (np.maximum(self.c2 - out, 0) + MU[0] * self.p0(out)) / (np.maximum(self.n1 - out, 0) + MU[0])

    # contexts of one word: keys are words, and the start
    def contexts1(self):
        return np.unique(self.b.before, return_inverse=True)

    def triples(self):
        b, at = self.b, self.asked
        key = mix64(b.pair[at - 1] * _K[1] + b.w[at])
        return np.unique(key, return_inverse=True)

    def c3(self) -> np.ndarray:
        if self._c3 is None:
            self._c3 = self.got[TRIPLES].astype(np.float64)[self.triples()[1]]
        return self._c3

    def open2(self) -> np.ndarray:
        """Which of the asked places have a context of two words that may be kept. One seen
        twice before different tokens has lost at both, so nobody needs to ask for it."""
        return ~((self.n2[self.asked] == 2) & (self.c3() == 1))

    def contexts2(self):
        return np.unique(self.b.pair[self.asked[self.open2()] - 1], return_inverse=True)

    def gains1(self):
        keys, of = self.contexts1()
        gain = np.log(self.p1(1)) - np.log(self.p0(1))
        t = self.b.train & (self.n1 >= MIN_COUNT)
        return keys, np.bincount(of[t], gain[t], len(keys)).astype(np.float32)

    def parents(self, out: int) -> np.ndarray:
        """Probability in the longest kept context of at most one word."""
        keys, of = self.contexts1()
        kept = (self.got[GAIN1] > TAU)[of] & (self.n1 >= MIN_COUNT)
        return np.where(kept, self.p1(out), self.p0(out))

    def p2(self, out: int, parent: np.ndarray) -> np.ndarray:
        at = self.asked
        return (np.maximum(self.c3() - out, 0) + MU[1] * parent[at]) / (np.maximum(self.n2[at] - out, 0) + MU[1])

    def gains2(self):
        keys, of = self.contexts2()
        parent, some = self.parents(1), self.open2()
        gain = (np.log(self.p2(1, parent)) - np.log(parent[self.asked]))[some]
        t = self.b.train[self.asked[some]]
        return keys, np.bincount(of[t], gain[t], len(keys)).astype(np.float32)

    def log10(self) -> np.ndarray:
        p = self.parents(0)
        if len(self.asked):
            kept = self.open2()
            kept[kept] = (self.got[GAIN2] > TAU)[self.contexts2()[1]]
            p[self.asked] = np.where(kept, self.p2(0, p), p[self.asked])
        return np.log10(p)


def score(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", modulus: int = 7, remainder: int = 2) -> DataFrame:
    """id, held_out, n_tokens, n_known, train_tokens, base_score, score for every row."""
    src = df.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"), F.col(id_col).cast("string").alias("_name"))
    ship_package(df.sparkSession)
    blocks = stored(_blocks(src, modulus, remainder), "pst-blocks")
    sums = blocks.agg(F.count(F.lit(1)).alias("n"), F.sum("train_tokens").alias("t"), F.sum("train_docs").alias("d")).first()
    total, docs, buckets = sums["t"] or 0, sums["d"] or 0, max(8, sums["n"] // 2)
    data = blocks.select("block", "held", "sizes", "vocab", "codes")
    kind = src.schema["_id"].dataType.simpleString()

    def answered(messages: DataFrame, name: str) -> DataFrame:
        return stored(messages.groupBy("kind", "bucket").applyInArrow(_add_up, _ANSWER), name)

    def first(batches):
        for batch in batches:
            for row in batch.to_pylist():
                b = Block(row)
                yield from _as_table([*_messages(b.id, WORDS, b.words, b.local(b.of_word, len(b.words)), buckets),
                                      *_messages(b.id, PAIRS, b.pairs, b.local(b.of_pair, len(b.pairs)), buckets)], _MESSAGE).to_batches()

    answers = answered(data.mapInArrow(first, _MESSAGE), "pst-counts")
    known = answers.agg(F.sum("known")).first()[0] or 0

    def scorer(left: pa.Table, right: pa.Table) -> Scorer:
        return Scorer(Block(left.to_pylist()[0]), Answers(right), total, known, docs)

    def second(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows:
            return _as_table([], _MESSAGE)
        s = scorer(left, right)
        keys, of = s.triples()
        t = s.b.train[s.asked]
        return _as_table([*_messages(s.b.id, TRIPLES, keys, np.bincount(of[t], minlength=len(keys)).astype(np.int32), buckets),
                          *_messages(s.b.id, GAIN1, *s.gains1(), buckets)], _MESSAGE)

    def third(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows:
            return _as_table([], _MESSAGE)
        s = scorer(left, right)
        return _as_table(_messages(s.b.id, GAIN2, *s.gains2(), buckets), _MESSAGE)

    def last(left: pa.Table, right: pa.Table) -> pa.Table:
        ids = left["ids"].combine_chunks().flatten() if left.num_rows else None
        if ids is None:
            return pa.table({"_id": pa.nulls(0), "held_out": pa.array([], pa.bool_()), "n_tokens": pa.array([], pa.int64()), "n_known": pa.array([], pa.int64()),
                             "base_score": pa.array([], pa.float64()), "score": pa.array([], pa.float64())})
        s = scorer(left.drop_columns(["ids"]), right)
        base = np.log10((s.c1 + 1) / (total + known + 1))
        return pa.table({"_id": ids, "held_out": pa.array(s.b.held), "n_tokens": pa.array(s.b.n),
                         "n_known": pa.array(sums_by_text((s.c1 > 0).astype(np.int64), s.b.ends).astype(np.int64)),
                         "base_score": pa.array(sums_by_text(base, s.b.ends)), "score": pa.array(sums_by_text(s.log10(), s.b.ends))})

    def with_answers(fn, schema: str, left: DataFrame = data) -> DataFrame:
        asked = answers.where("block >= 0").select("block", "kind", "bucket", "vals")
        return left.groupBy("block").cogroup(asked.groupBy("block")).applyInArrow(fn, schema)

    answers = answers.unionByName(answered(with_answers(second, _MESSAGE), "pst-triples"))
    # written first, so that the shuffle files of asking and of adding up are not there at once
    gains = stored(with_answers(third, _MESSAGE), "pst-gain-parts")
    answers = answers.unionByName(answered(gains, "pst-gains"))
    drop_stage(gains)
    out = with_answers(last, f"_id {kind}, held_out boolean, n_tokens long, n_known long, base_score double, score double",
                       blocks.select("block", "ids", "held", "sizes", "vocab", "codes"))
    return out.select(F.col("_id").alias(id_col), "held_out", "n_tokens", "n_known", F.lit(total).cast("long").alias("train_tokens"), "base_score", "score")


def query(spark, sf_dir: str) -> DataFrame:
    return score(table(spark, sf_dir, "documents", "doc_id", "text"))
