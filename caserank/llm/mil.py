"""Quality classifier by attention-based multiple-instance learning.

A document is a bag of passages of 64 words. Each passage is encoded from statistics of
its words (kinds of characters, lengths, repetition) by a learned layer; gated
attention, learned from document labels alone, weights the passages; the weighted
representation is scored. So a junk passage inside a long document counts by what
the attention makes of it, not by its share of the words.

Fitting takes a bounded sample of labelled documents (``SAMPLE_DOCS`` in expectation, by
a hash of the id, and at most ``SAMPLE_PASSAGES`` evenly spaced passages of each). Their
passage statistics are computed by Spark; the small network is trained on them. Scoring
reads every text as a whole, passage by passage, in one pass without a shuffle.

Edge cases: a null or empty text is a bag of one empty passage and gets a score;
documents without a label, or with a null one, teach nothing; several labels of an id
count each; without labelled rows, or with one class only, every score is the share
of label 1 (0.5 without rows); repeated rows each keep their row; an empty table gives no
rows; of the tables only the id, text and label columns take part, so clashing extra names
do not matter.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WordIndex, held_out, mapped, table, text_batches

PASSAGE = 64
SAMPLE_DOCS, SAMPLE_PASSAGES = 8000, 64
HIDDEN, GATES, EPOCHS, BATCH, RATE = 16, 12, 30, 128, 0.01
_SYMBOLS = set("#*$%&|<>")


def _word_stats(words: list[str]) -> np.ndarray:
    """Per word: length, letters, capitals, digits, symbols, exclamations, other marks,
    first letter capital, all capitals, no letter, long (over 15), one or two characters."""
    out = np.zeros((len(words), 12), np.float32)
    for i, w in enumerate(words):
        n = len(w)
        letters = n if w.isalpha() else sum(map(str.isalpha, w))
        if letters == n and w.islower():
            out[i] = (n, n, 0, 0, 0, 0, 0, 0, 0, 0, n > 15, n <= 2)
            continue
        upper, digits = sum(map(str.isupper, w)), sum(map(str.isdigit, w))
        symbols, bang = sum(c in _SYMBOLS for c in w), w.count("!")
        out[i] = (n, letters, upper, digits, symbols, bang, max(0, n - letters - digits - symbols - bang), w[0].isupper(),
                  letters > 1 and upper == letters, letters == 0, n > 15, n <= 2)
    return out


N_FEATURES = 12 + 3


def passage_features(words: WordIndex, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """One row per passage, and each text's first passage (one more at the end)."""
    flat, ends = words(texts)
    n = np.diff(ends)
    count = np.maximum(1, -(-n // PASSAGE))
    first = np.concatenate(([0], np.cumsum(count)))
    out = np.zeros((int(first[-1]), N_FEATURES), np.float32)
    if len(flat):
        text = np.repeat(np.arange(len(n)), n)
        place = np.arange(len(flat)) - ends[:-1][text]
        passage = first[:-1][text] + place // PASSAGE
        starts = np.flatnonzero(np.diff(passage, prepend=-1))
        own = passage[starts]
        size = np.diff(np.append(starts, len(flat))).astype(np.float32)
        total = np.add.reduceat(words.table[flat], starts, axis=0)
        again = np.zeros(len(flat), np.float32)
        again[1:] = (flat[1:] == flat[:-1]) & (passage[1:] == passage[:-1])
        key = np.sort(passage.astype(np.int64) << 32 | flat)
        distinct = np.bincount(key[np.diff(key, prepend=-1) != 0] >> 32, minlength=len(out))[own]
        chars = np.maximum(total[:, :1], 1)
        out[own, 0] = np.log1p(chars[:, 0] / size) / 3
        out[own, 1:7] = total[:, 1:7] / chars
        out[own, 7:12] = total[:, 7:12] / size[:, None]
        out[own, 12] = np.add.reduceat(again, starts) / size
        out[own, 13] = distinct / size
        out[own, 14] = size / PASSAGE
    return out, first


class AttentionMIL:
    """Encoder, gated attention and scorer; trained by Adam with its own gradients."""

    NAMES = ("W", "b", "V", "U", "a", "s", "c")

    def __init__(self, seed: int = 7):
        r = np.random.default_rng(seed)
        g = lambda *shape: r.normal(0, 1 / np.sqrt(shape[0]), shape)
        self.mean, self.scale = np.zeros(N_FEATURES), np.ones(N_FEATURES)
        self.p = {"W": g(N_FEATURES, HIDDEN), "b": np.zeros(HIDDEN), "V": g(HIDDEN, GATES), "U": g(HIDDEN, GATES), "a": g(GATES, 1)[:, 0], "s": g(HIDDEN, 1)[:, 0], "c": np.zeros(1)}
        self.constant: float | None = None

    def forward(self, x: np.ndarray, first: np.ndarray):
        p, starts = self.p, first[:-1]
        h = np.tanh((x - self.mean) / self.scale @ p["W"] + p["b"])
        t, g = np.tanh(h @ p["V"]), 1 / (1 + np.exp(-np.clip(h @ p["U"], -30, 30)))
        e = (t * g) @ p["a"]
        bag = np.repeat(np.arange(len(starts)), np.diff(first))
        w = np.exp(e - np.maximum.reduceat(e, starts)[bag])
        w /= np.add.reduceat(w, starts)[bag]
        z = np.add.reduceat(w[:, None] * h, starts, axis=0)
        return 1 / (1 + np.exp(-np.clip(z @ p["s"] + p["c"], -30, 30))), (h, t, g, w, z, bag)

    def scores(self, x: np.ndarray, first: np.ndarray) -> np.ndarray:
        return np.full(len(first) - 1, self.constant) if self.constant is not None else self.forward(x, first)[0]

    def _gradients(self, x, first, y):
        p = self.p
        out, (h, t, g, w, z, bag) = self.forward(x, first)
        d = (out - y) / len(y)
        dz = d[:, None] * p["s"]
        de = w * ((dz[bag] * h).sum(1) - (dz * z).sum(1)[bag])
        dt, dg = de[:, None] * p["a"] * g * (1 - t ** 2), de[:, None] * p["a"] * t * g * (1 - g)
        dh = w[:, None] * dz[bag] + dt @ p["V"].T + dg @ p["U"].T
        dh *= 1 - h ** 2
        return {"W": ((x - self.mean) / self.scale).T @ dh, "b": dh.sum(0), "V": h.T @ dt, "U": h.T @ dg, "a": (t * g).T @ de, "s": z.T @ d, "c": d.sum(keepdims=True)}

    def train(self, bags: list[np.ndarray], y: np.ndarray, seed: int = 11) -> AttentionMIL:
        if len(bags) == 0 or len(set(y.tolist())) < 2:
            self.constant = float(y.mean()) if len(y) else 0.5
            return self
        everything = np.concatenate(bags)
        self.mean, self.scale = everything.mean(0), everything.std(0) + 0.02
        r = np.random.default_rng(seed)
        m = {k: np.zeros_like(v) for k, v in self.p.items()}
        v2 = {k: np.zeros_like(v) for k, v in self.p.items()}
        step = 0
        for epoch in range(EPOCHS):
            order = r.permutation(len(bags))
            for lo in range(0, len(order), BATCH):
                own = order[lo:lo + BATCH]
                x = np.concatenate([bags[i] for i in own])
                first = np.concatenate(([0], np.cumsum([len(bags[i]) for i in own])))
                step += 1
                for k, grad in self._gradients(x, first, y[own]).items():
                    grad = grad + 1e-4 * self.p[k]
                    m[k] += 0.1 * (grad - m[k])
                    v2[k] += 0.001 * (grad ** 2 - v2[k])
                    rate = RATE * (1 - epoch / EPOCHS) + 1e-4
                    self.p[k] = self.p[k] - rate * (m[k] / (1 - 0.9 ** step)) / (np.sqrt(v2[k] / (1 - 0.999 ** step)) + 1e-8)
        return self


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality",
        sample_docs: int = SAMPLE_DOCS) -> AttentionMIL:
    """Train on the labelled documents; ``labels``: id and a 0/1 label."""
    known = labels.select(F.col(id_col).alias("_id"), F.col(label_col).cast("double").alias("_y")).where(F.col("_y").isNotNull() & F.col("_id").isNotNull())
    n = known.count()
    if not n:
        return AttentionMIL().train([], np.array([]))
    share = F.pmod(F.xxhash64("_id"), F.lit(1 << 30)) / float(1 << 30)
    part = known.where(share * n < sample_docs)  # a bounded number of ids: the only side that is joined whole
    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text")).where(share * n < sample_docs).join(part, "_id").select("_y", "_text")

    def run(batches):
        words = WordIndex(_word_stats)
        for b in text_batches(batches, "_text"):
            x, first = passage_features(words, b.column(1).to_pylist())
            bags = []
            for lo, hi in zip(first, first[1:]):
                take = np.unique(np.linspace(lo, hi - 1, min(hi - lo, SAMPLE_PASSAGES)).astype(int))
                bags.append(x[take].astype(np.float32).tobytes())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(bags, pa.binary())], ["y", "bag"])

    got = mapped(rows, run, "y double, bag binary").toPandas()
    bags = [np.frombuffer(x, np.float32).reshape(-1, N_FEATURES).astype(np.float64) for x in got.bag]
    order = sorted(range(len(bags)), key=lambda i: (got.bag[i], got.y[i]))  # the same model however rows arrive
    return AttentionMIL().train([bags[i] for i in order], got.y.to_numpy()[order])


def score(docs: DataFrame, model: AttentionMIL, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id and score (0 to 1) of every row."""
    src = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))
    kind = src.schema["_id"].dataType.simpleString()

    def run(batches):
        words = WordIndex(_word_stats)
        for b in text_batches(batches, "_text"):
            x, first = passage_features(words, b.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(model.scores(x.astype(np.float64), first))], [id_col, "score"])

    return mapped(src, run, f"{id_col} {kind}, score double")


def accepted(docs: DataFrame, model: AttentionMIL, threshold: float, text_col: str = "text") -> DataFrame:
    """The rows, whole, whose score reaches ``threshold``: filtered where they are read."""
    at = docs.columns.index(text_col)

    def run(batches):
        words = WordIndex(_word_stats)
        for b in text_batches(batches, text_col):
            x, first = passage_features(words, b.column(at).to_pylist())
            yield b.filter(pa.array(model.scores(x.astype(np.float64), first) >= threshold))

    return mapped(docs, run, docs.schema)


#: A document is accepted from this score on.
THRESHOLD = 0.3


def train_default(docs: DataFrame, labels: DataFrame) -> AttentionMIL:
    """The model of ``quality`` labels; one document in five is left out of the fit."""
    return fit(docs, labels.where(~held_out("doc_id", 5, 0)))


def query(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    aside = held_out("doc_id", 5, 0)
    model = train_default(docs, table(spark, sf_dir, "labels", "doc_id", "quality"))
    return score(docs, model).select("doc_id", aside.alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
