"""Language identification by character language models.

One interpolated Kneser-Ney model of five characters per language, over lower-cased
words with their boundaries. All languages share sorted arrays of 64-bit n-gram keys,
with a column of log probabilities for each language, so one binary search finds an
n-gram for all of them. The prediction is the language of lowest cross-entropy per
character. The score is the softmax of those entropies at a temperature fitted on
sampled documents kept out of the counts, and the same documents set the entropy
above which a text counts as none of the languages (``rejected``).

Fitting takes a bounded sample of labelled rows, ``SAMPLE_DOCS`` per language in
expectation, chosen by a hash of the id. Scoring reads every text as a whole; a
bounded cache holds the scores of words.

Edge cases: a null text or one without a letter is ``und`` with score 0; rows without a
language or text teach nothing; without any training row every text is ``und``; ties go to
the language that sorts first; repeated rows each keep their row; an empty table gives no
rows; only the named columns are read, so clashing extra names do not matter. Of the
sample's characters the 4,094 most frequent have a symbol of their own and the others share
one; a language whose sampled rows would all be kept aside for calibration is learned
from them instead.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WordIndex, held_out, mapped, sums_by_text, table, text_batches

ORDER = 5
BITS = 12
SAMPLE_DOCS = 1500
#: Of the sampled documents, one in so many is kept out of the counts to calibrate.
CALIBRATE = 8
MAX_LANGS = 1000
UNKNOWN, EDGE = 0, 1


def letter_words(chunk: str) -> list[str]:
    low = chunk.lower()
    return [low] if low.isalpha() else "".join(c if c.isalpha() else " " for c in low).split()


def _grams(words: list[str], ids: dict[str, int]) -> tuple[np.ndarray, np.ndarray]:
    """Keys of the ORDER-grams of ``words`` (edges in front and behind), and each word's count."""
    text = "".join("\x00" * (ORDER - 1) + w + "\x00" for w in words)
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    distinct, inverse = np.unique(codes, return_inverse=True)
    own = np.array([EDGE if c == 0 else ids.get(chr(c), UNKNOWN) for c in distinct.tolist()], np.int64)[inverse]
    key = np.zeros(len(own) - ORDER + 1, np.int64)
    for k in range(ORDER):
        key = key << BITS | own[k:len(own) - ORDER + 1 + k]
    n = np.array([len(w) + 1 for w in words], np.int64)
    starts = np.cumsum(n + ORDER - 1) - (n + ORDER - 1)
    at = np.repeat(starts - (np.cumsum(n) - n), n) + np.arange(n.sum())
    return key[at], n


class CharModels:
    """``grams[k]``: sorted keys of k-grams and their log probabilities by language;
    ``contexts[k]``: sorted keys of the contexts of k-grams and their log back-off weights."""

    def __init__(self, langs: list[str], counts: dict[str, dict[int, int]], ids: dict[str, int]):
        self.langs, self.ids = langs, ids
        tables = [self._discounted(counts[x]) for x in langs]
        self.grams: list = [None] * (ORDER + 1)
        self.contexts: list = [None] * (ORDER + 1)
        self.floor = -np.log(max(len(ids), 1) + 2)
        for k in range(1, ORDER + 1):
            keys = np.unique(np.concatenate([t[k][0] for t in tables]))
            ctx = np.unique(np.concatenate([t[k][2] for t in tables]))
            weight = np.zeros((len(ctx), len(langs)))
            seen = np.full((len(keys), len(langs)), -np.inf)
            for j, t in enumerate(tables):
                own, p, own_ctx, w = t[k]
                seen[np.searchsorted(keys, own), j] = p
                weight[np.searchsorted(ctx, own_ctx), j] = w
            self.contexts[k] = (ctx, weight)
            self.grams[k] = None
            lower = self._log_probs(keys, k - 1) + self._weights(keys, k)
            self.grams[k] = (keys, np.logaddexp(seen, lower))

    @staticmethod
    def _discounted(counts: dict[int, int]):
        """By order: keys, log of the discounted share, contexts, log back-off weight.
        The top order has counts, lower ones the number of distinct left neighbours."""
        key = np.array(sorted(counts), np.int64)
        n = np.array([counts[x] for x in key.tolist()], np.float64)
        out: list = [None] * (ORDER + 1)
        for k in range(ORDER, 0, -1):
            n1, n2 = (n == 1).sum(), (n == 2).sum()
            d = min(max(n1 / (n1 + 2 * n2) if n1 else 0.5, 0.1), 0.95)
            ctx, where = np.unique(key >> BITS, return_inverse=True)
            total, kinds = np.bincount(where, n), np.bincount(where)
            out[k] = (key, np.log((n - d) / total[where]), ctx, np.log(d * kinds / total))
            key, n = np.unique(key & ((1 << BITS * (k - 1)) - 1), return_counts=True)
            n = n.astype(np.float64)
        return out

    def _weights(self, keys: np.ndarray, k: int) -> np.ndarray:
        ctx, weight = self.contexts[k]
        own = (keys & ((1 << BITS * k) - 1)) >> BITS
        i = np.minimum(np.searchsorted(ctx, own), len(ctx) - 1)
        return np.where((ctx[i] == own)[:, None], weight[i], 0.0)

    def _log_probs(self, keys: np.ndarray, k: int) -> np.ndarray:
        """Log probability of each key's last character after the k-1 before it."""
        p = np.full((len(keys), len(self.langs)), self.floor)
        for j in range(1, k + 1):
            own = keys & ((1 << BITS * j) - 1)
            known, table_ = self.grams[j]
            i = np.minimum(np.searchsorted(known, own), len(known) - 1)
            p = np.where((known[i] == own)[:, None], table_[i], p + self._weights(keys, j))
        return p

    def word_values(self, chunks: list[str]) -> np.ndarray:
        """Per chunk: log probability by language, then its number of characters with edges."""
        out = np.zeros((len(chunks), len(self.langs) + 1), np.float32)
        words, owner = [], []
        for i, c in enumerate(chunks):
            for w in letter_words(c):
                words.append(w)
                owner.append(i)
        if not words:
            return out
        keys, n = _grams(words, self.ids)
        distinct, inverse = np.unique(keys, return_inverse=True)
        p = self._log_probs(distinct, ORDER)[inverse]
        by_word = np.add.reduceat(p, np.cumsum(n) - n, axis=0)
        np.add.at(out, np.array(owner), np.column_stack([by_word, n]).astype(np.float32))
        return out


def _sample(df: DataFrame, per_lang: int) -> DataFrame:
    """About ``per_lang`` rows of each language, by a hash of the id."""
    sizes = {r._lang: r._n for r in df.groupBy("_lang").agg(F.count(F.lit(1)).alias("_n")).limit(MAX_LANGS + 1).collect()}
    if len(sizes) > MAX_LANGS:
        raise ValueError(f"more than {MAX_LANGS} languages")
    if not sizes:
        return df
    n = F.create_map(*[F.lit(x) for pair in sizes.items() for x in pair])[F.col("_lang")]
    share = F.pmod(F.xxhash64("_id", "_text"), F.lit(1 << 30)) / float(1 << 30)
    return df.where(share * n < per_lang)


def fit(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", sample_docs: int = SAMPLE_DOCS):
    """(models, temperature, entropy limits by language), or None without training rows."""
    rows = df.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"), F.col(lang_col).cast("string").alias("_lang")).where(
        F.col("_text").isNotNull() & F.col("_lang").isNotNull())
    part = _sample(rows, sample_docs).select("_lang", "_text", (F.pmod(F.xxhash64("_text"), F.lit(CALIBRATE)) == 0).alias("_aside"))
    # a language whose rows would all be kept aside gives them to the counts instead
    unseen = [r["_lang"] for r in part.groupBy("_lang").agg(F.count_if(~F.col("_aside")).alias("n")).where("n = 0").collect()]
    part = part.withColumn("_aside", F.col("_aside") & ~F.col("_lang").isin(unseen)) if unseen else part
    used = part.where(~F.col("_aside"))

    def count_words(batches):
        seen: dict[tuple, int] = {}
        for b in text_batches(batches, "_text"):
            for lang, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                for c in text.split():
                    for w in letter_words(c):
                        seen[lang, w] = seen.get((lang, w), 0) + 1
        rows_ = list(seen.items())
        for lo in range(0, len(rows_), 20_000):
            own = rows_[lo:lo + 20_000]
            yield pa.RecordBatch.from_arrays([pa.array([x[0][0] for x in own]), pa.array([x[0][1] for x in own]), pa.array([x[1] for x in own], pa.int64())], ["lang", "word", "n"])

    words = mapped(used.select("_lang", "_text"), count_words, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n"))
    got = words.toPandas()  # at most the distinct words of the bounded sample
    if got.empty:
        return None
    chars: dict[str, int] = {}
    for w, n in zip(got.word, got.n):
        for c in w:
            chars[c] = chars.get(c, 0) + n
    common = sorted(chars, key=lambda c: (-chars[c], c))[:(1 << BITS) - 2]
    ids = {c: i + 2 for i, c in enumerate(common)}
    counts: dict[str, dict[int, int]] = {}
    for lang, own in got.groupby("lang"):
        keys, n = _grams(own.word.tolist(), ids)
        distinct, inverse = np.unique(keys, return_inverse=True)
        counts[lang] = dict(zip(distinct.tolist(), np.bincount(inverse, np.repeat(own.n.to_numpy(), n)).astype(int).tolist()))
    models = CharModels(sorted(counts), counts, ids)
    aside = _scored(part.where("_aside").select(F.col("_lang").alias("_id"), "_text"), models, "string").toPandas()
    aside = aside[(aside.n > 0) & aside.lang.isin(models.langs)]  # a language may have had no letter
    temperature, limits = 20.0, {}
    if len(aside):
        per_char = np.vstack(aside.loglik.to_numpy()) / aside.n.to_numpy()[:, None]
        truth = np.searchsorted(models.langs, aside.lang.to_numpy().astype(str))
        def loss(t):
            z = per_char * t
            top = z.max(1)
            return (top + np.log(np.exp(z - top[:, None]).sum(1)) - z[np.arange(len(z)), np.minimum(truth, z.shape[1] - 1)]).mean()
        temperature = min((2.0, 5.0, 10.0, 20.0, 50.0), key=loss)
        for j, lang in enumerate(models.langs):
            own = -per_char[truth == j, j]
            if len(own) >= 20:
                limits[lang] = float(own.mean() + 6 * own.std() + 0.2)
    return models, temperature, limits


def _scored(docs: DataFrame, models: CharModels, kind: str) -> DataFrame:
    """(lang as passed in _id, loglik by language, n characters) of every text."""
    shared = docs.sparkSession.sparkContext.broadcast(models)

    def run(batches):
        words = WordIndex(shared.value.word_values)
        for b in text_batches(batches, "_text"):
            flat, ends = words(b.column(1).to_pylist())
            total = sums_by_text(words.table[flat], ends)
            k = total.shape[1] - 1
            ll = pa.ListArray.from_arrays(pa.array(np.arange(0, len(total) * k + 1, k), pa.int32()), pa.array(total[:, :k].ravel()))
            yield pa.RecordBatch.from_arrays([b.column(0), ll, pa.array(total[:, k].astype(np.int64))], ["lang", "loglik", "n"])

    return mapped(docs.select("_id", "_text"), run, f"lang {kind}, loglik array<double>, n long")


def identify(df: DataFrame, train: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """id, lang_pred, score, cross_entropy (nats per character) and ``rejected``."""
    fitted = fit(train, id_col, text_col, lang_col)
    src = df.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))
    kind = src.schema["_id"].dataType.simpleString()
    if fitted is None:
        return src.select(F.col("_id").alias(id_col), F.lit("und").alias("lang_pred"), F.lit(0.0).alias("score"),
                          F.lit(None).cast("double").alias("cross_entropy"), F.lit(True).alias("rejected"))
    models, temperature, limits = fitted
    z = F.transform("loglik", lambda x: x / F.col("n") * temperature)
    top = F.array_max(z)
    best = (F.array_position(z, top) - 1).cast("int")
    share = 1 / F.aggregate(z, F.lit(0.0), lambda a, x: a + F.exp(x - top))
    langs = F.array(*[F.lit(x) for x in models.langs])
    limit = F.array(*[F.lit(limits.get(x, float("inf"))) for x in models.langs])
    has = F.col("n") > 0
    entropy = F.when(has, -top / temperature)
    return _scored(src, models, kind).select(
        F.col("lang").alias(id_col), F.when(has, F.get(langs, best)).otherwise("und").alias("lang_pred"),
        F.when(has, share).otherwise(0.0).alias("score"), entropy.alias("cross_entropy"),
        F.when(has, entropy > F.get(limit, best)).otherwise(True).alias("rejected"))


def query(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents", "doc_id", "text", "lang")
    aside = held_out("doc_id", 4, 2)
    out = identify(docs, docs.where(~aside))
    return out.select("doc_id", aside.alias("held_out"), "lang_pred", "score", "rejected")
