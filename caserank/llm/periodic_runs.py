"""Periodic runs of words by maximal-pair enumeration.

A run is a stretch of words with smallest period q, at least ``min_length`` words and
``exponent`` periods long, that neither neighbour extends at that period. Two places
i < j of a text form a maximal pair of length l if the l words from i and from j are
equal, the words before them differ and so do the words after them. The stretch from i
to j + l then has period q = j - i and cannot be extended, so the maximal pairs whose
distance satisfies (exponent - 1) * q <= l and q + l >= min_length are exactly the runs,
at each multiple of the smallest period that still satisfies it; of the pairs of one
stretch the smallest distance stays.

The pairs come from the suffix array of a text's words: its LCP intervals are visited
bottom-up, and each keeps its places in sorted lists by the word to their left. Joining
a child to its interval looks up, for each place of the smaller one, the places of the
other whose left word differs and whose distance is in the allowed range. Nothing is
enumerated that is no run, and nothing inside a run is compared again, since there all
left words agree. Only intervals with an LCP of at least ``least_lcp`` words can hold a
run; a text without a repeated stretch of so many words has none and is not sorted.

Each text is handled where it is: no shuffle, memory bounded by a batch of texts.

Edge cases: a null text is an empty one: no words, no runs, an empty collapsed text; a
text of any length is read whole; repeated rows each keep their row; an empty table
gives no rows; only the id and text columns are read, so clashing extra names do not
matter. Ties between runs are the caller's (the query takes the smallest start, then the
smallest period).
"""

from __future__ import annotations

import itertools
import zlib
from bisect import bisect_left, bisect_right
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import mapped, table, text_batches

MIN_LENGTH, EXPONENT = 24, 3
RUNS = "array<struct<start:long,length:long,period:long>>"


def least_lcp(min_length: int, exponent: int) -> int:
    """The shortest maximal pair that can be a run, over all periods."""
    return min(max(min_length - q, (exponent - 1) * q, 1) for q in range(1, max(2, min_length)))


def suffix_order(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Suffixes of a word sequence in order, and each one's rank, by prefix doubling."""
    n = len(ids)
    rank = np.unique(ids, return_inverse=True)[1].astype(np.int64)
    width = 1
    while True:
        second = np.zeros(n, np.int64)
        second[:n - width] = rank[width:] + 1
        key = rank * (n + 1) + second
        order = np.argsort(key, kind="stable")
        ordered = key[order]
        rank[order] = np.concatenate(([0], np.cumsum(ordered[1:] != ordered[:-1])))
        width *= 2
        if width >= n or rank[order[-1]] == n - 1:
            return order, rank


def lcp_array(ids: list[int], order: list[int], rank: list[int]) -> list[int]:
    """Words that each suffix shares with the one before it in order."""
    n, common = len(ids), 0
    out = [0] * n
    for i in range(n):
        if not rank[i]:
            common = 0
            continue
        j = order[rank[i] - 1]
        while i + common < n and j + common < n and ids[i + common] == ids[j + common]:
            common += 1
        out[rank[i]] = common
        common = max(0, common - 1)
    return out


class Places:
    """Places of a suffix interval, sorted, in one list per word to their left."""

    __slots__ = ("by_left", "size")

    def __init__(self, left: int, place: int):
        self.by_left, self.size = {left: [place]}, 1

    def take(self, other: Places) -> None:
        for left, places in other.by_left.items():
            own = self.by_left.setdefault(left, [])
            own += places
            own.sort()  # two sorted runs: a merge
        self.size += other.size


def maximal_pairs(ids: np.ndarray, min_length: int, exponent: int):
    """(place, distance, length) of the maximal pairs that are runs, in no order."""
    order, rank = suffix_order(ids)
    words, order = ids.tolist(), order.tolist()
    lcp = lcp_array(words, order, rank.tolist())
    floor = least_lcp(min_length, exponent)
    stack: list[tuple[int, Places]] = []

    def join(length: int, a: Places, b: Places):
        if a.size < b.size:
            a, b = b, a
        near, far = max(1, min_length - length), length // (exponent - 1)
        if near <= far:
            for left, places in b.by_left.items():
                for other, theirs in a.by_left.items():
                    if other == left:
                        continue
                    for p in places:
                        for x in theirs[bisect_left(theirs, p - far):bisect_right(theirs, p - near)]:
                            yield x, p - x, length
                        for x in theirs[bisect_left(theirs, p + near):bisect_right(theirs, p + far)]:
                            yield p, x - p, length
        a.take(b)
        return a

    for k, place in enumerate(order):
        now = Places(words[place - 1] if place else -1, place)
        below = lcp[k + 1] if k + 1 < len(order) else 0
        while stack and stack[-1][0] > below:
            length, inner = stack.pop()
            now = yield from join(length, inner, now)
        if below < floor:
            continue  # nothing on the stack is as short
        if stack and stack[-1][0] == below:
            _, inner = stack.pop()
            now = yield from join(below, inner, now)
        stack.append((below, now))


def runs_of(ids: np.ndarray, min_length: int = MIN_LENGTH, exponent: int = EXPONENT) -> list[tuple[int, int, int]]:
    """(start, length, period) of every run, by start, then period."""
    least: dict[tuple[int, int], int] = {}
    for place, distance, length in maximal_pairs(ids, min_length, exponent):
        stretch = (place, distance + length)
        least[stretch] = min(distance, least.get(stretch, distance))
    return sorted(((start, length, period) for (start, length), period in least.items()), key=lambda r: (r[0], r[2]))


def repeating(ids: np.ndarray, ends: np.ndarray, width: int) -> np.ndarray:
    """Numbers of the texts in which some stretch of ``width`` words occurs twice. Stretches
    are compared by a 64-bit hash, so a text may be named in error but none is missed."""
    text = np.repeat(np.arange(len(ends) - 1), np.diff(ends))
    h, done, multiplier = ids.astype(np.uint64) + np.uint64(1), 1, np.uint64(0x9E3779B97F4A7C15)
    while done < width:
        step = min(done, width - done)  # overlapping halves name a stretch as well
        if len(h) <= step:
            return np.empty(0, np.int64)
        mixed = h * multiplier
        mixed ^= mixed >> np.uint64(29)
        h = mixed[:-step] * multiplier + h[step:]
        done += step
    inside = text[:len(h)] == text[width - 1:width - 1 + len(h)]
    h, text = h[inside], text[:len(h)][inside]
    h = (h ^ (h >> np.uint64(31))) * multiplier + text.astype(np.uint64)
    order = np.argsort(h)
    same = h[order][1:] == h[order][:-1]
    return np.unique(text[order[1:][same]])


def periodic_runs(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_length: int = MIN_LENGTH, exponent: int = EXPONENT,
                  prepare: Callable[[object, int], np.ndarray | None] | None = None) -> DataFrame:
    """id, n_words, runs (array of start, length, period) and collapsed: the words, one
    space between, without those that a run holds after its first period. ``prepare(id,
    n_words)`` may name, by number, the words to take instead of a text's own."""
    schema = f"_id {df.schema[id_col].dataType.simpleString()}, n_words long, runs {RUNS}, collapsed string"
    floor = least_lcp(min_length, exponent)
    run_type = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))

    def find(batches):
        for b in text_batches(batches, "_text"):
            words = [t.split() for t in b.column(1).cast(pa.binary()).to_pylist()]
            if prepare:
                for k, (i, w) in enumerate(zip(b.column(0).to_pylist(), words)):
                    if (take := prepare(i, len(w))) is not None:
                        words[k] = [w[x] for x in take.tolist()]
            ends = np.concatenate(([0], np.cumsum([len(w) for w in words]))).astype(np.int64)
            number: dict[bytes, int] = {}
            ids = np.fromiter((number.setdefault(w, len(number)) for w in itertools.chain.from_iterable(words)), np.int64, int(ends[-1]))
            runs: list[list] = [[] for _ in words]
            for k in repeating(ids, ends, floor).tolist():
                runs[k] = runs_of(ids[ends[k]:ends[k + 1]], min_length, exponent)
                stay = np.ones(len(words[k]), bool)
                for start, length, period in runs[k]:
                    stay[start + period:start + length] = False
                if runs[k]:
                    words[k] = list(itertools.compress(words[k], stay.tolist()))
            yield pa.RecordBatch.from_arrays([
                b.column(0), pa.array(np.diff(ends), pa.int64()),
                pa.array([[dict(zip(("start", "length", "period"), r)) for r in rs] for rs in runs], run_type),
                pa.array([b" ".join(w) for w in words], pa.binary()).cast(pa.string()),
            ], ["_id", "n_words", "runs", "collapsed"])

    rows = df.select(F.col(f"`{id_col}`").alias("_id"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("_text"))
    return mapped(rows, find, schema).withColumnRenamed("_id", id_col)


def planted(doc_id, n: int) -> np.ndarray | None:
    """The contract's repeats: in one id of ten, words from a place on follow a period."""
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    if h % 10 or not n:
        return None
    g = h // 10
    a = g % n
    at = np.arange(n)
    at[a:] = a + (at[a:] - a) % (1 + (n - a) // (3 + g % 8))
    return at


def by_exponent(a: Column, b: Column) -> Column:
    """Order of two runs: larger length/period first, then start, then period."""
    left, right = a["length"] * b["period"], b["length"] * a["period"]
    return (F.when(left != right, F.when(left > right, -1).otherwise(1))
            .when(a["start"] != b["start"], F.when(a["start"] < b["start"], -1).otherwise(1))
            .otherwise(F.when(a["period"] < b["period"], -1).when(a["period"] > b["period"], 1).otherwise(0)))


def query(spark, sf_dir: str) -> DataFrame:
    found = periodic_runs(table(spark, sf_dir, "documents", "doc_id", "text"), prepare=planted)
    found = found.withColumn("best", F.get(F.array_sort("runs", by_exponent), F.lit(0)))
    lines = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n")))
    return found.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), "best.start", "best.length", "best.period",
        F.expr("1000 * best.length div best.period").alias("exponent_milli"),
        F.sha2(F.concat_ws("", lines), 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"), "n_words")
