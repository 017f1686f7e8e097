"""Filter interaction audit by decision diagrams.

Every document has a failure mask, one bit per filter. Per part (a language, a source)
the documents are counted by mask, and the counts become a decision diagram with one
level per filter: the two edges of a node are "passes" and "fails", equal subdiagrams
are one node, and a node's weight is the count of the documents below it. Filters
applied left to right keep what the path of "passes" edges leads to, so the weights on
that path are the documents kept after each step. One swap of two adjacent levels gives
the diagram of another order; a chain of such swaps visits every order.

Main path: one scan computes masks and a 128-bit text hash; a grouping finds each
repeated text's smallest id; counts by (part, mask, weights) are combined map-side, so a
part reaches its task as at most 2^filters times the weight patterns rows, whatever the
corpus size. A hot text is one row per task before the shuffle; the joins that bring a
text's smallest id and a document's labels back stand alone, so Spark can split their
hot partitions.

Edge cases: a null text is an empty one (zero words: fails A, passes B, C and D) and
equal to an empty text; a null part is the empty string; a null id is larger than every
id, and rows of one id are no earlier than each other, so repeated rows are judged alike
and each counts; several label rows of an id count as 1 if any has 1; an empty table
gives no rows; only the named columns are read, so clashing extra names do not matter.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence

import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import mapped, stored, table, text_batches

FILTERS = "ABCDE"
MIN_WORDS, MIN_DISTINCT_PERCENT, MAX_UPPER_PERCENT, SYMBOLS = 100, 80, 10, b"#$%&*|"
UPPER = bytes(range(ord("A"), ord("Z") + 1))
NULL_ID = (1 << 63) - 1


def text_failures(text: bytes, chars: int) -> int:
    """The bits of filters A to D that a text fails."""
    words = text.split()
    upper = len(text) - len(text.translate(None, UPPER))
    return ((len(words) < MIN_WORDS) | (100 * len(set(words)) < MIN_DISTINCT_PERCENT * len(words)) << 1
            | (100 * upper > MAX_UPPER_PERCENT * chars) << 2 | (len(text.translate(None, SYMBOLS)) < len(text)) << 3)


def failure_masks(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang") -> DataFrame:
    """``_id, part, mask``, one row per row: bits 0 to 3 as ``text_failures``, bit 4 where
    a smaller id has the same text. Written once, as two later steps read it."""
    def masks(batches):
        for b in text_batches(batches, "_text"):
            text = b.column(1)
            chars = pc.utf8_length(text).to_pylist()
            texts = text.cast(pa.binary()).to_pylist()
            yield pa.RecordBatch.from_arrays([
                b.column(0), b.column(2), pa.array([text_failures(t, n) for t, n in zip(texts, chars)], pa.int32()),
                pa.array([hashlib.blake2b(t, digest_size=16).digest() for t in texts], pa.binary()),
            ], ["_id", "part", "mask", "digest"])

    cols = [F.col(f"`{id_col}`").cast("long").alias("_id"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("_text"),
            F.coalesce(F.col(f"`{part_col}`").cast("string"), F.lit("")).alias("part")]
    rows = stored(mapped(df.select(*cols), masks, "_id long, part string, mask int, digest binary"), "audit-masks")
    order = F.coalesce("_id", F.lit(NULL_ID))
    first = rows.groupBy("digest").agg(F.min(order).alias("first"), F.max(order).alias("last")).where("first < last")
    # written, so that both sides of the join have an exchange of their own and a hot text can be split
    again = rows.join(stored(first.select("digest", "first"), "audit-first"), "digest", "left")
    later = F.coalesce(F.when(order > F.col("first"), F.lit(1 << 4)), F.lit(0))
    return again.select("_id", "part", (F.col("mask") + later).alias("mask"))


class MaskDiagram:
    """A count-weighted decision diagram of failure masks over ``n`` filters.

    Level k decides filter ``order[k]``. A node is a pair (child that passes, child that
    fails); the nodes below the last level are distinct weight vectors. Equal pairs of a
    level are one node."""

    def __init__(self, n: int, counts: dict[int, tuple[int, ...]], width: int):
        self.order = list(range(n))
        self.weights: list[tuple[int, ...]] = []
        self.pairs: list[tuple[int, int] | None] = []
        self.unique: list[dict] = [{} for _ in range(n + 1)]
        zero = (0,) * width
        # masks whose first filter is the most significant choice, built from the leaves up
        row = [self._leaf(counts.get(sum((j >> (n - 1 - k) & 1) << k for k in range(n)), zero)) for j in range(1 << n)]
        for level in reversed(range(n)):
            row = [self._node(level, row[j], row[j + 1]) for j in range(0, len(row), 2)]
        self.root = row[0]

    def _leaf(self, weight):
        return self._new(len(self.order), weight, None, weight)

    def _node(self, level: int, passes: int, fails: int) -> int:
        both = tuple(a + b for a, b in zip(self.weights[passes], self.weights[fails]))
        return self._new(level, (passes, fails), (passes, fails), both)

    def _new(self, level, key, pair, weight) -> int:
        at = self.unique[level].get(key)
        if at is None:
            at = self.unique[level][key] = len(self.pairs)
            self.pairs.append(pair)
            self.weights.append(weight)
        return at

    def swap(self, level: int) -> None:
        """Exchange the filters of ``level`` and ``level + 1``; nodes further down stay."""
        self.order[level], self.order[level + 1] = self.order[level + 1], self.order[level]
        before = self.unique[level]
        self.unique[level], self.unique[level + 1] = {}, {}
        new = {}
        for (p, f), at in before.items():
            (pp, pf), (fp, ff) = self.pairs[p], self.pairs[f]
            new[at] = self._node(level, self._node(level + 1, pp, fp), self._node(level + 1, pf, ff))
        for up in reversed(range(level)):
            upper, self.unique[up] = self.unique[up], {}
            new = {at: self._node(up, new[p], new[f]) for (p, f), at in upper.items()}
        self.root = new[self.root]

    def all_pass(self) -> list[tuple[int, ...]]:
        """Weights on the path of "passes" edges, from all documents to those that stay."""
        at, out = self.root, [self.weights[self.root]]
        for _ in self.order:
            at = self.pairs[at][0]
            out.append(self.weights[at])
        return out


def adjacent_swaps(n: int) -> Iterator[int]:
    """Levels to swap, one after the other, to visit all n! orders once each: the last
    item moves through every order of the others, forth and back."""
    if n < 2:
        return
    inner, down = adjacent_swaps(n - 1), True
    while True:
        yield from range(n - 2, -1, -1) if down else range(n - 1)
        at = next(inner, None)
        if at is None:
            return
        yield at + 1 if down else at  # the moving item is at the front after a way down
        down = not down


def audit_part(counts: dict[int, tuple[int, ...]], names: Sequence[str], width: int) -> pd.DataFrame:
    """One row per order and step: kept, removed, redundant, unique_fails, what the other
    weights lose (``lost_1``, ...), and the filter's removals over all orders (shapley)."""
    n = len(names)
    diagram = MaskDiagram(n, counts, width)
    rows, over, first, last = [], [0] * n, {}, {}
    swaps = adjacent_swaps(n)
    while True:
        path = diagram.all_pass()
        order = "".join(names[f] for f in diagram.order)
        for k, f in enumerate(diagram.order):
            lost = tuple(a - b for a, b in zip(path[k], path[k + 1]))
            rows.append((order, k + 1, f, path[k + 1][0], *lost))
            over[f] += lost[0]
            if k == 0:
                first[f] = lost[0]  # all that fail it
            if k == n - 1:
                last[f] = lost[0]  # those that nothing else removes
        at = next(swaps, None)
        if at is None:
            break
        diagram.swap(at)
    out = pd.DataFrame(rows, columns=["filter_order", "step", "_f", "kept", "removed", *[f"lost_{j}" for j in range(1, width)]])
    each = out.pop("_f")
    out["redundant"] = each.map(first) - out["removed"]
    out["unique_fails"] = each.map(last)
    out["shapley"] = each.map(dict(enumerate(over)))
    return out


def audit(masks: DataFrame, names: Sequence[str] = FILTERS, by: str = "part", weights: Sequence[str] = ()) -> DataFrame:
    """The audit of every part of ``masks`` (columns ``by``, mask and 0/1 columns
    ``weights``): ``by, filter_order, step, kept, removed, redundant, unique_fails,
    lost_1.. (by weight), shapley``."""
    weights = list(weights)
    sums = [F.count(F.lit(1)).alias("_n"), *[F.sum(F.col(f"`{w}`").cast("long")).alias(f"_w{j}") for j, w in enumerate(weights)]]
    counts = masks.groupBy(F.col(f"`{by}`").alias("part"), "mask").agg(*sums)
    value = ["_n", *[f"_w{j}" for j in range(len(weights))]]

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        table_ = {int(m): tuple(map(int, w)) for m, w in zip(pdf["mask"], pdf[value].to_numpy())}
        return audit_part(table_, names, len(value)).assign(part=pdf["part"].iloc[0])

    longs = ["kept", "removed", "redundant", "unique_fails", *[f"lost_{j}" for j in range(1, len(value))], "shapley"]
    schema = "part string, filter_order string, step int, " + ", ".join(f"{c} long" for c in longs)
    return counts.groupBy("part").applyInPandas(run, schema).withColumnRenamed("part", by)


def query(spark, sf_dir: str) -> DataFrame:
    masks = failure_masks(table(spark, sf_dir, "documents", "doc_id", "text", "lang"))
    flag = lambda c: F.max(F.when(F.col(c) == 1, 1).otherwise(0)).alias(c)
    labels = table(spark, sf_dir, "labels", "doc_id", "quality", "toxic").groupBy("doc_id").agg(flag("quality"), flag("toxic"))
    labels = stored(labels.where("doc_id is not null and quality + toxic > 0"), "audit-labels")
    rows = masks.join(labels, masks["_id"] == labels["doc_id"], "left")
    out = audit(rows.select("part", "mask", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("quality", "toxic")]), weights=["quality", "toxic"])
    return out.select("part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails",
                      F.col("lost_1").alias("good_lost"), F.col("lost_2").alias("toxic_lost"), "shapley")


ORACLE = r"""
WITH d AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t FROM documents),
w AS (SELECT *, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS ws FROM d),
l AS (SELECT doc_id, max((quality = 1)::INT) AS good, max((toxic = 1)::INT) AS toxic FROM labels GROUP BY doc_id),
f AS (SELECT w.part, coalesce(l.good, 0) AS good, coalesce(l.toxic, 0) AS toxic,
        (len(ws) < 100)::INT + 2 * (100 * len(list_distinct(ws)) < 80 * len(ws))::INT
        + 4 * (100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 10 * length(t))::INT
        + 8 * regexp_matches(t, '[#$%&*|]')::INT
        + 16 * (w.doc_id > min(w.doc_id) OVER (PARTITION BY t))::INT AS mask
      FROM w LEFT JOIN l ON l.doc_id = w.doc_id),
m AS (SELECT part, mask, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM f GROUP BY part, mask),
x AS (SELECT * FROM (VALUES ('A', 1), ('B', 2), ('C', 4), ('D', 8), ('E', 16)) v(c, bit)),
o AS (SELECT a.c || b.c || c.c || d.c || e.c AS filter_order, [a.bit, b.bit, c.bit, d.bit, e.bit] AS bits
      FROM x a, x b, x c, x d, x e WHERE a.bit + b.bit + c.bit + d.bit + e.bit = 31
      AND (a.bit | b.bit | c.bit | d.bit | e.bit) = 31),
s AS (SELECT filter_order, k AS step, bits[k] AS bit, coalesce(list_sum(bits[1:k - 1]), 0)::INT AS earlier
      FROM o, (SELECT unnest(range(1, 6)) AS k)),
r AS (SELECT part, filter_order, step, bit,
        sum(n) FILTER (mask & (earlier | bit) = 0) AS kept,
        sum(n) FILTER (mask & earlier = 0 AND mask & bit > 0) AS removed,
        sum(n) FILTER (mask & earlier > 0 AND mask & bit > 0) AS redundant,
        sum(n) FILTER (mask = bit) AS unique_fails,
        sum(good) FILTER (mask & earlier = 0 AND mask & bit > 0) AS good_lost,
        sum(toxic) FILTER (mask & earlier = 0 AND mask & bit > 0) AS toxic_lost
      FROM m, s GROUP BY part, filter_order, step, bit)
SELECT part, filter_order, step::INT AS step, coalesce(kept, 0)::BIGINT AS kept, coalesce(removed, 0)::BIGINT AS removed,
  coalesce(redundant, 0)::BIGINT AS redundant, coalesce(unique_fails, 0)::BIGINT AS unique_fails,
  coalesce(good_lost, 0)::BIGINT AS good_lost, coalesce(toxic_lost, 0)::BIGINT AS toxic_lost,
  coalesce(sum(removed) OVER (PARTITION BY part, bit), 0)::BIGINT AS shapley
FROM r
"""
