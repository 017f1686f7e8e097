"""Exact top-k inner-product search over an impact-ordered, score-at-a-time index.

Vectors are integers (floor(scale * x)). The index cuts the candidates into blocks;
each block holds postings (row, dimension, value) in segments of equal *quantised
impact* (the leading bits of |value|), largest first. A query block reads a block's
segments in that order and adds quantised contributions to its accumulators. What the
unread segments and the cut-off bits can still add is bounded for each query and
row (Hoelder with the impact limit, Cauchy-Schwarz with the row's unread norm). Reading
stops only when those bounds prove that no more than a few rows can still enter the top
k, or when no segment is left; every possible member is then rescored exactly in
integers. Results are exact: nothing is dropped without proof. A query's own rows,
however many a block holds, are left out before the proof.

Plan: candidate blocks are replicated once per query block (a stated query set against
all rows), dealt by (query block, salt) so that no task holds more than a few candidate
blocks; each task keeps a running top k per query, and one window merges them.

Edge cases: vectors that are null, empty or hold null or non-finite components take no
part, nor do rows without an id; a query meets only vectors of its own length; rows
that repeat an id are candidates for other queries, and a repeated query id is answered
once (from its smallest vector); ties go to the smaller id; an empty table gives no rows;
only the id and vector columns are read, so clashing extra names do not matter.
"""

from __future__ import annotations

import heapq
import itertools

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import mapped, stored, table

BLOCK = 4096
QUERY_BLOCK = 1024
BLOCKS_PER_TASK = 4
IMPACT_BITS = 8


def _int_vectors(df: DataFrame, id_col: str, vec_col: str, scale: int) -> DataFrame:
    v = F.col(vec_col)
    fine = F.col(id_col).isNotNull() & v.isNotNull() & (F.size(v) > 0) & ~F.exists(
        v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return df.select(F.col(id_col).cast("long").alias("id"), F.when(fine, F.transform(v, lambda x: F.floor(x.cast("double") * scale))).alias("v")).where("v is not null")


def _packed(vectors: DataFrame, size: int) -> DataFrame:
    """Blocks of at most ``size`` vectors of one length, filled as rows stream by."""
    def pack(batches):
        open_, task, n = {}, TaskContext.get().partitionId(), itertools.count()

        def block(dim):
            ids, vs = open_.pop(dim)
            return pa.RecordBatch.from_arrays([pa.array([task << 32 | next(n)]), pa.array([dim], pa.int32()), pa.array([len(ids)], pa.int32()),
                                               pa.array([np.array(ids, np.int64).tobytes()]), pa.array([np.array(vs, np.int64).tobytes()])],
                                              ["block", "dim", "n", "ids", "vals"])

        for b in batches:
            for i, v in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                ids, vs = open_.setdefault(len(v), ([], []))
                ids.append(i)
                vs.append(v)
                if len(ids) == size:
                    yield block(len(v))
        for dim in list(open_):
            yield block(dim)

    return mapped(vectors, pack, "block long, dim int, n int, ids binary, vals binary")


class ImpactBlock:
    """Postings of a block, sorted by descending quantised impact, with segment offsets."""

    def __init__(self, values: np.ndarray):
        n, dim = values.shape
        self.shape, self.values = (n, dim), values
        mags = np.abs(values).ravel()
        top = int(mags.max(initial=0))
        self.shift = max(0, top.bit_length() - IMPACT_BITS)
        impact = mags >> self.shift
        # segments: impacts within a factor of two are read together
        self.tier = np.zeros(len(impact), np.int8)
        nz = impact > 0
        self.tier[nz] = np.floor(np.log2(impact[nz])).astype(np.int8) + 1
        order = np.argsort(-impact, kind="stable")
        order = order[impact[order] > 0]
        self.at, tiers = order, self.tier[order]
        self.levels = [int(t) for t in np.unique(tiers)[::-1]]
        self.cuts = np.searchsorted(-tiers, [-t for t in self.levels] + [1])
        self.quantised = (np.sign(values).ravel() * (impact << self.shift)).astype(np.float64)
        # norm of what is unread after each segment, quantisation remainders included
        self.rest = []
        left = values.astype(np.float64).ravel().copy()
        for j in range(len(self.levels)):
            part = order[self.cuts[j]:self.cuts[j + 1]]
            left[part] -= self.quantised[part]
            self.rest.append(np.sqrt((left.reshape(n, dim) ** 2).sum(1)) * (1 + 1e-9) + 1e-6)

    def segment(self, j: int) -> np.ndarray:
        m = np.zeros(self.shape[0] * self.shape[1])
        part = self.at[self.cuts[j]:self.cuts[j + 1]]
        m[part] = self.quantised[part]
        return m.reshape(self.shape)

    def limit(self, j: int) -> int:
        """The largest possible |value - read value| after segment ``j``."""
        unread = (1 << (self.levels[j] - 1)) << self.shift if self.levels[j] > 1 else 1 << self.shift
        return unread - 1 if self.levels[j] > 1 or self.shift else 0

    def candidates(self, queries: np.ndarray, least: np.ndarray, k: int, own: np.ndarray | None = None):
        """(query, row) pairs that may reach the top k; ``least``: scores already reached;
        ``own``: (query, row) pairs that take no part, neither as members nor in the proof."""
        n = self.shape[0]
        q = queries.astype(np.float64)
        acc = np.zeros((len(q), n))
        l1, l2 = np.abs(q).sum(1), np.sqrt((q ** 2).sum(1)) * (1 + 1e-9)
        if own is None:
            own = np.zeros(acc.shape, bool)
        if not self.levels:
            return np.nonzero((least <= 0)[:, None] & ~own)
        for j in range(len(self.levels)):
            acc += q @ self.segment(j).T
            last = j == len(self.levels) - 1
            if not last and j < 1:
                continue
            bound = np.minimum((l1 * self.limit(j))[:, None], l2[:, None] * self.rest[j][None, :])
            low = np.where(own, -np.inf, acc - bound)
            need = least
            if n >= k:
                need = np.maximum(least, np.partition(low, n - k, axis=1)[:, n - k])
            may = (acc + bound >= need[:, None]) & ~own
            if last or may.sum() <= 4 * k * len(q):
                return np.nonzero(may)
        raise AssertionError


def _search(k: int):
    def run(batches):
        best: dict = {}
        for b in batches:
            for r in b.to_pylist():
                dim = r["dim"]
                ids, vals = np.frombuffer(r["ids"], np.int64), np.frombuffer(r["vals"], np.int64).reshape(-1, dim)
                qids, qv = np.frombuffer(r["qids"], np.int64), np.frombuffer(r["qvals"], np.int64).reshape(-1, dim)
                block = ImpactBlock(vals)
                biggest = int(np.abs(vals).max(initial=0)) * int(np.abs(qv).max(initial=0)) * dim
                for lo in range(0, len(qids), 256):
                    own, q = qids[lo:lo + 256], qv[lo:lo + 256]
                    heaps = [best.setdefault(int(i), []) for i in own]
                    least = np.array([h[0][0] if len(h) == k else -np.inf for h in heaps], np.float64)
                    # an id may be on any number of rows; none of them is a neighbour of that id
                    same = own[:, None] == ids[None, :]
                    qi, row = block.candidates(q, least, k, same) if biggest < 1 << 52 else np.nonzero(~same)
                    if biggest < 1 << 62:
                        exact = np.einsum("ij,ij->i", q[qi], vals[row])
                    else:
                        exact = [sum(int(a) * int(c) for a, c in zip(q[x], vals[y])) for x, y in zip(qi, row)]
                    for x, y, s in zip(qi.tolist(), ids[row].tolist(), exact):
                        h, item = heaps[x], (int(s), -y)
                        if len(h) < k:
                            heapq.heappush(h, item)
                        elif item > h[0]:
                            heapq.heapreplace(h, item)
        rows = [(q, -i, s) for q, h in best.items() for s, i in h]
        for lo in range(0, len(rows), 10_000):
            part = rows[lo:lo + 10_000]
            yield pa.RecordBatch.from_arrays([pa.array([x[c] for x in part], pa.int64()) for c in range(3)], ["query_id", "vec_id", "score"])

    return run


def top_k(df: DataFrame, is_query, k: int = 10, id_col: str = "vec_id", vec_col: str = "embedding", scale: int = 1024) -> DataFrame:
    """query_id, rank, vec_id, score: each query's ``k`` largest integer inner products.
    ``is_query``: a function from the id column to a condition."""
    vectors = _int_vectors(df, id_col, vec_col, scale)
    index = stored(_packed(vectors, BLOCK), "impact-index")
    queries = vectors.where(is_query(F.col("id"))).groupBy("id").agg(F.min("v").alias("v"))
    asked = stored(_packed(queries, QUERY_BLOCK), "impact-queries")
    salts = max(1, -(-index.count() // BLOCKS_PER_TASK))
    # block ids only: one for each 1,024 queries
    by_dim: dict[int, list[int]] = {}
    for r in asked.select("dim", "block").toLocalIterator():
        by_dim.setdefault(r.dim, []).append(r.block)
    if not by_dim:
        return df.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    q_of = F.create_map(*itertools.chain.from_iterable((F.lit(d), F.array(*[F.lit(x).cast("long") for x in xs])) for d, xs in by_dim.items()))
    left = index.withColumn("qblock", F.explode(q_of[F.col("dim")])).withColumn("salt", F.pmod(F.xxhash64("block"), F.lit(salts)))
    right = asked.select(F.col("block").alias("qblock"), F.col("ids").alias("qids"), F.col("vals").alias("qvals"),
                         F.explode(F.sequence(F.lit(0).cast("long"), F.lit(salts - 1).cast("long"))).alias("salt"))
    pairs = left.join(right.hint("shuffle_hash"), ["qblock", "salt"]).select("dim", "ids", "vals", "qids", "qvals")
    found = mapped(pairs, _search(k), "query_id long, vec_id long, score long")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def query(spark, sf_dir: str) -> DataFrame:
    return top_k(table(spark, sf_dir, "embeddings", "vec_id", "embedding"), lambda i: i % 100 == 0)


ORACLE = """
WITH e AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
           WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
             AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(CAST(q.v AS DOUBLE[]), CAST(c.v AS DOUBLE[])) AS BIGINT) AS score
      FROM e q JOIN e c ON q.vec_id <> c.vec_id WHERE q.vec_id % 100 = 0),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10
"""
