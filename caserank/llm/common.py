"""Small helpers shared by the operators of this package."""

from __future__ import annotations

import contextlib
import ctypes
import itertools
import os
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import cut_lineage, remove_folder, ship_package

#: The separators of a word: space and the ASCII controls 9 to 13.
WORD_SEPARATORS = " \t\n\x0b\x0c\r"
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"
#: Settings of the statements that write a stage table, when Spark offers them: shuffle files go
#: with their statement, and long rows go to Python few at a time, as the executor holds a batch
#: beside its heap several times over.
WRITING = {CLEANUP: "true", BATCH: str(8 << 20)}


def table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    """The given table, by the path only Spark has to reach."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return df.select(*columns) if columns else df


def held_out(doc_id: Column | str, modulus: int, remainder: int) -> Column:
    """Whether crc32(doc_id as text) mod ``modulus`` is ``remainder``; a null id never is."""
    c = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.coalesce(F.crc32(c.cast("string").cast("binary")) % modulus == remainder, F.lit(False))


def held_out_py(doc_id, modulus: int, remainder: int) -> bool:
    return doc_id is not None and zlib.crc32(str(doc_id).encode()) % modulus == remainder


def words_of(text: str | None) -> list[bytes]:
    """Words of a text with A-Z lower-cased. ``bytes`` methods touch ASCII only, so
    this is exactly the split on space and controls 9 to 13."""
    return text.encode("utf-8", "surrogatepass").lower().split() if text else []


#: What a Python worker keeps for its later tasks, by operator.
KEPT: dict[str, dict] = {}


def forget(keep: str | None = None) -> None:
    """Drop what this worker keeps for operators other than ``keep``, and give the memory back:
    a worker runs the tasks of all operators in turn."""
    for name, kept in KEPT.items():
        if name != keep:
            kept.clear()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # another C library
        ctypes.CDLL(None).malloc_trim(0)


def mapped(df: DataFrame, fn, schema: str, keep: str | None = None) -> DataFrame:
    """``mapInArrow`` with this package shipped to local workers, which ``forget`` what
    operators other than ``keep`` left in them, first and when a task has ended: idle workers
    hold no memory of it beside tasks that run without Python."""
    ship_package(df.sparkSession)

    def run(batches):
        forget(keep)
        yield from fn(batches)
        forget(keep)

    return df.mapInArrow(run, schema)


#: Folders of all tables written so far, in order.
_WRITTEN: list[tuple[SparkSession, str]] = []


def written() -> int:
    """The number of tables written so far, to name those of a step by."""
    return len(_WRITTEN)


def release(low: int, high: int) -> None:
    """Delete the tables written from number ``low`` up to ``high``, whose readers have all run."""
    for spark, folder in _WRITTEN[low:high]:
        remove_folder(spark, folder)


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared checkpoint folder and read it back, under the settings
    ``WRITING``."""
    spark = df.sparkSession
    before = {}
    for key, value in WRITING.items():
        with contextlib.suppress(Exception):  # an older Spark may lack the setting
            old = spark.conf.get(key)
            spark.conf.set(key, value)
            before[key] = old
    try:
        out = cut_lineage(df, name)
        _WRITTEN.append((spark, out.stage_folder))
        return out
    finally:
        for key, old in before.items():
            spark.conf.set(key, old)


def one_thread() -> None:
    """One task uses one core: no thread pools inside Python workers."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    os.environ["RAYON_NUM_THREADS"] = "1"


def text_batches(batches: Iterator[pa.RecordBatch], column: str = "text", limit: int = 4 << 20):
    """Split record batches into slices of about ``limit`` bytes of text, so that a
    batch of very long texts never becomes Python objects all at once."""
    for b in batches:
        if not b.num_rows:
            continue
        col = b.column(b.schema.get_field_index(column))
        size = pa.compute.fill_null(pa.compute.binary_length(col), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        part = np.cumsum(size) // limit
        cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), b.num_rows]
        for lo, hi in zip(cuts, cuts[1:]):
            if hi > lo:
                yield b.slice(lo, hi - lo)


class WordIndex:
    """White-space delimited words of texts as rows of an array of per-word values.

    ``values(words)`` computes the rows of words not seen yet; a bounded cache keeps them
    for the texts that follow (words repeat far more than texts). ``split`` defaults
    to Python's."""

    def __init__(self, values, split=str.split, limit: int = 400_000):
        self.values, self.split, self.limit = values, split, limit
        self.rows: dict = {}
        self.table: np.ndarray | None = None
        self.used = 0

    def __call__(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Row number of every word of every text, and each text's first word (one more at the end)."""
        split = [self.split(t) if t else [] for t in texts]
        if len(self.rows) > self.limit:
            self.rows, self.table, self.used = {}, None, 0
        new = list(set().union(*split).difference(self.rows))
        if new or self.table is None:
            own = self.values(new)
            need = self.used + len(new)
            if self.table is None or need > len(self.table):
                grown = np.zeros((max(2 * need, 1024), *own.shape[1:]), own.dtype)
                if self.table is not None:
                    grown[:self.used] = self.table[:self.used]
                self.table = grown
            self.table[self.used:need] = own
            self.rows.update(zip(new, range(self.used, need)))
            self.used = need
        ends = np.concatenate(([0], np.cumsum([len(s) for s in split]))).astype(np.int64)
        get = self.rows.__getitem__
        flat = np.fromiter(map(get, itertools.chain.from_iterable(split)), np.int64, int(ends[-1]))
        return flat, ends


def sums_by_text(values: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Sums of the rows of each text (zero for a text without words)."""
    out = np.zeros((len(ends) - 1, *values.shape[1:]), np.float64)
    has = ends[1:] > ends[:-1]
    if has.any():
        out[has] = np.add.reduceat(values, ends[:-1][has], axis=0)
    return out


def word_hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter((xxhash.xxh3_64_intdigest(w) for w in words), np.uint64, len(words))


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser (wraps around) over unsigned arrays."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    return x
