"""Removal of repeated byte stretches by longest-previous-factor arrays.

A stretch of ``width`` bytes goes wherever it also starts earlier (smaller id, or same
document and smaller place); overlapping stretches count, and all are judged on the
input. Put differently: with the places of a collection in suffix order, the previous and
the next smaller place beside each one give its longest previous factor, and a place whose
factor reaches ``width`` removes the bytes it covers. A factor is only needed up to
``width``, so suffixes are ordered by so many bytes and only suffixes that can be equal so
far have to meet.

1. *Anchors.* Each stretch is named by its leftmost smallest hashed 32-byte gram, so equal
   stretches have one name, at one offset. Neighbouring stretches with the same anchor
   form a fragment, about one in 35 bytes of text.
2. *Names seen twice.* Counts by name, combined in each batch; all other text is done.
3. *Fragments* whose name occurs again go, with their bytes, to their name's task. There
   whole groups are put in place order, their stretches sorted as suffixes, and inside each run of
   neighbours that share ``width`` bytes the place order gives the previous smaller place.
4. *Hot names* (more than ``HOT`` fragments: a passage that a third of all documents
   share, say) would fill one task. Of equal fragments a batch sends the first, and minima
   by (anchor name, fragment hash), combined map-side, find the first of all; what differs
   from all others, at the ends of a passage, is compared stretch by stretch in the same
   way. No group is gathered anywhere.

Names and hashes of hot fragments and stretches are 64-bit each, 128 together; the other
comparisons are of the bytes. Work and disk grow with the input; a task holds a batch of texts or the
groups of one batch of fragments.

Edge cases: ids are integers; a null text is an empty one (nothing to remove); null ids come after all ids;
rows of one id are ordered by a hash of their text, and equal rows are one document: each
keeps its row and none removes from the other; texts shorter than ``width`` stay whole; an
empty table gives no rows; only the id and text columns are read, so clashing extra
names do not matter. What is left of a text may split a multi-byte character, so it is
binary.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import mapped, mix64, stored, table, text_batches

WIDTH = 100
GRAM = 32
#: A name of more fragments is compared stretch by stretch; bounds a group's bytes at 2,000 * 2 * width.
HOT = 2_000
NULL_ID = (1 << 63) - 1
#: Bytes of fragments that a task sorts at once; each stretch takes ``width`` bytes there.
SEGMENT = 1 << 20
#: Bytes whose anchors are found at once: the arrays of so many stay in a core's cache.
CACHED = 1 << 17
PLACE = np.uint64((1 << 31) - 1)
FACTORS = mix64(np.arange(1, GRAM // 8 + 1, dtype=np.uint64)) | np.uint64(1)
COLD_PIECE, HOT_PIECE, GONE = 0, 1, 2
PIECE = "kind byte, name long, stretch long, _i long, _h long, start int, stop int, bytes binary"


def eights(data: np.ndarray) -> np.ndarray:
    """The eight bytes from each place on, as one number."""
    out = np.empty(max(0, len(data) - 7), np.uint64)
    for j in range(min(8, len(out))):
        part = data[j:j + (len(data) - j) // 8 * 8].view("<u8")
        out[j::8] = part[:len(out[j::8])]
    return out


def hashed(eight: np.ndarray, at: np.ndarray, offsets: list[int]) -> np.ndarray:
    """A 64-bit hash of the bytes from each place on that ``offsets`` cover by eights."""
    h = np.zeros(len(at), np.uint64)
    for o in offsets:
        h = mix64(h * np.uint64(0x9E3779B97F4A7C15) + eight[at + o])
    return h


def grams(eight: np.ndarray) -> np.ndarray:
    """Names of the grams from each place on: the gram's eights times odd numbers, mixed. Two
    grams may share a name, which only makes their stretches meet in vain."""
    h = eight[:len(eight) - GRAM + 8] * FACTORS[0]
    for j in range(1, GRAM // 8):
        h += eight[8 * j:8 * j + len(h)] * FACTORS[j]
    return mix64(h)


def covering(width: int) -> list[int]:
    """Offsets of eights that cover ``width`` bytes."""
    return [*range(0, width - 8, 8), width - 8]


def fragments(data: np.ndarray, ends: np.ndarray, width: int):
    """(text number, start in the text, stretches, name) of the fragments of the texts
    that lie in ``data`` one after another, text k from ``ends[k]`` to ``ends[k + 1]``."""
    span = width - GRAM + 1
    # where a stretch can start: a text's places but its last width - 1
    edge = np.zeros(len(data) + 1, np.int8)
    long = np.flatnonzero(np.diff(ends) >= width)
    np.add.at(edge, ends[long], 1)
    np.add.at(edge, ends[long + 1] - width + 1, -1)
    starts = np.cumsum(edge, dtype=np.int8)
    found = [[], [], []]
    for low in range(0, len(data), CACHED):
        part = data[low:low + CACHED + width - 1]
        count = len(part) - width + 1
        if count <= 0:
            break
        place = np.flatnonzero(starts[low:low + count])
        if not len(place):
            continue
        gram = grams(eights(part))
        least = (gram & ~PLACE) | np.arange(len(gram), dtype=np.uint64)
        done = 1
        while done < span:
            step = min(done, span - done)
            least = np.minimum(least[:-step], least[step:])
            done += step
        anchor = (least[place] & PLACE).astype(np.int64)
        new = np.flatnonzero(np.concatenate(([True], (anchor[1:] != anchor[:-1]) | (place[1:] != place[:-1] + 1))))
        for out, x in zip(found, (low + place[new], np.diff(np.append(new, len(place))), gram[anchor[new]].view(np.int64))):
            out.append(x)
    place, n, name = [np.concatenate(x) if x else np.empty(0, np.int64) for x in found]
    text = np.searchsorted(ends, place, "right") - 1
    return text, place - ends[text], n, name


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a text column's rows one after another, and where each begins."""
    size = pa.compute.binary_length(column).to_numpy(zero_copy_only=False).astype(np.int64)
    ends = np.concatenate(([0], np.cumsum(size)))
    return np.frombuffer(b"".join(column.cast(pa.binary()).to_pylist()), np.uint8), ends


def repeated(stretches: np.ndarray, place: np.ndarray) -> np.ndarray:
    """Whether each stretch also starts at an earlier place. ``stretches`` are the suffixes
    up to the width that counts, or their hashes. In suffix order, equal places first, the
    previous smaller place of a suffix within its run of equal neighbours is the run's
    first unless both are the same place, and the next smaller one lies outside."""
    if not len(place):
        return np.empty(0, bool)
    by_place = np.argsort(place, kind="stable")
    order = by_place[np.argsort(stretches[by_place], kind="stable")]
    ordered = stretches[order]
    run = np.concatenate(([0], np.cumsum(ordered[1:] != ordered[:-1])))
    first = place[order][np.searchsorted(run, np.arange(run[-1] + 1))]
    out = np.empty(len(place), bool)
    out[order] = place[order] > first[run]
    return out


def ranges(group: np.ndarray, start: np.ndarray, width: int):
    """Ascending starts of stretches, by group: numbers of the first of each chain of
    neighbouring stretches, and where the bytes they cover end."""
    if not len(start):
        return np.empty(0, np.int64), np.empty(0, np.int64)
    new = np.concatenate(([True], (group[1:] != group[:-1]) | (start[1:] != start[:-1] + 1)))
    first = np.flatnonzero(new)
    return first, start[np.append(first[1:], len(start)) - 1] + width


def counted(at: np.ndarray, n: np.ndarray) -> np.ndarray:
    """at[0], at[0] + 1, ... (n[0] of them), at[1], ..."""
    return np.repeat(at - np.concatenate(([0], np.cumsum(n)[:-1])), n) + np.arange(int(n.sum()))


def keyed(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    return df.select(F.col(f"`{id_col}`").alias("_id"), F.coalesce(F.col(f"`{id_col}`").cast("long"), F.lit(NULL_ID)).alias("_i"),
                     F.xxhash64(text).alias("_h"), text.alias("_text"))


def anchor_rows(docs: DataFrame, width: int, counts: bool) -> DataFrame:
    """Names with their counts in a batch, or a row per fragment."""
    def run(batches):
        for b in text_batches(batches, "_text"):
            text, start, n, name = fragments(*buffers(b.column(2)), width)
            if counts:
                each, times = np.unique(name, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(each), pa.array(times)], ["name", "n"])
            else:
                keys = [pa.compute.take(b.column(k), pa.array(text)) for k in (0, 1)]
                yield pa.RecordBatch.from_arrays([pa.array(name), *keys, pa.array(start.astype(np.int32)), pa.array(n.astype(np.int32))],
                                                 ["name", "_i", "_h", "start", "n"])

    return mapped(docs.select("_i", "_h", "_text"), run, "name long, n long" if counts else "name long, _i long, _h long, start int, n int")


def pieces_of(docs: DataFrame, marks: DataFrame, width: int) -> DataFrame:
    """What the marked fragments of each text send on: cold fragments with their bytes, the
    hot ones that are the first in their batch, and the ranges of those that are not."""
    def run(batches):
        for b in text_batches(batches, "_text"):
            i, h = (b.column(k).to_numpy().astype(np.int64) for k in (0, 1))
            texts = b.column(2).cast(pa.binary()).to_pylist()
            marks_ = b.column(3)
            text = np.repeat(np.arange(b.num_rows), pa.compute.list_value_length(marks_).to_numpy())
            name, start, n, hot = (pa.compute.struct_field(marks_.flatten(), k).to_numpy(zero_copy_only=False) for k in range(4))
            rows = [(COLD_PIECE, m, 0, i[t], h[t], s, s + c + width - 1, texts[t][s:s + c + width - 1])
                    for t, m, s, c in zip(*(x[~hot].tolist() for x in (text, name, start, n)))]
            out = [pa.array(c, k) for c, k in zip(zip(*rows), TYPES)] if rows else None
            if out:
                yield pa.RecordBatch.from_arrays(out, NAMES)
            text, name, start, n = (x[hot] for x in (text, name, start, n))
            order = np.lexsort((start, h[text], i[text]))
            first: dict[bytes, int] = {}
            rows = []
            for t, m, s, c in zip(*(x[order].tolist() for x in (text, name, start, n))):
                piece = texts[t][s:s + c + width - 1]
                # equal rows have equal places, of which none is earlier
                here = first.setdefault(piece, (i[t], h[t], s))
                kind = HOT_PIECE if here == (i[t], h[t], s) else GONE
                rows.append((kind, m, digest(piece), i[t], h[t], s, s + len(piece), piece if kind == HOT_PIECE else None))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), TYPES)], NAMES)

    both = docs.select("_i", "_h", "_text").join(marks, ["_i", "_h"])
    return mapped(both.select("_i", "_h", "_text", "marks"), run, PIECE)


NAMES = ["kind", "name", "stretch", "_i", "_h", "start", "stop", "bytes"]
TYPES = [pa.int8(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary()]


def digest(piece: bytes) -> int:
    return xxhash.xxh3_64_intdigest(piece) - (1 << 63)


def whole_groups(batches):
    """Tables of about a segment of bytes that end where a name does."""
    held: list[pa.RecordBatch] = []
    size = 0
    for b in batches:
        while b.num_rows:
            take = min(b.num_rows, 4096)
            held.append(b.slice(0, take))
            size += pa.compute.sum(pa.compute.binary_length(held[-1].column(4))).as_py() or 0
            b = b.slice(take)
            if size < SEGMENT:
                continue
            names = np.concatenate([x.column(0).to_numpy() for x in held])
            cut = np.flatnonzero(names[1:] != names[:-1])
            if len(cut):
                t = pa.Table.from_batches(held).combine_chunks()
                yield t.slice(0, int(cut[-1]) + 1)
                held = t.slice(int(cut[-1]) + 1).to_batches()
                size = sum(pa.compute.sum(pa.compute.binary_length(x.column(4))).as_py() or 0 for x in held)
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


def cold_ranges(cold: DataFrame, width: int) -> DataFrame:
    """Step 3: ``_i, _h, start, stop`` of the repeated stretches of groups by name."""
    def run(batches):
        for t in whole_groups(batches):
            i, h, start = (t.column(k).to_numpy() for k in (1, 2, 3))
            key = np.lexsort((start, h, i))
            i, h, start = i[key], h[key], start[key].astype(np.int64)
            new = np.concatenate(([True], (i[1:] != i[:-1]) | (h[1:] != h[:-1]) | (start[1:] != start[:-1])))
            i, h, start = i[new], h[new], start[new]  # rows of one document and place are one
            texts = pa.compute.take(t.column(4), pa.array(key[new])).to_pylist()
            size = np.fromiter(map(len, texts), np.int64, len(texts))
            n = size - width + 1
            # fragments are in place order, so an equal one before removes the whole of it
            seen: dict[bytes, int] = {}
            first_equal = np.fromiter((seen.setdefault(x, k) for k, x in enumerate(texts)), np.int64, len(texts))
            copy = first_equal < np.arange(len(texts))
            yield pa.RecordBatch.from_arrays([pa.array(i[copy]), pa.array(h[copy]), pa.array(start[copy].astype(np.int32)),
                                              pa.array((start + size)[copy].astype(np.int32))], ["_i", "_h", "start", "stop"])
            # a name that has one fragment left has no stretch twice
            names = t.column(0).to_numpy()[key[new]]
            one = ~copy
            values, times = np.unique(names[one], return_counts=True)
            some = one & np.isin(names, values[times > 1])
            i, h, start, n, size = i[some], h[some], start[some], n[some], size[some]
            if not len(i):
                continue
            data = np.frombuffer(b"".join(x for x, s in zip(texts, some.tolist()) if s), np.uint8)
            place = counted(np.cumsum(size) - size, n)  # ascending, as the fragments are in place order
            suffixes = np.ascontiguousarray(np.lib.stride_tricks.sliding_window_view(data, width)[place]).view(f"V{width}").reshape(-1)
            gone = repeated(suffixes, np.arange(len(place)))
            of = np.repeat(np.arange(len(n)), n)[gone]
            at = place[gone] - (np.cumsum(size) - size)[of] + start[of]
            first, stop = ranges(of, at, width)
            k = of[first]
            yield pa.RecordBatch.from_arrays([pa.array(i[k]), pa.array(h[k]), pa.array(at[first].astype(np.int32)), pa.array(stop.astype(np.int32))],
                                             ["_i", "_h", "start", "stop"])

    grouped = cold.select("name", "_i", "_h", "start", "bytes").repartition("name").sortWithinPartitions("name")
    return mapped(grouped, run, "_i long, _h long, start int, stop int")


def stretches_of(rows: DataFrame, width: int) -> DataFrame:
    """``name, stretch, _i, _h, start, stop, gone``: the stretches of fragments by hash; of the
    equal ones of a batch the first alone, and the others as gone."""
    def run(batches):
        for b in text_batches(batches, "bytes", SEGMENT):
            name, i, h, start = (b.column(k).to_numpy() for k in range(4))
            texts = b.column(4).to_pylist()
            size = np.fromiter(map(len, texts), np.int64, len(texts))
            begin, n = np.cumsum(size) - size, size - width + 1
            of = np.repeat(np.arange(len(n)), n)
            at = counted(np.zeros(len(n), np.int64), n)
            stretch = hashed(eights(np.frombuffer(b"".join(texts), np.uint8)), begin[of] + at, covering(width)).view(np.int64)
            at += start[of]
            # rows of one key are one document, so places compare by the key's rank
            rank = np.unique(np.stack([i, h], 1), axis=0, return_inverse=True)[1].reshape(-1)
            place = rank[of].astype(np.int64) << 32 | at
            gone = repeated(stretch, place)
            stay = np.flatnonzero(~gone)
            stay = stay[np.unique(place[stay], return_index=True)[1]]
            later = np.flatnonzero(gone)
            later = later[np.lexsort((at[later], of[later]))]
            chain, stop = ranges(of[later], at[later], width)
            rows_ = np.concatenate((stay, later[chain]))
            columns = [name[of[rows_]], stretch[rows_], i[of[rows_]], h[of[rows_]], at[rows_].astype(np.int32),
                       np.concatenate((at[stay] + width, stop)).astype(np.int32), np.arange(len(rows_)) >= len(stay)]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["name", "stretch", "_i", "_h", "start", "stop", "gone"])

    return mapped(rows.select("name", "_i", "_h", "start", "bytes"), run, "name long, stretch long, _i long, _h long, start int, stop int, gone boolean")


KEY = ["_i", "_h", "start", "stop"]


def firsts_of(rows: DataFrame, name: str, *carried: str) -> DataFrame:
    """``name, stretch, first, n``: of the equal rows the one with the least place (its place
    and the columns ``carried``), found by minima that combine map-side. Written, so that a
    join with it has an exchange of its own on both sides."""
    first = F.min(F.struct("_i", "_h", "start", *carried)).alias("first")
    return stored(rows.groupBy("name", "stretch").agg(first, F.count(F.lit(1)).alias("n")), name)


def later_than(rows: DataFrame, firsts: DataFrame) -> DataFrame:
    """Ranges of the rows that are equal to one at an earlier place."""
    least = firsts.where("n > 1").select("name", "stretch", F.struct("first._i", "first._h", "first.start").alias("least"))
    return rows.select("name", "stretch", *KEY).join(least, ["name", "stretch"]).where(F.struct("_i", "_h", "start") > F.col("least")).select(*KEY)


def hot_ranges(hot: DataFrame, width: int) -> DataFrame:
    """Step 4: ranges of the fragments that are equal to an earlier one, then of the
    others' stretches that start earlier elsewhere."""
    whole = firsts_of(hot, "dedup-hot", "bytes")
    each = stored(stretches_of(whole.select("name", "first.*"), width), "dedup-stretches")
    some = each.where(~F.col("gone"))
    return later_than(hot, whole).unionByName(each.where("gone").select(*KEY)).unionByName(later_than(some, firsts_of(some, "dedup-first")))


def removed_ranges(docs: DataFrame, width: int) -> DataFrame:
    """``_i, _h, gone``: the ranges to remove (they may overlap) of each text that has any."""
    names = anchor_rows(docs, width, counts=True).groupBy("name").agg(F.sum("n").alias("_n")).where("_n > 1")
    names = stored(names.select("name", (F.col("_n") > HOT).alias("hot")), "dedup-names")
    again = anchor_rows(docs, width, counts=False).join(names, "name")
    marks = again.groupBy("_i", "_h").agg(F.collect_set(F.struct("name", "start", "n", "hot")).alias("marks"))
    all_ = stored(pieces_of(docs, stored(marks, "dedup-marks"), width), "dedup-pieces")
    gone = all_.where(F.col("kind") == GONE).select("_i", "_h", "start", "stop")
    gone = gone.unionByName(cold_ranges(all_.where(F.col("kind") == COLD_PIECE), width))
    gone = gone.unionByName(hot_ranges(all_.where(F.col("kind") == HOT_PIECE), width))
    return stored(gone.groupBy("_i", "_h").agg(F.collect_set(F.struct("start", "stop")).alias("gone")), "dedup-gone")


def without_repeats(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH) -> DataFrame:
    """id, n_bytes, kept (binary: what is left of the text) and spans (array of start, stop:
    the maximal removed runs), one row per row."""
    if width <= GRAM:
        raise ValueError(f"width must be over {GRAM}")
    docs = keyed(df, id_col, text_col)
    schema = f"_id {df.schema[id_col].dataType.simpleString()}, n_bytes long, kept binary, spans array<struct<start:long,stop:long>>"
    span_type = pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))

    def run(batches):
        for b in text_batches(batches, "_text"):
            texts = b.column(1).cast(pa.binary()).to_pylist()
            gone = b.column(2)
            counts = pa.compute.fill_null(pa.compute.list_value_length(gone), 0).to_numpy(zero_copy_only=False)
            start, stop = (pa.compute.struct_field(gone.flatten(), k).to_numpy(zero_copy_only=False) for k in (0, 1))
            ends = np.concatenate(([0], np.cumsum(counts)))
            spans: list[list] = [[] for _ in texts]
            sizes = [len(t) for t in texts]
            for k in np.flatnonzero(counts).tolist():
                depth = np.zeros(sizes[k] + 2, np.int32)
                np.add.at(depth, start[ends[k]:ends[k + 1]] + 1, 1)
                np.add.at(depth, stop[ends[k]:ends[k + 1]] + 1, -1)
                edge = np.diff((np.cumsum(depth) > 0).astype(np.int8))
                low, high = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
                spans[k] = [{"start": int(a), "stop": int(z)} for a, z in zip(low, high)]
                cuts = [0, *np.stack([low, high], 1).reshape(-1).tolist(), sizes[k]]
                texts[k] = b"".join(texts[k][a:z] for a, z in zip(cuts[::2], cuts[1::2]))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(sizes, pa.int64()), pa.array(texts, pa.binary()), pa.array(spans, span_type)],
                                             ["_id", "n_bytes", "kept", "spans"])

    rows = docs.join(removed_ranges(docs, width), ["_i", "_h"], "left").select("_id", "_text", "gone")
    return mapped(rows, run, schema).withColumnRenamed("_id", id_col)


def query(spark, sf_dir: str) -> DataFrame:
    out = without_repeats(table(spark, sf_dir, "documents", "doc_id", "text"))
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda a, s: a + s["stop"] - s["start"])
    return out.select("doc_id", "n_bytes", removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"),
                      F.sha2("kept", 256).alias("kept_sha256"))
