"""N-gram Jaccard join: components of documents whose shingle sets are similar.

Two documents link when 100 |A n B| >= percent |A u B|. The join is exact:

* Documents of equal sets form a class (a 64-bit hash of the set) and are never
  compared with each other.
* Sizes are cut into bands whose ends differ by the factor a link allows. In a band, a
  link's sets differ in at most d shingles, so if the hash range is cut into k = d+1+e
  parts, at least e+1 parts hold the same shingles in both sets. Each set enters one
  tile per part (band, part, its shingles there); empty parts are left out by sets with at
  most e of them. Linked sets thus always share a tile, unrelated ones almost never: e
  is chosen so that few sets have more empty parts, which count as tiles then.
* A tile's smallest set is compared with the others first. Where a tile still holds
  several components, all its pairs across components are compared, tiles cut into
  blocks of bounded size. A comparison first bounds the overlap from above by bit
  counts of hashed bitmaps, which grow with the sets, then intersects the sorted arrays.

Hot groups: copies collapse within a batch before any shuffle; of near copies, each
batch sends one set per tile and the rest as links to try, so a tile has at most one
row per batch. Components come from alternating large-star and small-star rounds with
plain minimum aggregations; nothing is collected.

Edge cases: a null or empty text, or one without words, has size 0 and is its own
component; fewer words than a shingle make one shingle of them all; repeated rows are
copies of each other; a null id takes part, and components are named by the smallest id
that is not null; extra columns are not read.
"""

from __future__ import annotations

import functools
import itertools
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import drop_stage, ship_package
from .common import WordIndex, mapped, mix64, stored, table, text_batches, word_hashes, words_of

WORDS, PERCENT = 4, 85
#: Bits of a bitmap at least; of larger sets two or more a shingle, else it is full and rules nothing out.
BITS = 2048
TILE_BLOCK = 512
FILTER_BITS = 24
#: Pairs are compared exactly in so many rounds at least, and so many to a round at most.
ROUNDS, ROUND_PAIRS = 3, 1_000_000
_ODD = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xFF51AFD7ED558CCD,
                 0xC4CEB9FE1A85EC53, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB], np.uint64)
_SET, _TILE, _SHORT = np.uint64(0x8EBC6AF09C88C6E3), np.uint64(0x589965CC75374CC3), np.uint64(0x1D8E4E27C47D124F)


def shingle_sets(words: WordIndex, texts: list[str | None], size: int) -> list[np.ndarray]:
    """Each text's distinct shingles as a sorted array of 64-bit hashes."""
    flat, ends = words(texts)
    h = words.table[flat] if len(flat) else np.zeros(0, np.uint64)
    mult = _ODD[np.arange(size) % len(_ODD)] + np.uint64(2) * (np.arange(size, dtype=np.uint64) // np.uint64(len(_ODD)))
    full = np.zeros(max(0, len(h) - size + 1), np.uint64)
    for k in range(size):
        full += h[k:len(full) + k] * mult[k]
    full = mix64(full)
    out = []
    for lo, hi in zip(ends.tolist(), ends[1:].tolist()):
        if hi - lo >= size:
            out.append(np.unique(full[lo:hi - size + 1]))
        elif hi > lo:
            out.append(mix64(np.array([(h[lo:hi] * mult[:hi - lo]).sum()]) + np.array([hi - lo], np.uint64) * _SHORT))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def set_id(s: np.ndarray) -> int:
    """A signed 64-bit hash of a set."""
    return int(mix64(np.array([mix64(s ^ _SET).sum()]) + np.array([len(s)], np.uint64) * _ODD[0]).view(np.int64)[0])


@functools.cache
def bands(percent: int, upto: int) -> list[int]:
    """Band starts up to size ``upto``: the next band starts beyond what a link allows."""
    out = [1]
    while out[-1] <= upto:
        out.append(max(out[-1] + 1, out[-1] * 100 // percent))
    return out


@functools.cache
def parts_of_band(band: int, percent: int, upto: int) -> tuple[int, int]:
    """(parts, spare parts) of a band; no parts where a link needs equal sets."""
    largest = bands(percent, upto)[band + 1] - 1
    d = largest * (100 - percent) // percent
    spare = least = 1 + (3 * d + 99) // 100
    for _ in range(2):  # four deviations above the empty parts that the band's smallest sets have on average
        empty = (k := d + 1 + spare) * math.exp(-bands(percent, upto)[band] / k)
        spare = max(least, min(1 + (12 * d + 99) // 100, int(empty + 4 * math.sqrt(empty)) + 1))
    return (d + 1 + spare, spare) if d else (0, 0)


def tile_places(s: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Tiles of a set, in its own band and in those of smaller sets it may link to: their
    keys, and their ascending (band, part) numbers."""
    n = len(s)
    upto = 1 << max(10, n.bit_length() + 1)
    starts = bands(percent, upto)
    salt = np.arange(len(starts), dtype=np.uint64) * _TILE
    low = int(np.searchsorted(starts, max(1, -(-n * percent // 100)), "right")) - 1
    own = int(np.searchsorted(starts, n, "right")) - 1
    mixed, high, keys, places = mix64(s * _ODD[2]), s >> np.uint64(32), [], []
    for band in range(low, own + 1):
        k, spare = parts_of_band(band, percent, upto)
        if not k:
            continue
        part = (high * np.uint64(k) >> np.uint64(32)).astype(np.int64)
        begin = np.flatnonzero(np.concatenate(([True], part[1:] != part[:-1])))
        sums, here = np.add.reduceat(mixed, begin), part[begin]
        if k - len(here) > spare:  # too many empty parts: they count as well
            full = np.zeros(k, np.uint64)
            full[here] = sums
            sums, here = full, np.arange(k)
        keys.append(sums + salt[band] + here.astype(np.uint64) * _ODD[4])
        places.append(here + (band << 32))
    if not keys:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    return mix64(np.concatenate(keys)), np.concatenate(places)


def tile_keys(s: np.ndarray, percent: int) -> np.ndarray:
    return tile_places(s, percent)[0]


def bitmap(s: np.ndarray, n: int | None = None) -> np.ndarray:
    """Hashed bitmap of a set, as 64-bit words, in the size for ``n`` (its own) shingles."""
    size = max(BITS, 1 << (2 * (len(s) if n is None else n) - 1).bit_length())
    bits = np.zeros(size, np.uint8)
    bits[(s & np.uint64(size - 1)).astype(np.int64)] = 1
    return np.packbits(bits).view(np.uint64)


def overlap_bound(n, x: np.ndarray, m, y: np.ndarray) -> np.ndarray:
    """The most that sets of sizes n and m share, row by row of their bitmaps. Bitmaps of
    another size are folded to the smaller: a shingle's place there is its last bits."""
    words = min(x.shape[1], y.shape[1])
    x, y = (b if b.shape[1] == words else np.bitwise_or.reduce(b.reshape(len(b), -1, words), axis=1) for b in (x, y))
    return np.minimum(n - np.bitwise_count(x & ~y).sum(1, dtype=np.int64), m - np.bitwise_count(y & ~x).sum(1, dtype=np.int64))


def linked(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    """Whether two sorted sets link: sizes, then bit counts, then the exact intersection."""
    if not len(a) or not len(b):
        return False
    need = -(-percent * (len(a) + len(b)) // (100 + percent))
    if min(len(a), len(b)) < need:
        return False
    most = int(overlap_bound(len(a), bitmap(a)[None], len(b), bitmap(b)[None])[0])
    return most >= need and len(np.intersect1d(a, b, assume_unique=True)) >= need


def _signed(a: np.ndarray) -> pa.Array:
    return pa.array(a.view(np.int64))


def _local_stars(ids: np.ndarray, sets: list[np.ndarray], percent: int):
    """Of a batch of distinct sets: (set, its tiles) where it is the tile's first set, and the
    (first, other) pairs to try."""
    keys = [tile_keys(s, percent) for s in sets]
    owner = np.repeat(ids, [len(k) for k in keys])
    key = np.concatenate(keys) if keys else np.zeros(0, np.uint64)
    order = np.lexsort((owner, key))
    key, owner = key[order], owner[order]
    new = np.ones(len(key), bool)
    new[1:] = key[1:] != key[:-1]
    head = owner[new][np.cumsum(new) - 1] if len(key) else owner
    rest = ~new & (head != owner)
    pairs = np.unique(np.column_stack([head[rest], owner[rest]]), axis=0) if rest.any() else np.zeros((0, 2), np.int64)
    tile, of = key[new], owner[new]
    order = np.argsort(of, kind="stable")
    tile, of = tile[order], of[order]
    cuts = np.flatnonzero(np.concatenate(([True], of[1:] != of[:-1]))) if len(of) else np.zeros(0, np.int64)
    own = [t.tobytes() for t in np.split(tile, cuts[1:])] if len(of) else []
    return of[cuts], own, pairs


_DOC, _TILES, _PAIR = 0, 1, 2


def _scanned(docs: DataFrame, size: int, percent: int) -> DataFrame:
    """One scan of the texts. By ``kind``: (id, text hash, set, n) of every document; (set,
    tiles) of the first sets of a batch's tiles; (set, other) pairs of the others."""
    kind = docs.schema["_id"].dataType.simpleString()
    names = ["kind", "_id", "_hash", "set", "n", "tiles", "other"]

    def run(batches):
        words = WordIndex(word_hashes, words_of)
        for b in text_batches(batches, "_text"):
            sets = shingle_sets(words, b.column(1).to_pylist(), size)
            ids = [set_id(s) for s in sets]

            def rows(what, count, /, **columns):
                nulls = {"_id": b.column(0).type, "tiles": pa.binary()}
                own = {"kind": pa.array(np.full(count, what, np.int8)), **columns}
                return pa.RecordBatch.from_arrays([own[c] if c in own else pa.nulls(count, nulls.get(c, pa.int64())) for c in names], names)

            yield rows(_DOC, len(ids), _id=b.column(0), _hash=b.column(2), set=pa.array(ids, pa.int64()), n=pa.array([len(s) for s in sets], pa.int64()))
            distinct = {i: s for i, s in zip(ids, sets) if len(s)}
            first, own, pairs = _local_stars(np.array(list(distinct), np.int64), list(distinct.values()), percent)
            for lo in range(0, len(own), 500):
                yield rows(_TILES, len(own[lo:lo + 500]), set=pa.array(first[lo:lo + 500]), tiles=pa.array(own[lo:lo + 500], pa.binary()))
            if len(pairs):
                yield rows(_PAIR, len(pairs), set=pa.array(np.ascontiguousarray(pairs[:, 0])), other=pa.array(np.ascontiguousarray(pairs[:, 1])))

    return mapped(docs, run, f"kind byte, _id {kind}, _hash long, set long, n long, tiles binary, other long")


def _repeats(batches):
    """Tiles that a partition of all rows of its tiles holds more than once, each once. A
    batch of texts sends a tile once, so few rows are equal before and a partition is eight
    bytes a row here."""
    tile = np.sort(np.concatenate([np.zeros(0, np.int64), *(b.column(0).to_numpy() for b in batches)]))
    again = np.unique(tile[1:][tile[1:] == tile[:-1]])
    for lo in range(0, len(again), 100_000):
        yield pa.RecordBatch.from_arrays([pa.array(again[lo:lo + 100_000])], ["tile"])


def _first_pairs(scanned: DataFrame) -> DataFrame:
    """(x, y) pairs to try: those found within batches, and each tile's smallest set with its
    others. Tiles are counted first, and only rows of tiles that occur again are sent on."""
    tiles = scanned.where(F.col("kind") == _TILES)

    def each(batches, keep=None):
        for b in batches:
            for lo in range(0, b.num_rows, 500):
                own = b.slice(lo, 500)
                keys = [np.frombuffer(t, np.uint64) for t in own.column(1).to_pylist()]
                tile, of = np.concatenate(keys), np.repeat(own.column(0).to_numpy(), [len(k) for k in keys])
                if keep is None:
                    yield pa.RecordBatch.from_arrays([_signed(tile)], ["tile"])
                else:
                    rows = pa.RecordBatch.from_arrays([_signed(tile), pa.array(of)], ["tile", "a"])
                    yield rows.filter(_passes(keep.value, tile.view(np.int64)))

    tiles = tiles.select("set", "tiles")
    again = stored(mapped(mapped(tiles, each, "tile long").repartition("tile"), _repeats, "tile long"), "tiles-again")
    keep = scanned.sparkSession.sparkContext.broadcast(_bit_filter(again, "tile", again.count()))
    rows = mapped(tiles, _coalesced(lambda batches: each(batches, keep)), "tile long, a long")
    members = stored(rows.join(again, "tile", "left_semi"), "tile-rows")
    least = stored(members.groupBy("tile").agg(F.min("a").alias("x")), "tile-least")
    found = members.join(least, "tile").where("x <> a").select("x", F.col("a").alias("y"))
    local = scanned.where(F.col("kind") == _PAIR).select(F.col("set").alias("x"), F.col("other").alias("y"))
    both = found.unionByName(local).select(F.least("x", "y").alias("x"), F.greatest("x", "y").alias("y")).distinct()
    both = stored(both, "tile-pairs")
    drop_stage(again, members, least)
    return both


def _bit_filter(keys: DataFrame, column: str, n: int) -> np.ndarray:
    """A bit filter of a column of ``n`` 64-bit hashes, of 16 bits a key within
    ``FILTER_BITS`` (2 MB at most; beyond, it only lets more through)."""
    size = min(FILTER_BITS, max(16, (16 * n).bit_length()))
    slot = F.col(column).bitwiseAND(F.lit((1 << size) - 1))
    rows = keys.groupBy(F.shiftright(slot, 6).alias("w")).agg(F.bit_or(F.expr(f"shiftleft(1L, CAST(`{column}` & 63 AS INT))")).alias("bits")).toPandas()
    bits = np.zeros(1 << (size - 6), np.int64)
    bits[rows["w"].to_numpy(np.int64)] = rows["bits"].to_numpy(np.int64)
    return bits


def _passes(bits: np.ndarray, keys: np.ndarray) -> pa.Array:
    return pa.array((bits[(keys & (64 * len(bits) - 1)) >> 6] >> (keys & 63) & 1).astype(bool))


def _involved_sets(docs: DataFrame, sizes: DataFrame, involved: DataFrame, size: int) -> DataFrame:
    """(set, arr) of the sets in ``involved`` (one column ``set``), read again from the texts.
    A bit filter of the hashes of their texts spares the other texts; those it lets
    through wrongly are dropped by the semi-join."""
    shared = docs.sparkSession.sparkContext.broadcast(_bit_filter(sizes.join(involved, "set", "left_semi"), "_hash", involved.count()))

    def run(batches):
        words = WordIndex(word_hashes, words_of)
        for b in text_batches(batches, "_text"):
            b = b.filter(_passes(shared.value, b.column(2).to_numpy()))
            own = {set_id(s): s.tobytes() for s in shingle_sets(words, b.column(1).to_pylist(), size) if len(s)}
            yield pa.RecordBatch.from_arrays([pa.array(list(own), pa.int64()), pa.array(list(own.values()), pa.binary())], ["set", "arr"])

    found = mapped(docs, run, "set long, arr binary")
    return found.join(involved, "set", "left_semi").groupBy("set").agg(F.min("arr").alias("arr"))


def _bounded(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The (x, y) pairs whose sizes and bit counts do not rule a link out; this needs a
    small bitmap of each set only."""
    def bitmaps(batches):
        for b in batches:
            arrays = [np.frombuffer(a, np.uint64) for a in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([len(a) for a in arrays], pa.int64()), pa.array([bitmap(a).tobytes() for a in arrays], pa.binary())], ["set", "n", "bits"])

    def bound(batches):
        for b in batches:
            if b.num_rows:
                n, m = b.column(2).to_numpy(), b.column(4).to_numpy()
                x, y = (np.array([*b.column(c).to_pylist(), None], object)[:-1] for c in (3, 5))
                sizes, of = np.unique([(len(i), len(j)) for i, j in zip(x, y)], axis=0, return_inverse=True)
                need, most = -(-percent * (n + m) // (100 + percent)), np.zeros(len(n), np.int64)
                for k in range(len(sizes)):  # rows whose bitmaps have the same sizes
                    at = np.flatnonzero(of == k)
                    left, right = (np.frombuffer(b"".join(c[at]), np.uint64).reshape(len(at), -1) for c in (x, y))
                    most[at] = overlap_bound(n[at], left, m[at], right)
                b = b.filter(pa.array((np.minimum(n, m) >= need) & (most >= need)))
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1)], ["x", "y"])

    light = mapped(sets, bitmaps, "set long, n long, bits binary")
    both = (pairs.join(light.select(F.col("set").alias("y"), F.col("n").alias("yn"), F.col("bits").alias("yb")), "y")
            .join(light.select(F.col("set").alias("x"), F.col("n").alias("xn"), F.col("bits").alias("xb")), "x").select("x", "y", "xn", "xb", "yn", "yb"))
    return mapped(both, bound, "x long, y long")


def _exact(pairs: DataFrame, sets: DataFrame, percent: int, name: str) -> DataFrame:
    """Those of the (x, y) pairs that link, as a table. Pairs go in rounds by a hash of y, so
    the shuffle files of a round hold one part of the sets and are gone before the next;
    of the other parts only sets that occur as x are sent."""
    def exact(batches):
        for b in batches:
            ok, last, a = [], None, None
            for x, xa, ya in zip(b.column(0).to_pylist(), b.column(2).to_pylist(), b.column(3).to_pylist()):
                if x != last:
                    last, a = x, np.frombuffer(xa, np.uint64)
                ok.append(linked(a, np.frombuffer(ya, np.uint64), percent))
            b = b.filter(pa.array(ok, pa.bool_()))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1)], ["x", "y"])

    def one_round(part: DataFrame, own: DataFrame, n: int) -> DataFrame:
        shared = pairs.sparkSession.sparkContext.broadcast(_bit_filter(part, "x", n))
        some = mapped(sets, lambda batches: (b.filter(_passes(shared.value, b.column(0).to_numpy())) for b in batches), "set long, arr binary")
        full = (part.join(own.select(F.col("set").alias("y"), F.col("arr").alias("ya")), "y")
                .join(some.select(F.col("set").alias("x"), F.col("arr").alias("xa")), "x").select("x", "y", "xa", "ya"))
        return mapped(full, exact, "x long, y long")

    n = pairs.count()
    rounds = max(ROUNDS, -(-n // ROUND_PAIRS))
    found = []
    for k in range(rounds if n else 0):
        of = lambda c: F.pmod(F.xxhash64(c), F.lit(rounds)) == k  # noqa: B023, E731
        found.append(stored(one_round(pairs.where(of("y")), sets.where(of("set")), -(-n // rounds)), name))
    if not found:
        return stored(pairs.select("x", "y").limit(0), name)
    all_ = stored(functools.reduce(DataFrame.unionByName, found).coalesce(max(1, n // 1_000_000)), name)
    drop_stage(*found)
    return all_


def _connected(tried: DataFrame, sets: DataFrame, percent: int) -> tuple[DataFrame, DataFrame]:
    """(links, roots): links among the ``tried`` pairs that join the same sets as all of
    their links do. Each set is first compared with one other; of the remaining pairs only
    those are compared that this left in different components."""
    bounded = stored(_bounded(tried, sets, percent), "bounded-pairs")
    one = stored(bounded.groupBy("y").agg(F.min("x").alias("x")).select("x", "y"), "first-pairs")
    links = _exact(one, sets, percent, "links-first")
    roots = components(links)
    rx, ry = (roots.select(F.col("node").alias(c), F.col("root").alias(f"r{c}")) for c in ("x", "y"))
    apart = F.coalesce("rx", "x") != F.coalesce("ry", "y")
    rest = stored(bounded.join(one, ["x", "y"], "left_anti").join(rx, "x", "left").join(ry, "y", "left").where(apart).select("x", "y"), "other-pairs")
    more = _exact(rest, sets, percent, "links-other")
    drop_stage(bounded, one, rest)
    if more.limit(1).count():
        before, links = (links, more), stored(links.unionByName(more), "links-both")
        drop_stage(roots, *before)
        roots = components(links)
    return links, roots


def components(links: DataFrame, x: str = "x", y: str = "y") -> DataFrame:
    """(node, root) of every linked node; root is the smallest node of its component.
    Alternating large-star and small-star rounds: each points nodes at the smallest
    neighbour, by a minimum per node, until nothing moves."""
    edges = stored(links.select(F.greatest(x, y).alias("u"), F.least(x, y).alias("v")).where("u <> v").distinct(), "links")
    mark = None
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("m", "u"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        low2 = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low2, "u")
        last, edges = edges, stored(small.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(small.select("u", F.col("m").alias("v"))).where("u <> v").distinct(), "stars")
        drop_stage(last)
        now = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first()
        if now == mark:
            break
        mark = now
    roots = stored(edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(
        edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()), "roots")
    drop_stage(edges)
    return roots


def _open_pairs(sets: DataFrame, roots: DataFrame, tried: DataFrame, percent: int) -> DataFrame:
    """(x, y) pairs of different components that share a tile, pass the bit-count bound and are
    not ``tried`` yet.
    A pair is looked at in the band of its smaller set, where a link must share a tile, and
    reported by the first tile that both share there."""
    rooted = sets.join(roots.withColumnRenamed("node", "set"), "set", "left").select("set", "arr", F.coalesce("root", "set").alias("root"))

    def tiles(batches, names, keep=None):
        for b in batches:
            for i, arr, root in zip(*(c.to_pylist() for c in b.columns)):
                s = np.frombuffer(arr, np.uint64)
                k, place = tile_places(s, percent)
                band, n = place >> 32, len(k)
                at = np.arange(n) - np.searchsorted(band, band)  # place in the band's list of keys
                of = {"tile": _signed(k), "band": pa.array(band.astype(np.int32)), "at": pa.array(at.astype(np.int32)), "set": pa.array(np.full(n, i)),
                      "n": pa.array(np.full(n, len(s))), "root": pa.array(np.full(n, root))}
                rows = pa.RecordBatch.from_arrays([of[c] for c in names], names)
                yield rows.filter(_passes(keep.value, k.view(np.int64))) if keep is not None else rows

    # only tiles of several components matter, and one of two sets was tried whole
    light = mapped(rooted, _coalesced(lambda batches: tiles(batches, ["tile", "root"])), "tile long, root long")
    many = light.groupBy("tile").agg(F.min("root").alias("r0"), F.max("root").alias("r1"), F.count(F.lit(1)).alias("size")).where("r0 <> r1 AND size > 2")
    many = stored(many.select("tile"), "mixed-tiles")
    keep = sets.sparkSession.sparkContext.broadcast(_bit_filter(many, "tile", many.count()))
    names = ["tile", "band", "at", "set", "n", "root"]
    member = mapped(rooted, _coalesced(lambda batches: tiles(batches, names, keep)), "tile long, band int, at int, set long, n long, root long")
    members = member = stored(member.join(many, "tile", "left_semi"), "tile-members")
    drop_stage(many)
    # of a band's tiles with the same members the first is enough
    mixed = (member.groupBy("tile", "band").agg(F.min("at").alias("at"), F.count(F.lit(1)).alias("size"),
                                                *[F.sum(F.xxhash64("set", F.lit(k)).cast("decimal(20,0)")).alias(f"h{k}") for k in (0, 1)])
             .groupBy("band", "size", "h0", "h1").agg(F.min_by("tile", "at").alias("tile")).select("tile", "size"))
    within = Window.partitionBy("tile").orderBy("n", "set")
    member = member.join(mixed, "tile").withColumn("block", F.floor((F.row_number().over(within) - 1) / TILE_BLOCK))
    n_blocks = F.ceil(F.col("size") / TILE_BLOCK)
    member = (member.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), n_blocks - 1)))
              .select("tile", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "set", "n", "root", "band", "at"))
    member = member.join(_bitmaps(sets, percent), ["set", "band"]).select(
        "tile", "i", "j", "block", "set", "n", "root", "bits", F.expr("substring(keys, 1, 8 * at)").alias("earlier"), "band")
    pairs = mapped(member.repartition("tile", "i", "j").sortWithinPartitions("tile", "i", "j", "block"), _coalesced(_compared(percent)), "x long, y long").distinct()
    pairs = stored(pairs.join(tried, ["x", "y"], "left_anti"), "open-pairs")
    drop_stage(members)
    return pairs


def _compared(percent: int):
    """Compare the sets of each (tile, block, block) across components as rows stream by."""
    starts = bands(percent, 1 << 40)

    def pairs(rows):
        i, j, beyond = rows[0][1], rows[0][2], starts[rows[0][9] + 1]
        left, right = [r for r in rows if r[3] == i], [r for r in rows if r[3] == j]
        bits = np.frombuffer(b"".join([r[7] for r in right]), np.uint64).reshape(len(right), -1)
        ids, n, root = (np.array([r[c] for r in right], np.int64) for c in (4, 5, 6))
        for k, (_, _, _, _, own, size, r, b, earlier, _) in enumerate(left):
            need = -(-percent * (size + n) // (100 + percent))
            low = np.minimum(size, n)
            ok = (root != r) & (low >= need) & (low < beyond)
            if i == j:
                ok[:k + 1] = False
            at = np.flatnonzero(ok)
            if not len(at):
                continue
            mine = np.frombuffer(earlier, np.int64)
            most = overlap_bound(size, np.frombuffer(b, np.uint64)[None], n[at], bits[at])
            for c in at[most >= need[at]].tolist():
                if not np.isin(mine, np.frombuffer(right[c][8], np.int64)).any():
                    o = int(ids[c])
                    yield min(own, o), max(own, o)

    def run(batches):
        rows = (r for b in batches for r in zip(*(c.to_pylist() for c in b.columns)))
        for _, group in itertools.groupby(rows, key=lambda r: r[:3]):
            found = list(pairs(list(group)))
            if found:
                yield pa.RecordBatch.from_arrays([pa.array([p[c] for p in found], pa.int64()) for c in (0, 1)], ["x", "y"])

    return run


def _bitmaps(sets: DataFrame, percent: int) -> DataFrame:
    """(set, band, bits, keys): a set's hashed bitmap, of one size for all sets of a band, and
    its tile keys in each band."""
    starts = bands(percent, 1 << 40)

    def run(batches):
        for b in batches:
            for i, a in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                s = np.frombuffer(a, np.uint64)
                k, place = tile_places(s, percent)
                band = place >> 32
                own = np.unique(band).tolist()
                bits = [bitmap(s, starts[x + 1]).tobytes() for x in own]
                yield pa.RecordBatch.from_arrays([pa.array([i] * len(own), pa.int64()), pa.array(own, pa.int32()), pa.array(bits, pa.binary()),
                                                  pa.array([k[band == x].tobytes() for x in own], pa.binary())], ["set", "band", "bits", "keys"])

    return mapped(sets, _coalesced(run, 2000), "set long, band int, bits binary, keys binary")


def _coalesced(fn, rows: int = 50_000):
    """Join the small batches that ``fn`` yields into larger ones."""
    def run(batches):
        held, n = [], 0
        for b in fn(batches):
            held.append(b)
            n += b.num_rows
            if n >= rows:
                yield from pa.Table.from_batches(held).combine_chunks().to_batches()
                held, n = [], 0
        if held:
            yield from pa.Table.from_batches(held).combine_chunks().to_batches()
    return run


def _grouped(df: DataFrame, id_col: str, text_col: str, words: int, percent: int) -> tuple[DataFrame, DataFrame]:
    """(id, text hash, set, n) of every row, and the (node, root) rows of linked sets."""
    ship_package(df.sparkSession)
    docs = df.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"), F.xxhash64(text_col).alias("_hash"))
    scanned = stored(_scanned(docs, words, percent), "set-tiles")
    sizes = stored(scanned.where(F.col("kind") == _DOC).select("_id", "_hash", "set", "n"), "set-sizes")
    tried = _first_pairs(scanned)
    drop_stage(scanned)
    involved = stored(tried.select(F.col("x").alias("set")).unionByName(tried.select(F.col("y").alias("set"))).distinct(), "involved")
    sets = stored(_involved_sets(docs, sizes, involved, words), "sets")
    drop_stage(involved)
    links, roots = _connected(tried, sets, percent)
    more = _open_pairs(sets, roots, tried, percent)
    found = _exact(more, sets, percent, "verified")
    drop_stage(tried, sets, more)
    if found.limit(1).count():
        drop_stage(roots)
        roots = components(links.unionByName(found))
    drop_stage(links, found)
    return sizes, roots


def representatives(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """id, text_hash (xxhash64) of the one row that stands for each component: the smallest
    id, null ids last, then the smallest text hash. A row without shingles stands for itself."""
    sizes, roots = _grouped(df, id_col, text_col, words, percent)
    least = lambda *c: F.min(F.struct(*c)).alias("low")
    classes = sizes.where("n > 0").groupBy("set").agg(least(F.col("_id").isNull().alias("unnamed"), "_id", "_hash"))
    classes = classes.join(roots.withColumnRenamed("node", "set"), "set", "left").withColumn("root", F.coalesce("root", "set"))
    first = classes.groupBy("root").agg(F.min("low").alias("low")).select("low._id", "low._hash")
    alone = sizes.where("n = 0").select("_id", "_hash").distinct()
    return first.unionByName(alone).select(F.col("_id").alias(id_col), F.col("_hash").alias("text_hash"))


def similar_components(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """id, n_shingles, component_id for every row."""
    sizes, roots = _grouped(df, id_col, text_col, words, percent)
    # classes, then components of classes, are named by their smallest id
    classes = sizes.where("n > 0").groupBy("set").agg(F.min("_id").alias("low")).join(roots.withColumnRenamed("node", "set"), "set", "left").withColumn("root", F.coalesce("root", "set"))
    named = classes.join(classes.groupBy("root").agg(F.min("low").alias("component_id")), "root").select("set", "component_id")
    return sizes.join(named, "set", "left").select(F.col("_id").alias(id_col), F.col("n").alias("n_shingles"),
                                                   F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("_id")).alias("component_id"))


def query(spark, sf_dir: str) -> DataFrame:
    return similar_components(table(spark, sf_dir, "documents", "doc_id", "text"))


#: Links by word arrays; components by repeated reach (small tables only, as any self-join).
ORACLE = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                                '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
s AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
             ELSE list_distinct(list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' '))) END AS s FROM w),
e AS (SELECT doc_id, len(s) AS n, unnest(s) AS g FROM s),
p AS (SELECT a.doc_id AS x, b.doc_id AS y FROM e a JOIN e b ON a.g = b.g AND a.doc_id <> b.doc_id
      GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 85 * (a.n + b.n - count(*))),
r(doc_id, root) AS (SELECT doc_id, doc_id FROM s UNION SELECT p.x, r.root FROM r JOIN p ON p.y = r.doc_id AND r.root < p.x)
SELECT s.doc_id, CAST(len(s.s) AS BIGINT) AS n_shingles, min(r.root) AS component_id FROM s JOIN r ON r.doc_id = s.doc_id GROUP BY s.doc_id, s.s
"""
