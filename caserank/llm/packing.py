"""Best-fit packing of tokenised documents into fixed-length sequences, improved by a
swap-based local search.

Documents are tokenised where they are read; only (row, piece, length, checksum) rows go
on. Full pieces are sequences of their own. The others are dealt at random to
groups of bounded size, and each group packs itself: best fit in descending length, then
local search between underfull bins. A step moves a document, exchanges one for one,
two for one or one for two, always towards the fuller bin, so the sum of squared fills grows
with every step and the search ends by itself; all documents of all open bins take
part, by their lengths, of which a bin has few. An emptiest bin that loses its last
document is saved. Bins that stay loose in their group are dealt anew and packed once
more, until that leaves as many loose bins, so the loss from grouping is a few bins
however many groups there are.

Edge cases: a null or empty text is its end token alone; a document longer than a sequence
is cut from the end into full pieces, so only its first piece may be shorter; ties are
broken by row; repeated rows are packed each; an empty table gives no rows; only the id
and text columns are read, so clashing extra names do not matter.
"""

from __future__ import annotations

import array
import itertools
import json
import re
import zlib
from collections.abc import Iterable

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import ship_package
from .common import KEPT, mapped, one_thread, stored, table, text_batches

CAPACITY = 2048
#: Pieces to a group.
GROUP = 8192
#: A bin below this share of its capacity is dealt anew.
LOOSE = 0.95
_WHITE = r"\t-\r \x85\xa0  -     　"
#: ASCII marks but the apostrophe, which takes letters into its piece.
_MARKS = r"!-&(-/:-@\[-`{-~"
#: Letters that every Unicode version knows as such.
_LETTERS = "[A-Za-zÀ-ÖØ-öø-ɏ]+"
#: A word, marks, a line end and a word with marks, all but the first as they may be missing.
_WORDS = re.compile(f"({_LETTERS})([{_MARKS}]*)(?:(\n)({_LETTERS})([{_MARKS}]*))?").fullmatch
_TWO_SPACES = re.compile(r"\s\s")
_CHUNK = re.compile(f"[{_WHITE}]*[^{_WHITE}]+|[{_WHITE}]+")
#: Chunks that a cache takes before it becomes the older of two.
CACHE = 500_000
PIECE = ["_id", "_row", "piece", "start", "length", "ids_crc32"]


def _byte_signs() -> dict[int, str]:
    """The sign that a byte-level vocabulary writes for each byte."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in set(own)]
    return {b: chr(b) for b in own} | {b: chr(256 + k) for k, b in enumerate(others)}


class ChunkTokenizer:
    """Ids of texts from a byte-level BPE file, by a cache over chunks.

    The tokenizer never joins a character with white space that follows it, so a text may
    be cut before every run of white space and its chunks encoded one by one; the
    library encodes each distinct chunk of a batch once. Most chunks are words with at most
    marks or a line end behind them, which are token pieces of their own: such words go
    to the library's BPE many to a call, without the search for pieces, and only they
    and the remaining chunks are kept; their combinations are put together anew."""

    def __init__(self, path: str):
        one_thread()
        from tokenizers import Tokenizer, models, pre_tokenizers

        self.lib = Tokenizer.from_file(path)
        self.lib.no_truncation()
        self.lib.no_padding()
        self.special = [t.content for t in self.lib.get_added_tokens_decoder().values()]
        model = json.loads(self.lib.to_str())["model"]
        # a word comes once, so the library's own cache would only cost time
        plain = {k: model[k] for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "fuse_unk", "byte_fallback", "ignore_merges") if model.get(k) is not None}
        self.words = Tokenizer(models.BPE(model["vocab"], [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]], cache_capacity=0, **plain))
        self.words.pre_tokenizer = pre_tokenizers.CharDelimiterSplit(" ")
        self.signs = _byte_signs()
        self.begins = np.zeros(self.lib.get_vocab_size(), bool)  # tokens that begin with a space
        self.begins[[i for t, i in self.lib.get_vocab().items() if t.startswith(self.signs[32])]] = True
        # words and chunks as they are, and those that stand behind one space; what a full cache
        # knew stays for one more filling, so common ones are never encoded again
        self.plain: dict[str, bytes] = {}
        self.spaced: dict[str, bytes] = {}
        self.older: tuple[dict[str, bytes], dict[str, bytes]] = ({}, {})

    def _encode(self, texts: list[str]) -> list[bytes]:
        out = []
        for lo in range(0, len(texts), 4096):
            out += [array.array("I", e.ids).tobytes() for e in self.lib.encode_batch_fast(texts[lo:lo + 4096], add_special_tokens=False)]
        return out

    def _encode_words(self, words: list[str], before: str) -> list[bytes]:
        """Ids of words (``_LETTERS`` only), each a token piece with what stands ``before`` it."""
        if not words:
            return []
        signs = [before + w if w.isascii() else before + w.encode().decode("latin-1").translate(self.signs) for w in words]
        texts = [" ".join(signs[lo:lo + 1024]) for lo in range(0, len(signs), 1024)]
        if before:  # and nowhere else a space
            ids = np.concatenate([np.array(e.ids, "<u4") for e in self.words.encode_batch_fast(texts, add_special_tokens=False)])
            starts = np.flatnonzero(self.begins[ids])
        else:
            found = self.words.encode_batch(texts, add_special_tokens=False)
            ids = np.concatenate([np.array(e.ids, "<u4") for e in found])
            starts = np.flatnonzero(np.concatenate([np.diff(e.word_ids, prepend=-1) for e in found]))
        starts, ids = (4 * starts).tolist(), ids.tobytes()
        return [ids[x:y] for x, y in zip(starts, [*starts[1:], len(ids)])]

    def _unknown(self, keys, spaced: bool) -> set[str]:
        """Those of the keys that the caches lack; what only the older one has comes to the newer."""
        cache, older = (self.spaced if spaced else self.plain), self.older[spaced]
        others = set(itertools.filterfalse(cache.__contains__, keys))
        again = set(filter(older.__contains__, others))
        cache.update((c, older[c]) for c in again)
        return others.difference(again)

    def _learn(self, keys: set[str], spaced: bool, words: bool) -> None:
        """Put words or whole chunks into the caches, by the library."""
        new = list(self._unknown(keys, spaced))
        if new:
            ids = self._encode_words(new, self.signs[32] if spaced else "") if words else self._encode([" " + c for c in new] if spaced else new)
            (self.spaced if spaced else self.plain).update(zip(new, ids))

    def _learn_all(self, plain: Iterable[str], spaced: Iterable[str]) -> None:
        """Put chunks into the caches: those at the start of a text or of a cut, and those behind a space."""
        parts, odd, words = ([], []), ([], []), (set(), set())
        marks: set[str] = {"\n"}
        for of, chunks in enumerate((plain, spaced)):
            for c in self._unknown(chunks, bool(of)):
                if c.isalpha() and c.isascii():
                    words[of].add(c)
                elif m := _WORDS(c):
                    w, n, line, v, k = m.groups("")
                    words[of].add(w)
                    marks.update((n, k))
                    if v:
                        words[0].add(v)
                    parts[of].append((c, w, n, line, v, k))
                else:
                    odd[of].append(c)
        marks.discard("")
        self._learn(marks, False, False)
        for of in (0, 1):
            self._learn(words[of], bool(of), True)
            self._learn(odd[of], bool(of), False)
        bare = self.plain
        bare[""] = b""
        for of, cache in enumerate((self.plain, self.spaced)):
            cache.update([(c, cache[w] + bare[n] + bare[line] + bare[v] + bare[k]) for c, w, n, line, v, k in parts[of]])

    def _encode_spaced(self, texts: list[str]) -> list[bytes]:
        """Packed ids of texts whose white space is single spaces or line ends alone. Arrow
        splits them and numbers their chunks, so only distinct chunks become Python objects."""
        split = pa.compute.split_pattern(pa.array(texts, pa.large_string()), " ")
        coded = split.flatten().dictionary_encode()
        chunks, code, ends = coded.dictionary.to_numpy(zero_copy_only=False).tolist(), coded.indices.to_numpy(), split.offsets.to_numpy()
        starts = ends[:-1]  # a text's first chunk has no space before it
        later = np.ones(len(code), bool)
        later[starts] = False
        used = np.zeros(len(chunks), bool)
        used[code[later]] = True
        behind = list(itertools.compress(chunks, used))
        first = [chunks[c] for c in code[starts]]
        own = list(map(self.spaced.get, behind))
        new = [i for i, ids in enumerate(own) if ids is None]
        self._learn_all(set(first).difference([""]), [behind[i] for i in new])
        for i in new:
            own[i] = self.spaced[behind[i]]
        place = np.cumsum(used) - 1
        at = np.where(later, place[code], 0)
        at[starts] = np.arange(len(behind), len(behind) + len(first))
        own += [self.plain[c] if c else b"" for c in first]
        size = np.fromiter(map(len, own), np.int64, len(own)) // 4
        begin = np.cumsum(size) - size
        ids = np.frombuffer(b"".join(own), "<u4")
        n = size[at]
        stop = np.cumsum(n)
        ids = ids[np.repeat(begin[at] - (stop - n), n) + np.arange(stop[-1])]
        stop = stop[ends[1:] - 1].tolist()
        return [ids[x:y].tobytes() for x, y in zip([0, *stop], stop)]

    def _encode_cut(self, texts: list[str]) -> list[bytes]:
        """Packed ids of texts with longer runs of white space."""
        cuts = [_CHUNK.findall(t) for t in texts]
        self._learn_all(set().union(*cuts), ())
        return [b"".join(map(self.plain.__getitem__, chunks)) for chunks in cuts]

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """Packed little-endian 32-bit ids of each text."""
        if len(self.plain) + len(self.spaced) > CACHE:
            self.older, self.plain, self.spaced = (self.plain, self.spaced), {}, {}
        ways: tuple[list[int], list[int], list[int]] = ([], [], [])
        for i, t in enumerate(texts):
            if t:
                ways[0 if any(s in t for s in self.special) else 1 if _TWO_SPACES.search(t) else 2].append(i)
        out = [b""] * len(texts)
        for places, encode in zip(ways, (self._encode, self._encode_cut, self._encode_spaced)):
            if places:
                for i, ids in zip(places, encode([texts[i] for i in places])):
                    out[i] = ids
        return out


_OPEN: dict[str, ChunkTokenizer] = KEPT.setdefault("packing", {})


def tokenizer(path: str) -> ChunkTokenizer:
    """The worker's tokenizer of a file; its cache serves all tasks of packing that the worker
    runs, until one of another operator."""
    if path not in _OPEN:
        _OPEN[path] = ChunkTokenizer(path)
    return _OPEN[path]


def cut(n: int, capacity: int = CAPACITY) -> list[tuple[int, int]]:
    """(start, length) of the pieces of ``n`` tokens; only the first may be short."""
    if n <= capacity:
        return [(0, n)]
    first = n % capacity
    starts = ([0] if first else []) + list(range(first, n, capacity))
    return [(s, (first if first and s == 0 else capacity)) for s in starts]


def tokenised_pieces(df: DataFrame, tokenizer_path: str, capacity: int, end_id: int, id_col: str, text_col: str) -> DataFrame:
    """One row per piece; a full piece is a sequence by itself, numbered below zero by
    task and place (the table is written once, so numbers stay)."""
    def run(batches):
        tok = tokenizer(tokenizer_path)
        end = end_id.to_bytes(4, "little")
        row = TaskContext.get().partitionId() << 40
        alone = -row
        for b in text_batches(batches, "_text"):
            rows: list[tuple] = []
            take: list[int] = []
            for i, ids in enumerate(tok.encode(b.column(1).to_pylist())):
                ids += end
                for k, (start, n) in enumerate(cut(len(ids) // 4, capacity)):
                    alone -= n == capacity
                    rows.append((row, k, start, n, zlib.crc32(ids[4 * start:4 * (start + n)]), alone if n == capacity else None))
                    take.append(i)
                row += 1
            cols = list(zip(*rows))
            yield pa.RecordBatch.from_arrays(
                [b.column(0).take(pa.array(take)), pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int32()), *(pa.array(c, pa.int64()) for c in cols[2:])],
                [*PIECE, "sequence_id"])

    src = df.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))
    kind = src.schema["_id"].dataType.simpleString()
    return mapped(src, run, f"_id {kind}, _row long, piece int, start long, length long, ids_crc32 long, sequence_id long", "packing")


class Bins:
    """Bins of one group: documents are indices into ``size``."""

    def __init__(self, size: np.ndarray, capacity: int):
        self.size, self.capacity = size.astype(np.int64), capacity
        self.of = np.full(len(size), -1, np.int64)  # bin of each document
        self.members: list[list[int]] = []
        self.fill: list[int] = []

    def best_fit(self) -> None:
        """Descending length, each into the fullest bin with room. ``room`` is a bit set
        of the free lengths present, so a lookup is one shift."""
        by_free: dict[int, list[int]] = {}
        room = 0
        for d in np.argsort(-self.size, kind="stable").tolist():
            n = int(self.size[d])
            above = room >> n
            if above:
                free = n + (above & -above).bit_length() - 1
                b = by_free[free].pop()
                if not by_free[free]:
                    room &= ~(1 << free)
            else:
                free, b = self.capacity, len(self.members)
                self.members.append([])
                self.fill.append(0)
            self.members[b].append(d)
            self.of[d] = b
            self.fill[b] += n
            if free > n:
                by_free.setdefault(free - n, []).append(b)
                room |= 1 << (free - n)

    def _put(self, docs, frm: int, to: int) -> None:
        for d in docs:
            self.members[frm].remove(d)
            self.members[to].append(d)
            self.of[d] = to
            self.fill[frm] -= int(self.size[d])
            self.fill[to] += int(self.size[d])

    def improve(self) -> None:
        """Local search: the emptiest bin gives to fuller ones until it is empty or no
        step raises the squared fill; then the next. All bins give again, since their
        partners have changed, until a round changes nothing. Stops at the lower bound."""
        least = -(-int(self.size.sum()) // self.capacity)
        changed = True
        while changed and sum(map(bool, self.members)) > least:
            changed = False
            free = self.capacity - np.array(self.fill)
            is_open = (free > 0) & np.array([bool(m) for m in self.members])
            for giver in sorted(np.flatnonzero(is_open).tolist(), key=lambda b: self.fill[b]):
                while self.members[giver] and free[giver] > 0:
                    is_open[giver] = False
                    to = self._step(giver, is_open, free)
                    is_open[giver] = True
                    if to is None:
                        break
                    changed = True
                    for b in (giver, to):
                        free[b] = self.capacity - self.fill[b]
                        is_open[b] = free[b] > 0 and bool(self.members[b])
                if not self.members[giver] and sum(map(bool, self.members)) <= least:
                    return

    def _by_size(self, bin_: int) -> dict[int, list[int]]:
        """A bin's documents by length. Lengths in a bin are few: their sum is its capacity."""
        out: dict[int, list[int]] = {}
        for d in self.members[bin_]:
            out.setdefault(int(self.size[d]), []).append(d)
        return out

    @staticmethod
    def _pairs(sizes: dict[int, list[int]]) -> list[tuple[int, int]]:
        """Pairs of lengths that two documents of a bin have."""
        each = sorted(sizes)
        return [(x, y) for i, x in enumerate(each) for y in each[i:] if x != y or len(sizes[x]) > 1]

    def _step(self, giver: int, is_open: np.ndarray, free: np.ndarray):
        """One improving step towards a bin at least as full; the bin that gained, or None."""
        bins = np.flatnonzero(is_open & (free <= free[giver]))
        if not len(bins):
            return None
        own = self._by_size(giver)
        for n in sorted(own, reverse=True):  # move: into the fullest bin with room
            fits = bins[free[bins] >= n]
            if len(fits):
                to = int(fits[np.argmin(free[fits])])
                self._put([own[n][0]], giver, to)
                return to
        partner = np.zeros(len(self.members), bool)
        partner[bins] = True
        docs = np.flatnonzero(partner[self.of])
        # equal lengths in equally full bins are one choice
        kind, at = np.unique(self.size[docs] * (self.capacity + 1) + free[self.of[docs]], return_index=True)
        docs, size, room = docs[at], kind // (self.capacity + 1), kind % (self.capacity + 1)
        best = (0, None, None)
        for give in [(n,) for n in own] + self._pairs(own):
            gain = sum(give) - size  # one or two for one
            ok = (gain > best[0]) & (gain <= room)
            if ok.any():
                i = int(np.argmax(np.where(ok, gain, 0)))
                best = (int(gain[i]), give, [int(docs[i])])
        if best[1] is None:  # one for two, of one bin
            longest = max(own)
            for b in bins.tolist():
                theirs = self._by_size(b)
                for x, y in self._pairs(theirs):
                    if x + y >= longest:
                        continue
                    fits = [n for n in own if best[0] < n - x - y <= free[b]]
                    if fits:
                        best = (max(fits) - x - y, (max(fits),), [theirs[x][0], theirs[y][-1]])
        if best[1] is None:
            return None
        give = [own[n].pop() for n in best[1]]
        to = int(self.of[best[2][0]])
        self._put(best[2], to, giver)
        self._put(give, giver, to)
        return to

    def places(self):
        """Bin number, offset and bin fill of each document."""
        off = np.zeros(len(self.size), np.int64)
        for m in self.members:
            at = 0
            for d in sorted(m):
                off[d] = at
                at += int(self.size[d])
        return self.of, off, np.array(self.fill, np.int64)[self.of] if len(self.of) else self.of


def pack_group(size: np.ndarray, capacity: int = CAPACITY):
    bins = Bins(size, capacity)
    bins.best_fit()
    bins.improve()
    return bins.places()


def _pack_round(pieces: DataFrame, n: int, round_no: int, capacity: int) -> DataFrame:
    """Deal ``n`` pieces to groups and pack each. A group's size does not grow with the data."""
    ship_package(pieces.sparkSession)
    groups = max(1, -(-n // GROUP))
    schema = [f"{f.name} {f.dataType.simpleString()}" for f in pieces.schema if f.name in PIECE]

    def run(key, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["_row", "piece"], kind="stable", ignore_index=True)
        bin_, off, fill = pack_group(pdf["length"].to_numpy(), capacity)
        return pdf[PIECE].assign(sequence_id=(round_no << 54) + (int(key[0]) << 16) + bin_, offset=off, fill=fill)

    return (pieces.select(*PIECE, F.pmod(F.xxhash64("_row", "piece", F.lit(round_no)), F.lit(groups)).alias("_group"))
            .groupBy("_group").applyInPandas(run, ", ".join(schema) + ", sequence_id long, offset long, fill long"))


def pack(df: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, piece, start, length, ids_crc32, sequence_id, offset: one row per piece."""
    pieces = stored(tokenised_pieces(df, tokenizer_path, capacity, end_id, id_col, text_col), "pieces")
    short = pieces.where(F.col("sequence_id").isNull())
    loose, done, before, round_no = short, [], None, 1
    while True:  # until dealing anew leaves as many loose bins
        packed = stored(_pack_round(loose, loose.count(), round_no, capacity), "packed")
        free = F.col("fill") < int(LOOSE * capacity)
        bins = packed.where(free).select("sequence_id").distinct().count()
        if bins <= 1 or (before is not None and bins >= before):
            done.append(packed)
            break
        done.append(packed.where(~free))
        loose, before, round_no = packed.where(free), bins, round_no + 1
    out = pieces.where(F.col("sequence_id").isNotNull()).withColumn("offset", F.lit(0).cast("long"))
    for packed in done:
        out = out.unionByName(packed.drop("fill"))
    return out.select(F.col("_id").alias(id_col), "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def query(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack(table(spark, sf_dir, "documents", "doc_id", "text"), public_tokenizers.path("byte_bpe_50k.json"))
