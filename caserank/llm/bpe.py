"""BPE encoding and decoding with a pair occurrence index.

All distinct pieces of a batch are laid out as one array of symbols linked to their
neighbours. An index maps each mergeable pair to *all* its positions; pairs are taken
in ascending rank, every position of the pair is merged at once, and the lists of the
pairs that appear beside the merged symbols are updated. Positions that went stale
meanwhile are recognised by a check of their two symbols. One pass thus encodes
hundreds of thousands of distinct pieces with vectorised steps, and a bounded
cache keeps their ids for the texts that follow.

The tokenizer file is read by path (never trained, never copied): its vocabulary,
merges, end-of-word suffix and special tokens. Pieces follow the file's own
normalisation (composed form, lower case) and its split into letters, single digits
and other marks. A file without a decoder joins its token strings with spaces.

Edge cases: a null or empty text has no ids and decodes to an empty text; special
token strings inside a text become their ids; very long texts are ordinary texts; ids
appear in text order; repeated rows each keep their row; an empty table gives no rows;
only the id and text columns are read, so clashing extra names do not matter.
"""

from __future__ import annotations

import heapq
import json
import re
import unicodedata

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import mapped, table, text_batches

CACHE = 400_000
#: Python counts these four controls as white space; the tokenizer does not.
_NOT_SPACE = re.compile("[\x1c-\x1f]")
_SPACE = regex.compile(r"[\t-\r \x85\xa0  -     　]+")


def byte_symbols() -> list[str]:
    """The printable stand-in of each byte value in byte-level vocabularies: printable
    bytes stand for themselves, the others take code points from 256 on."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    out, n = [], 256
    for b in range(256):
        out.append(chr(b) if b in plain else chr(n))
        n += b not in plain
    return out


class PairIndexBPE:
    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.vocab: dict[str, int] = model["vocab"]
        self.suffix = model.get("end_of_word_suffix") or ""
        self.tokens = {i: t for t, i in self.vocab.items()}
        self.special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        self.tokens |= {i: t for t, i in self.special.items()}
        self.cut = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        pattern = next(p["pattern"]["Regex"] for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        self.pieces = regex.compile(pattern)
        names = byte_symbols()
        self.inner = np.array([self.vocab.get(c, -1) for c in names], np.int64)
        self.final = np.array([self.vocab.get(c + self.suffix, -1) for c in names], np.int64)
        pairs = [(m if isinstance(m, list) else m.split(" ")) for m in model["merges"]]
        self.left = np.array([self.vocab[a] for a, _ in pairs], np.int64)
        self.right = np.array([self.vocab[b] for _, b in pairs], np.int64)
        self.made = np.array([self.vocab[a + b] for a, b in pairs], np.int64)
        self.base = max(self.tokens) + 1
        keys = self.left * self.base + self.right
        order = np.argsort(keys, kind="stable")
        self.keys, self.ranks = keys[order], order
        self.cache: dict[str, bytes] = {}

    def _rank(self, sym, nxt, at):
        """Positions of ``at`` that start a mergeable pair, and the pair's rank."""
        key = sym[at] * self.base + sym[nxt[at]]
        i = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        hit = self.keys[i] == key
        return at[hit], self.ranks[i[hit]]

    def encode_pieces(self, pieces: list[bytes]) -> list[bytes]:
        """Ids of each piece (non-empty UTF-8), as packed little-endian 32-bit integers."""
        size = np.array([len(p) for p in pieces], np.int64)
        ends = np.cumsum(size)
        starts = ends - size
        flat = np.frombuffer(b"".join(pieces), np.uint8)
        n = len(flat)
        sym = self.inner[flat]
        sym[ends - 1] = self.final[flat[ends - 1]]
        nxt = np.arange(1, n + 1)
        nxt[ends - 1] = -1
        prv = np.arange(-1, n - 1)
        prv[starts] = -1
        alive = sym >= 0
        occurrences: dict[int, list[np.ndarray]] = {}
        active: list[int] = []

        def note(at):
            at, rank = self._rank(sym, nxt, at)
            if not len(at):
                return
            order = np.argsort(rank, kind="stable")
            at, rank = at[order], rank[order]
            cuts = np.flatnonzero(np.diff(rank)) + 1
            firsts = rank[np.concatenate(([0], cuts))].tolist()
            bounds = [0, *cuts.tolist(), len(at)]
            for k, r in enumerate(firsts):
                if r not in occurrences:
                    occurrences[r] = []
                    heapq.heappush(active, r)
                occurrences[r].append(at[bounds[k]:bounds[k + 1]])

        note(np.flatnonzero(nxt >= 0))
        while active:
            r = heapq.heappop(active)
            lists = occurrences.pop(r)
            at = lists[0] if len(lists) == 1 else np.unique(np.concatenate(lists))
            a, b, new = self.left[r], self.right[r], self.made[r]
            to = nxt[at]
            ok = alive[at] & (to >= 0) & (sym[at] == a)
            ok &= sym[to] == b
            at, to = at[ok], to[ok]
            if not len(at):
                continue
            if a == b:  # overlapping pairs: every other one from the left of a run
                place = np.arange(len(at))
                chained = np.concatenate(([False], at[1:] == to[:-1]))
                start = np.maximum.accumulate(np.where(chained, 0, place))
                odd = (place - start) % 2 == 1
                at, to = at[~odd], to[~odd]
            sym[at] = new
            alive[to] = False
            after = nxt[to]
            nxt[at] = after
            has = after >= 0
            prv[after[has]] = at[has]
            before = prv[at]
            near = np.concatenate((before[before >= 0], at[has]))
            if len(near):
                note(np.unique(near))
        ids = sym[alive].astype("<u4")
        upto = np.concatenate(([0], np.cumsum(alive)))
        packed = ids.tobytes()
        return [packed[4 * i:4 * j] for i, j in zip(upto[starts].tolist(), upto[ends].tolist())]

    def _normal(self, word: str) -> str:
        if word.isascii():
            return word.lower()
        word = unicodedata.normalize("NFC", word)
        # lower case by character: no rule for a final sigma
        return "".join(c.lower() for c in word) if "Σ" in word else word.lower()

    def learn(self, words: set[str]) -> None:
        """Fill the cache for white-space delimited ``words``."""
        split = {w: [p.encode("utf-8", "surrogatepass") for p in self.pieces.findall(self._normal(w))] for w in words}
        distinct = list({p for ps in split.values() for p in ps})
        ids = dict(zip(distinct, self.encode_pieces(distinct))) if distinct else {}
        for w, ps in split.items():
            self.cache[w] = ids[ps[0]] if len(ps) == 1 else b"".join(map(ids.__getitem__, ps))

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """Packed ids of each text."""
        parts: list[list] = []
        for t in texts:
            own: list = []
            for k, s in enumerate(self.cut.split(t) if self.cut and t and any(x in t for x in self.special) else [t or ""]):
                if k % 2:
                    own.append(self.special[s].to_bytes(4, "little"))
                else:
                    own.extend(filter(None, _SPACE.split(s)) if _NOT_SPACE.search(s) else s.split())
            parts.append(own)
        if len(self.cache) > CACHE:
            self.cache.clear()
        new = {w for own in parts for w in own if w.__class__ is str}.difference(self.cache)
        if new:
            self.learn(new)
        get = self.cache
        return [b"".join([get[w] if w.__class__ is str else w for w in own]) for own in parts]

    def decode(self, ids: list[int]) -> str:
        """Token strings joined by spaces: the form of a file without a decoder."""
        return " ".join(map(self.tokens.__getitem__, ids))


def encode(df: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", decoded: bool = True) -> DataFrame:
    """id, ids array<int> and, if ``decoded``, the text decoded from those ids."""
    def run(batches):
        bpe = PairIndexBPE(tokenizer_path)
        for b in text_batches(batches, "_text", 8 << 20):
            packed = bpe.encode(b.column(1).to_pylist())
            ids = np.frombuffer(b"".join(packed), "<i4")
            ends = np.concatenate(([0], np.cumsum([len(p) // 4 for p in packed])))
            for lo, hi in _slices(ends, 1 << 20):
                own = ids[ends[lo]:ends[hi]]
                cols = [b.column(0).slice(lo, hi - lo), pa.ListArray.from_arrays(pa.array(ends[lo:hi + 1] - ends[lo], pa.int32()), pa.array(own))]
                if decoded:
                    values, cut = own.tolist(), (ends[lo:hi + 1] - ends[lo]).tolist()
                    cols.append(pa.array([bpe.decode(values[i:j]) for i, j in zip(cut, cut[1:])], pa.string()))
                yield pa.RecordBatch.from_arrays(cols, [id_col, "ids", "decoded"][:len(cols)])

    src = df.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))
    kind = src.schema["_id"].dataType.simpleString()
    return mapped(src, run, f"{id_col} {kind}, ids array<int>" + (", decoded string" if decoded else ""))


def _slices(ends: np.ndarray, limit: int):
    """Runs of rows with about ``limit`` ids, so that results leave in bounded batches."""
    part = ends[:-1] // limit
    cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), len(part)]
    return [(i, j) for i, j in zip(cuts, cuts[1:]) if j > i]


def query(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    out = encode(table(spark, sf_dir, "documents", "doc_id", "text"), public_tokenizers.path("word_bpe_49k.json"))
    return out.select("doc_id", F.size("ids").cast("long").alias("n_tokens"),
                      F.sha2(F.concat_ws(" ", F.col("ids").cast("array<string>")).cast("binary"), 256).alias("ids_sha256"),
                      F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))
