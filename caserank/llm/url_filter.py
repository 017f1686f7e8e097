"""URL filter by a Bloom filter cascade.

Rules are (host, path, action) with action ``allow`` or ``block``; a rule fits its
host and every subdomain when the URL's path starts with the rule's path. The keys a
URL can match are (host suffix, path prefix) pairs with the label counts and path
lengths that occur among the rules, so a URL has few keys however long it is.

For each action a cascade holds the rule keys exactly over the corpus's *complete*
key universe: level 1 encodes the listed keys, level 2 the unlisted corpus keys that
level 1 lets through, level 3 the listed keys that level 2 lets through, and so on
until nothing passes wrongly. Only keys that pass a level leave the scan, so building
needs no shuffle of all keys, and judging needs no join: the cascade (a few bytes per
rule) is what tasks receive. ``MAX_RULES`` bounds it; more rules raise an error
rather than being dropped.

Edge cases: a null URL or one without ``://`` has empty host and path; an empty path
fits only rules with an empty path; without rules every verdict is the default;
repeated rules collapse, and a key listed with both actions is an error; other columns
of the input are left alone (only the id and URL columns are read); an empty table gives
no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterable

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import mapped, table

MAX_RULES = 20_000_000
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path columns of a URL; both empty without ``://``."""
    at = F.locate("://", url)
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    rest = F.coalesce(rest, F.lit(""))
    raw = F.regexp_extract(rest, r"^([^/?#]*)", 1)
    after = F.substring(rest, F.length(raw) + 1, F.length(rest))
    return F.translate(raw, _UPPER, _LOWER), F.regexp_extract(after, r"^([^?#]*)", 1)


class Bloom:
    """A plain Bloom filter over strings, double hashing from one 128-bit hash."""

    def __init__(self, keys: Iterable[str], n: int, fpr: float, seed: int):
        n = max(1, n)
        fpr = min(max(fpr, 1e-9), 0.5)
        self.m = max(64, math.ceil(-n * math.log(fpr) / math.log(2) ** 2))
        self.k = max(1, round(self.m / n * math.log(2)))
        self.seed = seed
        self.bits = np.zeros((self.m + 7) // 8, np.uint8)
        for key in keys:
            for i in self._at(key):
                self.bits[i >> 3] |= 1 << (i & 7)

    def _at(self, key: str):
        h = xxhash.xxh3_128_intdigest(key.encode("utf-8", "surrogatepass"), self.seed)
        a, b = h >> 64, (h & ((1 << 64) - 1)) | 1
        return [(a + i * b) % self.m for i in range(self.k)]

    def __contains__(self, key: str) -> bool:
        return all(self.bits[i >> 3] >> (i & 7) & 1 for i in self._at(key))


class Cascade:
    """Alternating levels; ``in`` is exact for every key of the universe it was built on."""

    def __init__(self, levels: list[Bloom]):
        self.levels = levels

    def __contains__(self, key: str) -> bool:
        for depth, level in enumerate(self.levels):
            if key not in level:
                return depth % 2 == 1
        return len(self.levels) % 2 == 1

    @property
    def nbytes(self) -> int:
        return sum(x.bits.nbytes for x in self.levels)


def _further_levels(first: Bloom, listed: set[str], passed: set[str]) -> Cascade:
    """``passed``: the unlisted corpus keys that the first level lets through."""
    levels, include, exclude = [first], passed, listed
    while include:
        level = Bloom(include, len(include), 0.5, len(levels) + 1)
        levels.append(level)
        include, exclude = {x for x in exclude if x in level}, include
    return Cascade(levels)


def build_cascades(keys: DataFrame, rules: dict[str, set[str]], universe: int) -> dict[str, Cascade]:
    """``keys``: one string column ``key`` with all corpus keys, repeated as they are.
    Only keys that pass the first level are shuffled and returned; their number
    follows the rules (rate x universe is at most about the listed keys)."""
    first = {a: Bloom(s, len(s), len(s) * math.sqrt(0.5) / max(universe, 1), 1) for a, s in rules.items()}

    def passing(batches):
        for b in batches:
            seen = set(b.column(0).to_pylist())
            out = [(a, k) for a, level in first.items() for k in seen if k in level and k not in rules[a]]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in out]), pa.array([x[1] for x in out])], ["action", "key"])

    passed: dict[str, set[str]] = {a: set() for a in rules}
    for r in mapped(keys, passing, "action string, key string").distinct().toLocalIterator():
        passed[r.action].add(r.key)
    return {a: _further_levels(first[a], rules[a], passed[a]) for a in rules}


def filter_urls(pages: DataFrame, rules: list[tuple[str, str, str]], id_col: str = "page_id", url_col: str = "url",
                default: str = "allow") -> DataFrame:
    """id, host, path, rule (the longest fitting rule's host and path, else null) and
    verdict (the rule's action, else ``default``: a URL outside every cascade is not listed)."""
    if len(rules) > MAX_RULES:
        raise ValueError(f"more than {MAX_RULES} rules")
    listed: dict[str, set[str]] = {"allow": set(), "block": set()}
    shapes = set()
    for host, path, action in rules:
        if path and not path.startswith("/"):
            raise ValueError("a rule's path is empty or starts with /")
        listed[action].add(host.lower() + path)
        shapes.add((host.count(".") + 1, len(path)))
    if listed["allow"] & listed["block"]:
        raise ValueError("a key is listed with both actions")
    shapes = sorted(shapes)
    host, path = host_and_path(F.col(url_col))
    urls = pages.select(F.col(id_col).alias("_id"), host.alias("host"), path.alias("path"))
    n_labels = F.size(F.split("host", r"\."))
    keys = F.array(*[F.when((n_labels >= n) & (F.length("path") >= k),
                            F.concat(F.substring_index("host", ".", -n), F.substring(F.col("path"), 1, k)))
                     for n, k in shapes]).cast("array<string>") if shapes else F.array().cast("array<string>")
    urls = urls.withColumn("_keys", F.filter(keys, lambda x: x.isNotNull()))
    all_keys = urls.select(F.explode("_keys").alias("key"))
    universe = all_keys.agg(F.approx_count_distinct("key")).first()[0] if shapes else 0
    cascades = build_cascades(all_keys, {a: s for a, s in listed.items() if s}, universe)

    def judge(batches):
        known: dict[str, str | None] = {}
        for b in batches:
            rule, verdict = [], []
            for own in b.column(3).to_pylist():
                best = None
                for k in own:
                    if k not in known:
                        if len(known) > 200_000:
                            known.clear()
                        known[k] = next((a for a, c in cascades.items() if k in c), None)
                    if known[k] and (best is None or (len(k), k.find("/")) > (len(best), best.find("/"))):
                        best = k
                rule.append(best)
                verdict.append(known[best] if best else default)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), pa.array(rule, pa.string()), pa.array(verdict, pa.string())],
                                             [id_col, "host", "path", "rule", "verdict"])

    id_type = urls.schema["_id"].dataType.simpleString()
    return mapped(urls, judge, f"{id_col} {id_type}, host string, path string, rule string, verdict string")


#: The registered query's fixed rules.
RULES = [("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"),
         ("com", "/fr/", "allow"), ("com", "/de/", "block")]

ORACLE = """
WITH a AS (SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
b AS (SELECT page_id, regexp_extract(rest, '^([^/?#]*)', 1) AS raw, rest FROM a),
c AS (SELECT page_id, translate(raw, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
             regexp_extract(substr(rest, length(raw) + 1), '^([^?#]*)', 1) AS path FROM b),
r(h, p, act) AS (VALUES ('org', '/', 'allow'), ('example.org', '/es/', 'block'), ('example.org', '/en/1', 'block'),
                        ('com', '/fr/', 'allow'), ('com', '/de/', 'block')),
m AS (SELECT page_id, h || p AS rule, act FROM c JOIN r ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p)),
best AS (SELECT page_id, arg_max(rule, length(rule)) AS rule, arg_max(act, length(rule)) AS act FROM m GROUP BY page_id)
SELECT c.page_id, c.host, c.path, best.rule, coalesce(best.act, 'allow') AS verdict
FROM c LEFT JOIN best ON c.page_id = best.page_id
"""


def query(spark, sf_dir: str) -> DataFrame:
    return filter_urls(table(spark, sf_dir, "pages", "page_id", "url"), RULES)
