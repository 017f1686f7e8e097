"""Quality rules as weak supervision, in DataFrame expressions only.

Every rule looks at text statistics and votes good (1), bad (-1) or abstains (0).
Expectation-maximisation over the table of vote patterns (at most 3^rules rows,
whatever the corpus size) estimates how often each rule casts each vote on good and
on bad documents; a document's posterior probability of being good replaces
"all rules must pass".

Main path: one scan computes statistics and votes, one aggregation counts patterns,
then small aggregations over the pattern table, one per EM step, each returning three sums
per rule. Nothing is
shuffled but pattern counts.

Edge cases: a null text is an empty one; a text without words has no votes but the
length rule's; repeated rows are judged alike and each keeps its row; an empty table
gives no rows; only the id and text columns are read, so clashing extra names do not
matter. Windows of three words are compared by a 64-bit hash.
"""

from __future__ import annotations

import functools
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WORD_SEPARATORS, stored, table

SEP = r"[\x20\x09-\x0D]"
STATS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_marks", "n_shouts", "n_exclaim",
         "n_distinct_windows"]
#: Up to so many different repeated windows are looked up one by one; more are sorted.
FEW = 24


def let(value: Column, body) -> Column:
    """Bind ``value`` once and use it in ``body``."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _span(starts: Column) -> Column:
    """Words covered by windows of three that start at the ascending ``starts``."""
    return let(starts, lambda p: F.aggregate(
        F.transform(p, lambda x, j: F.least(F.coalesce(F.get(p, j + 1) - x, F.lit(3)), F.lit(3))), F.lit(0), lambda a, x: a + x))


def _covered(hashes: Column) -> Column:
    """Words inside windows of three that occur twice or more, from the window hashes
    in text order. Where few windows are repeated their places are looked up; where
    many are, sorting (hash, place) pairs brings equal windows together."""
    def by_lookup(twice):
        return _span(F.filter(F.sequence(F.lit(0), F.size(hashes) - 1), lambda i: F.array_contains(twice, F.get(hashes, i))))

    def by_sorting(pairs):
        again = F.filter(pairs, lambda e, j: e["h"].eqNullSafe(F.get(pairs, j - 1)["h"]) | e["h"].eqNullSafe(F.get(pairs, j + 1)["h"]))
        return _span(F.sort_array(F.transform(again, lambda e: e["i"])))

    def some(ordered):
        twice = F.array_distinct(F.filter(ordered, lambda h, j: h.eqNullSafe(F.get(ordered, j + 1))))
        return let(twice, lambda t: F.when(F.size(t) <= FEW, by_lookup(t)).otherwise(
            let(F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i")))), by_sorting)))

    return let(F.sort_array(hashes), some)


def text_stats(df: DataFrame, kept: str | Column = "doc_id", text_col: str = "text") -> DataFrame:
    """``kept`` as ``_id`` and the text statistics every rule reads (``STATS``, all long).
    ``n_marks``: characters but letters, digits and white space; ``n_shouts``: runs of
    three capitals or more."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    trimmed = F.btrim(text, F.lit(WORD_SEPARATORS))
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    base = df.select(
        (F.col(kept) if isinstance(kept, str) else kept).alias("_id"),
        F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, f"{SEP}+")).alias("_words"),
        F.regexp_count(text, F.lit(r"[#*$%&|<>]")).alias("n_symbols"),
        let(lines, lambda x: F.struct(F.size(x).alias("n"), (F.size(x) - F.size(F.array_distinct(x))).alias("d"))).alias("_lines"),
        F.regexp_count(text, F.lit(r"[^\p{L}\p{N}\s]")).alias("n_marks"),
        F.regexp_count(text, F.lit(r"\p{Lu}{3,}")).alias("n_shouts"),
        F.regexp_count(text, F.lit("!")).alias("n_exclaim"),
    )
    w = F.col("_words")
    hashes = F.transform(F.sequence(F.lit(0), F.size(w) - 3),
                         lambda i: F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)))

    def windows(h):
        return let(F.size(F.array_distinct(h)), lambda n: F.struct(
            n.alias("n"), F.when(n == F.size(h), F.lit(0)).otherwise(_covered(h)).alias("covered")))

    none = F.struct(F.lit(0).alias("n"), F.lit(0).alias("covered"))
    base = base.withColumn("_windows", F.when(F.size(w) >= 3, let(hashes, windows)).otherwise(none))
    out = base.select("_id", F.size(w).alias("n_words"), F.length(F.array_join(w, "")).alias("word_chars"), "n_symbols",
                      F.col("_lines.d").alias("n_dup_lines"), F.col("_windows.covered").alias("n_repeat_words"),
                      F.col("_lines.n").alias("n_lines"), "n_marks", "n_shouts", "n_exclaim",
                      F.col("_windows.n").alias("n_distinct_windows"))
    return out.select("_id", *[F.col(c).cast("long").alias(c) for c in STATS])


@dataclass(frozen=True)
class Rule:
    """``value`` is compared with two thresholds; between them the rule abstains.
    ``bad_high``: large values are bad (else small ones)."""

    name: str
    value: Column
    good: float
    bad: float

    def vote(self) -> Column:
        high = self.bad > self.good
        bad = self.value >= self.bad if high else self.value <= self.bad
        good = self.value <= self.good if high else self.value >= self.good
        return F.coalesce(F.when(bad, -1).when(good, 1), F.lit(0)).cast("tinyint")


def default_rules() -> list[Rule]:
    def share(a: str, b: str) -> Column:
        return F.try_divide(F.col(a), F.col(b))

    return [
        Rule("length", F.col("n_words"), good=100, bad=20),
        Rule("symbols", share("n_symbols", "n_words"), good=0.02, bad=0.2),
        Rule("marks", share("n_marks", "word_chars"), good=0.06, bad=0.1),
        Rule("repeated_words", share("n_repeat_words", "n_words"), good=0.1, bad=0.4),
        Rule("distinct_windows", share("n_distinct_windows", "n_words"), good=0.9, bad=0.7),
        Rule("repeated_lines", share("n_dup_lines", "n_lines"), good=0.05, bad=0.4),
        Rule("capitals", share("n_shouts", "n_words"), good=0.02, bad=0.2),
        Rule("exclamations", share("n_exclaim", "n_words"), good=0.05, bad=0.4),
    ]


@dataclass
class VoteModel:
    """P(good) and, by rule, P(vote | good) and P(vote | bad) for votes -1, 0, 1."""

    prior: float
    by_good: list[dict[int, float]]
    by_bad: list[dict[int, float]]


def posterior(votes: list[str], model: VoteModel) -> Column:
    """P(good | votes); log odds stay finite, as no probability is 0 or 1."""
    def odds(j: int) -> Column:
        g, b = model.by_good[j], model.by_bad[j]
        v = F.col(votes[j])
        ratio = [F.log(F.lit(g[k] / b[k])) for k in (-1, 0, 1)]
        return F.when(v == -1, ratio[0]).when(v == 0, ratio[1]).otherwise(ratio[2])

    total = functools.reduce(lambda a, b: a + b, (odds(j) for j in range(len(votes))), F.log(F.lit(model.prior / (1 - model.prior))))
    return 1 / (1 + F.exp(-F.greatest(F.least(total, F.lit(500.0)), F.lit(-500.0))))


def fit_votes(patterns: DataFrame, votes: list[str], steps: int = 12, pseudo: float = 2.0, tol: float = 1e-4) -> VoteModel:
    """EM over (votes..., n). Each step is one aggregation over at most 3^rules rows.
    ``pseudo``: weight of the starting beliefs (a rule seldom calls a good document
    bad, and catches some of the bad ones), which also keeps probabilities inside (0, 1).
    Each kind of junk is seen by two rules or more: a lone rule's votes could not tell
    a rare kind of bad document from an unusual good one."""
    start_good = {-1: 0.005, 0: 0.195, 1: 0.8}
    start_bad = {-1: 0.3, 0: 0.2, 1: 0.5}
    model = VoteModel(0.9, [dict(start_good) for _ in votes], [dict(start_bad) for _ in votes])
    for _ in range(steps):
        each = patterns.withColumn("p", posterior(votes, model)).select("n", "p", F.posexplode(F.array(*votes)).alias("rule", "vote"))
        sums = {(r.rule, r.vote): (r.g, r.b) for r in each.groupBy("rule", "vote").agg(
            F.sum(F.col("n") * F.col("p")).alias("g"), F.sum(F.col("n") * (1 - F.col("p"))).alias("b")).collect()}
        if not sums:
            return model
        at = lambda j, k: sums.get((j, k), (0.0, 0.0))
        g, b = (sum(at(0, k)[c] for k in (-1, 0, 1)) for c in (0, 1))
        new = VoteModel((g + 0.9 * pseudo) / (g + b + pseudo), [], [])
        for j in range(len(votes)):
            new.by_good.append({k: (at(j, k)[0] + pseudo * start_good[k]) / (g + pseudo) for k in (-1, 0, 1)})
            new.by_bad.append({k: (at(j, k)[1] + pseudo * start_bad[k]) / (b + pseudo) for k in (-1, 0, 1)})
        moved = max(abs(new.prior - model.prior), *(abs(new.by_bad[j][k] - model.by_bad[j][k]) for j in range(len(votes)) for k in (-1, 0, 1)))
        model = new
        if moved < tol:
            break
    return model


def _judged(df: DataFrame, kept: str | Column, text_col: str, rules: list[Rule], threshold: float) -> DataFrame:
    votes = [f"vote_{r.name}" for r in rules]
    stats = text_stats(df, kept, text_col)
    voted = stored(stats.select("*", *[r.vote().alias(v) for r, v in zip(rules, votes)]), "quality-votes")
    patterns = stored(voted.groupBy(*votes).agg(F.count(F.lit(1)).alias("n")).coalesce(1), "vote-patterns")
    model = fit_votes(patterns, votes)
    return voted.withColumn("p_good", posterior(votes, model)).withColumn("good", F.col("p_good") >= threshold)


def judge(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules: list[Rule] | None = None,
          threshold: float = 0.5) -> DataFrame:
    """id, the statistics, one ``vote_<rule>`` column each, ``p_good`` and ``good``."""
    return _judged(df, id_col, text_col, rules or default_rules(), threshold).withColumnRenamed("_id", id_col)


def passing(df: DataFrame, text_col: str = "text", rules: list[Rule] | None = None, threshold: float = 0.5) -> DataFrame:
    """The rows, whole, that meet the base conditions and are judged good. Rows are
    written once beside their votes, so none is joined back or judged twice."""
    row = F.struct(*[F.col(f"`{c}`") for c in df.columns])
    out = _judged(df, row, text_col, rules or default_rules(), threshold)
    return out.where(F.col("good") & ~base_failed()).select("_id.*")


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def query(spark, sf_dir: str) -> DataFrame:
    out = judge(table(spark, sf_dir, "documents", "doc_id", "text")).withColumn("base_failed", base_failed())
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
                      (~F.col("base_failed") & F.col("good")).alias("kept"), "p_good")
