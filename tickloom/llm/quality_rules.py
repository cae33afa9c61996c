"""Quality rules as a ledger of failure bits and measurements (operator 5).

Every rule is evaluated once a document. The ledger keeps the measurements and one bit a rule; a
policy is a named, versioned set of rules that reject. Policies and ablations read the ledger
alone, so a new version, or the question what one rule rejects by itself, needs no text.
"""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickloom.llm.common import WORD, let, whole

WINDOW = 8

# Rule, the measurements it fails on. The place in the list is its bit and never changes.
RULES = [
    ("few_words", "n_words < 20"),
    ("repeated_windows", "100 * n_repeat_words > 30 * n_words"),
    ("symbols", "10 * n_symbols > 3 * n_words"),
    ("repeated_lines", "100 * n_dup_lines > 50 * n_lines"),
    ("capitals", "100 * n_capitals > 50 * word_chars"),
    ("exclamations", "2 * n_exclamations > n_words"),
    ("short_words", "word_chars < 2 * n_words"),
    ("long_words", "word_chars > 60 * n_words"),
]
BASE = ("few_words", "repeated_windows")
# A version is never edited; a change of mind is a new version.
POLICIES = {
    "base-1": BASE,
    "prose-1": (*BASE, "symbols", "repeated_lines", "capitals", "exclamations", "short_words", "long_words"),
}
MEASURES = ["n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_capitals", "n_exclamations", "n_repeat_words"]


def mask(rules: Iterable[str]) -> int:
    at = {name: i for i, (name, _) in enumerate(RULES)}
    return reduce(lambda bits, name: bits | 1 << at[name], rules, 0)


def _count(text: Column, characters: str) -> Column:
    """How many characters of a class the text has."""
    return F.length(text) - F.length(F.regexp_replace(text, characters, ""))


def _repeated_words(words: Column) -> Column:
    """Words inside windows of eight words that occur twice or more, the first one included.

    Windows are compared by a 64-bit hash of their words' hashes. Only a text that holds an equal
    pair is ordered: its (hash, place) pairs are sorted, places beside an equal hash are kept,
    and each kept place covers up to eight words, fewer where the next one begins.
    """

    def covered(places: Column) -> Column:
        step = F.transform(places, lambda p, k: F.least(F.lit(WINDOW), F.coalesce(F.get(places, k + 1), p + WINDOW) - p))
        return F.aggregate(step, F.lit(0), lambda a, b: a + b)

    def twins(pairs: Column) -> Column:
        same = lambda x, j: F.coalesce(F.get(pairs, j)["h"] == x["h"], F.lit(False))
        places = F.transform(pairs, lambda x, j: F.when(same(x, j - 1) | same(x, j + 1), x["i"]))
        return let(F.array_sort(F.filter(places, lambda p: p.isNotNull())), covered)

    def counted(windows: Column) -> Column:
        pairs = F.array_sort(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        return F.when(F.size(F.array_distinct(windows)) < F.size(windows), let(pairs, twins)).otherwise(0)

    def hashed(codes: Column) -> Column:
        windows = F.transform(F.sequence(F.lit(1), F.size(codes) - (WINDOW - 1)), lambda i: F.xxhash64(F.slice(codes, i, WINDOW)))
        return F.when(F.size(codes) > WINDOW, let(windows, counted)).otherwise(0)

    return let(F.transform(words, lambda w: F.xxhash64(w)), hashed).cast("long")


def _measured(text: Column) -> Column:
    """One struct of all measurements, each pass over the text made once."""

    def of(text: Column) -> Column:
        words = F.regexp_extract_all(text, F.lit(f"({WORD})"), F.lit(1))
        lines = F.filter(F.split(text, "\n"), lambda line: line.rlike(WORD))
        by_words = let(
            words,
            lambda w: F.struct(
                F.size(w).cast("long").alias("n"), F.length(F.array_join(w, "")).cast("long").alias("chars"), _repeated_words(w).alias("repeat")
            ),
        )
        by_lines = let(lines, lambda x: F.struct(F.size(x).cast("long").alias("n"), (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("dup")))
        return let(
            F.struct(by_words.alias("w"), by_lines.alias("l")),
            lambda m: F.struct(
                m["w"]["n"].alias("n_words"),
                m["w"]["chars"].alias("word_chars"),
                _count(text, "[#*$%&|<>]").cast("long").alias("n_symbols"),
                m["l"]["n"].alias("n_lines"),
                m["l"]["dup"].alias("n_dup_lines"),
                _count(text, "[A-Z]").cast("long").alias("n_capitals"),
                _count(text, "[!]").cast("long").alias("n_exclamations"),
                m["w"]["repeat"].alias("n_repeat_words"),
            ),
        )

    return let(whole(text), of)


def ledger(docs: DataFrame, text: str = "text", rules: list[tuple[str, str]] = RULES) -> DataFrame:
    """``docs`` with the measurements of ``text`` and ``failed``, a long with one bit a failed rule.

    Null and empty texts measure 0 throughout and fail ``few_words``; repeated rows are measured
    each; an empty table stays empty; input columns named like new ones are replaced. Built-in
    functions only, no shuffle; every measurement is linear in the text but for a sort of the
    windows of texts that repeat themselves. Measurements come out of a generator, so that a
    later filter on them is not pushed below, where it would measure the text again.
    """
    kept = docs.drop(*(c for c in [*MEASURES, "failed"] if c != text))
    measured = kept.select("*", F.inline(F.array(_measured(F.col(f"`{text}`")))))
    bits = [F.when(F.expr(rule), F.lit(1 << i)).otherwise(F.lit(0)).cast("long") for i, (_, rule) in enumerate(rules)]
    return measured.withColumn("failed", reduce(lambda a, b: a.bitwiseOR(b), bits))


def passes(policy: str) -> Column:
    """Whether a row of a ledger passes a policy."""
    return F.col("failed").bitwiseAND(F.lit(mask(POLICIES[policy]))) == 0


def ablations(of: DataFrame, policy: str) -> DataFrame:
    """What each rule of a policy does: ``rule, failed, alone`` and ``kept_without``.

    ``failed`` documents fail the rule, ``alone`` of them no other rule of the policy, and
    ``kept_without`` would pass if the rule were dropped. Documents are counted by their bits
    first, which leaves at most 2 to the number of rules rows.
    """
    chosen = mask(POLICIES[policy])
    by_bits = of.groupBy(F.col("failed").bitwiseAND(F.lit(chosen)).alias("bits")).count()
    rows = F.array(*[F.struct(F.lit(name).alias("rule"), F.lit(mask([name])).cast("long").alias("bit")) for name in POLICIES[policy]])
    each = by_bits.select("bits", "count", F.inline(rows))
    total = lambda hit: F.coalesce(F.sum(F.when(hit, F.col("count"))), F.lit(0)).alias
    return each.groupBy("rule").agg(
        total(F.col("bits").bitwiseAND(F.col("bit")) != 0)("failed"),
        total(F.col("bits") == F.col("bit"))("alone"),
        total(F.col("bits").bitwiseAND(F.bitwise_not(F.col("bit"))) == 0)("kept_without"),
    )


SQL = """
WITH w AS MATERIALIZED (
  SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM documents
), win AS (
  SELECT rid, i, array_to_string(list_slice(w, i, i + 7), ' ') AS g
  FROM (SELECT rid, w, unnest(range(1, len(w) - 6)) AS i FROM w WHERE len(w) >= 8)
), twice AS (
  SELECT rid, i, lead(i) OVER (PARTITION BY rid ORDER BY i) AS nxt
  FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, g) AS c FROM win) WHERE c > 1
), rep AS (
  SELECT rid, sum(least(8, coalesce(nxt - i, 8)))::BIGINT AS n FROM twice GROUP BY rid
), m AS (
  SELECT rid, doc_id, t, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars,
    (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
    list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS l,
    (length(t) - length(regexp_replace(t, '[A-Z]', '', 'g')))::BIGINT AS n_capitals,
    (length(t) - length(regexp_replace(t, '!', '', 'g')))::BIGINT AS n_exclamations
  FROM w
), a AS (
  SELECT m.*, len(l)::BIGINT AS n_lines, (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines, coalesce(rep.n, 0)::BIGINT AS n_repeat_words
  FROM m LEFT JOIN rep USING (rid)
), b AS (
  SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM a
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT (base_failed OR 10 * n_symbols > 3 * n_words OR 100 * n_dup_lines > 50 * n_lines OR 100 * n_capitals > 50 * word_chars
    OR 2 * n_exclamations > n_words OR word_chars < 2 * n_words OR word_chars > 60 * n_words) AS kept
FROM b
"""
