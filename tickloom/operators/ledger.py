"""The experiment registry: trials, families, verdicts, evidence, proposals, documents."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickloom.operators.skew import running_total

# Verdict vocabulary and maturity ceilings by protocol (levels 0 to 7).
DEAD = ("killed", "rejected", "noise", "not_eligible")
LIVE = ("signal", "candidate", "eligible", "validated", "survived", "confirmed")
OTHER = ("superseded", "inconclusive", "data_blocked")
CEILING = {"exploratory": 1, "confirmatory": 4, "replication": 5, "stress": 6}


def expand_batches(entries: DataFrame, claimed: int | None = None) -> DataFrame:
    """Trials from batch entries: (trial_id, hypothesis, family, verdict, ran, dsr).

    An entry of count n becomes n trials numbered in document order (``doc``); the published
    ratio stays on its first trial, and trials beyond ``run_count`` have not run. If the claimed
    total exceeds the documented one, the remainder becomes unallocated rows.
    """
    placed = running_total(entries, F.col("trial_count"), ["doc"], F.floor(F.col("doc") / 4096), "before")
    many = F.col("trial_count") > 1
    t = placed.withColumn("seq", F.explode(F.sequence(F.lit(1), F.col("trial_count")))).select(
        (F.col("before") + F.col("seq")).alias("trial_id"),
        F.when(many, F.concat("hypothesis", F.lit("#"), F.col("seq"))).otherwise(F.col("hypothesis")).alias("hypothesis"),
        "family", "verdict", (F.col("seq") <= F.col("run_count")).alias("ran"),
        F.when(F.col("seq") == 1, F.col("dsr")).alias("dsr"),
    )
    if claimed is None:
        return t
    documented = entries.agg(F.sum("trial_count").alias("n"))
    gap = documented.where(F.col("n") < claimed).select(F.explode(F.sequence(F.col("n") + 1, F.lit(claimed).cast("bigint"))).alias("trial_id"), "n")
    rest = gap.select(
        "trial_id", F.concat(F.lit("UNALLOCATED#"), F.col("trial_id") - F.col("n")).alias("hypothesis"), F.lit("unallocated").alias("family"),
        F.lit("inconclusive").alias("verdict"), F.lit(True).alias("ran"), F.lit(None).cast("double").alias("dsr"),
    )
    return t.unionByName(rest)


def expand_ranges(names: DataFrame, column: str = "name") -> DataFrame:
    """``H44-H50`` to H44 .. H50; anything else stays as it is."""
    lo, hi = (F.regexp_extract(column, r"^H(\d+)-H(\d+)$", i) for i in (1, 2))
    span = F.when(lo != "", F.transform(F.sequence(lo.cast("int"), hi.cast("int")), lambda n: F.concat(F.lit("H"), n.cast("string"))))
    return names.withColumn("expanded", F.explode(F.coalesce(span, F.array(F.col(column)))))


def search(trials: DataFrame, term: str, fields: Sequence[str] = ("hypothesis", "family", "evidence")) -> DataFrame:
    """Trials containing the term in any field, with the first field that matched."""
    needle = term.strip().lower()
    hit = F.coalesce(*(F.when(F.contains(F.lower(F.col(f)), F.lit(needle)), F.lit(f)) for f in fields))
    return trials.withColumn("matched_on", hit).where("matched_on is not null")


def in_family(trials: DataFrame, prefix: str) -> DataFrame:
    """The family itself and its descendants (dotted paths)."""
    return trials.where((F.col("family") == prefix) | F.startswith(F.col("family"), F.lit(prefix + ".")))


def graveyard(trials: DataFrame) -> DataFrame:
    return trials.where(F.col("verdict").isin(*DEAD))


def survivors(trials: DataFrame) -> DataFrame:
    return trials.where(F.col("verdict").isin(*LIVE))


def kill_rates(trials: DataFrame, depth: int = 1) -> DataFrame:
    """(prefix, trials, dead, kill_rate) by the first ``depth`` parts of the family path."""
    prefix = F.substring_index("family", ".", depth)
    dead = F.col("verdict").isin(*DEAD)
    return trials.groupBy(prefix.alias("prefix")).agg(
        F.count(F.lit(1)).alias("trials"), F.count_if(dead).alias("dead"), F.avg(dead.cast("double")).alias("kill_rate")
    )


def summary(trials: DataFrame) -> DataFrame:
    """(registered, families, dead, alive, kill_rate) of the whole registry."""
    dead, live = F.col("verdict").isin(*DEAD), F.col("verdict").isin(*LIVE)
    return trials.agg(
        F.count(F.lit(1)).alias("registered"), F.count_distinct("family").alias("families"), F.count_if(dead).alias("dead"),
        F.count_if(live).alias("alive"), F.avg(dead.cast("double")).alias("kill_rate"),
    )


def contradictions(trials: DataFrame) -> DataFrame:
    """(family, live, dead, pairs): opposing verdicts within a family.

    The pairs are exactly live x dead less those of one base hypothesis, so they are counted from
    per-hypothesis tallies; members are listed by :func:`contradiction_sides`. Pairs themselves
    are never emitted, since a family may hold any number of trials.
    """
    base = F.substring_index("hypothesis", "#", 1)
    per = trials.groupBy("family", base.alias("base")).agg(
        F.count_if(F.col("verdict").isin(*LIVE)).alias("l"), F.count_if(F.col("verdict").isin(*DEAD)).alias("d")
    )
    g = per.groupBy("family").agg(F.sum("l").alias("live"), F.sum("d").alias("dead"), F.sum(F.col("l") * F.col("d")).alias("own"))
    return g.select("family", "live", "dead", (F.col("live") * F.col("dead") - F.col("own")).alias("pairs")).where("pairs > 0")


def contradiction_sides(trials: DataFrame) -> DataFrame:
    """(family, side, trial_id): both sides of every family with opposing verdicts."""
    side = F.when(F.col("verdict").isin(*LIVE), "live").when(F.col("verdict").isin(*DEAD), "dead")
    both = contradictions(trials).select("family")
    return trials.withColumn("side", side).where("side is not null").join(both, "family", "left_semi").select("family", "side", "trial_id")


def ceiling_violations(trials: DataFrame) -> DataFrame:
    """Trials claiming more maturity than their protocol can give, or a ratio without its count."""
    cap = F.lit(None).cast("int")
    for protocol, level in CEILING.items():
        cap = F.when(F.col("protocol") == protocol, level).otherwise(cap)
    unpaired = F.col("dsr").isNull() != F.col("dsr_n_trials").isNull()
    out = trials.withColumns({"ceiling": cap, "over_ceiling": F.col("maturity") > cap, "unpaired_dsr": unpaired})
    return out.where("over_ceiling or unpaired_dsr")


def evidence(trials: DataFrame, replications: DataFrame) -> DataFrame:
    """(claim, volume, families, periods, attempted, survived, weakest): the weakest dimension named."""
    g = trials.groupBy("claim").agg(
        F.count(F.lit(1)).alias("volume"), F.count_distinct("family").alias("families"), F.count_distinct("period").alias("periods")
    )
    r = replications.groupBy("claim").agg(F.count(F.lit(1)).alias("attempted"), F.count_if(F.col("survived")).alias("survived"))
    j = g.join(r, "claim", "left").fillna(0, ["attempted", "survived"])
    weakest = (
        F.when(F.col("survived") == 0, "no surviving replication").when(F.col("periods") <= 1, "single period")
        .when(F.col("families") <= 1, "single family").otherwise("none")
    )
    return j.withColumn("weakest", weakest)


def declared_cells(families: DataFrame) -> DataFrame:
    """(period, cells, lifetime): active and cumulative denominators."""
    from pyspark.sql import Window as W

    per = families.groupBy("period").agg(F.sum("cells").alias("cells"))
    return per.withColumn("lifetime", F.sum("cells").over(W.orderBy("period").rowsBetween(W.unboundedPreceding, 0)))


def reconcile_claims(entries: DataFrame, claimed: DataFrame, key: str) -> DataFrame:
    """(key, documented, claimed, unallocated) per key."""
    doc = entries.groupBy(key).agg(F.sum("trial_count").alias("documented"))
    return doc.join(claimed, key, "full").select(
        key, F.coalesce("documented", F.lit(0)).alias("documented"), F.coalesce("claimed", F.lit(0)).alias("claimed"),
        (F.coalesce("claimed", F.lit(0)) - F.coalesce("documented", F.lit(0))).alias("unallocated"),
    )


# Bars that do not count as bars, and the fewest words a reason needs.
EMPTY_BARS = ("zero", "0", "nothing", "random")
REASON_WORDS = 5


def objections(proposals: DataFrame, killed: DataFrame) -> DataFrame:
    """(proposal, severity, objection) for every standing rule a proposal breaks.

    ``killed`` is joined on the revisited hypothesis; each rule is a filter, and the rules become
    rows only for proposals that break them.
    """
    k = killed.select(F.col("hypothesis").alias("revisits")).distinct().withColumn("was_killed", F.lit(True))
    p = proposals.join(k, "revisits", "left")
    again = F.coalesce(F.col("was_killed"), F.lit(False))
    thin = F.size(F.split(F.trim(F.coalesce("reason", F.lit(""))), r"\s+")) < REASON_WORDS
    bar = F.lower(F.trim(F.coalesce("beats", F.lit(""))))
    rules = [
        (F.coalesce("preregistration", F.lit("")) == "", "blocking", "no pre-registration"),
        (F.col("trial_count") < 1, "blocking", "trial count not declared"),
        (again & thin, "blocking", "re-tests killed hypothesis"),
        (again & ~thin, "caution", "re-tests killed hypothesis"),
        (F.coalesce("contradicts", F.lit("")) != "", "caution", "contradicts settled finding"),
        (F.col("learns_parameters") & ~F.col("equal_weight_baseline"), "blocking", "no equal-weight baseline"),
        (bar == "", "blocking", "no incremental bar"),
        (bar.isin(*EMPTY_BARS), "blocking", "incremental bar is zero"),
        (F.col("grade") == "strategy", "caution", "strategy grade claimed"),
    ]
    packed = F.array(*(F.when(c, F.struct(F.lit(s).alias("severity"), F.lit(o).alias("objection"))) for c, s, o in rules))
    return p.select("proposal", F.inline(F.filter(packed, lambda x: x.isNotNull())))


def scan_documents(docs: DataFrame, number: Column, text: str, title: str, verdict: str, killed: str, newest: int) -> DataFrame:
    """(number, title, state) of the ``newest`` documents: registered, run, or killed."""
    d = docs.where(number.isNotNull()).select(
        number.alias("number"), F.trim(F.regexp_extract(text, title, 1)).alias("title"),
        F.when(~F.col(text).rlike(verdict), "registered").when(F.col(text).rlike(killed), "killed").otherwise("run").alias("state"),
    )
    return d.orderBy(F.col("number").desc()).limit(newest)


def numeric_tokens(lines: DataFrame, keys: Sequence[str], text: str) -> DataFrame:
    """(keys, pos, token): every number of a line, in order."""
    found = F.regexp_extract_all(F.col(text), F.lit(r"[-+]?[0-9]+(?:\.[0-9]+)?"), F.lit(0))
    return lines.select(*keys, F.posexplode(found).alias("pos", "token"))


def token_diff(a: DataFrame, b: DataFrame, keys: Sequence[str], tolerance: float = 0.0) -> DataFrame:
    """(keys, pos, a, b): positions where two reports' numbers differ or one has none."""
    j = a.withColumnRenamed("token", "a").join(b.withColumnRenamed("token", "b"), [*keys, "pos"], "full")
    same = F.abs(F.col("a").try_cast("double") - F.col("b").try_cast("double")) <= tolerance
    return j.where(~F.coalesce(same, F.lit(False)))
