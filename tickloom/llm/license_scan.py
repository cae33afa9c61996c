"""License scans by ordered signature rules (operator 7).

A text is reduced to its words, lower-cased and joined by single spaces, so rules need not care
for punctuation, line ends or case. A cheap test for any rule's keyword comes first, then every
rule whose own keyword is there is searched. Detections are word-aligned intervals. A detection
inside another of the same or a higher priority is suppressed; partly overlapping ones stay.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickloom.llm.common import let, whole

NOT_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"

# Base phrases and their labels.
PHRASES = [("cc by", "cc-by"), ("general public license", "gpl"), ("all rights reserved", "reserved")]

# Priorities: a text of a license or a machine-readable tag, a grant that names one, a bare name.
TEXT, GRANT, NAME = 3, 2, 1
CONFIDENCE = {TEXT: 1.0, GRANT: 0.9, NAME: 0.6}
BASE_CONFIDENCE = 0.5

# label, priority, keyword, pattern over the normalised words.
_WRITTEN = [
    ("mit", TEXT, "permission", r"permission is hereby granted free of charge to any person obtaining a copy of this software"),
    ("mit", TEXT, "substantial", r"(?:the )?above copyright notice and this permission notice shall be included in all copies or substantial portions"),
    ("mit", GRANT, "mit", r"(?:licensed|released|distributed|available) under (?:the )?(?:terms of (?:the )?)?mit(?: licen[cs]e)?"),
    *[("mit", NAME, name, rf"(?:the )?{name} licen[cs]e") for name in ("mit", "expat", "x11")],
    ("isc", TEXT, "permission", r"permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"),
    ("isc", GRANT, "isc", r"(?:licensed|released|distributed) under (?:the )?isc(?: licen[cs]e)?"),
    ("isc", NAME, "isc", r"(?:the )?isc licen[cs]e"),
    ("bsd-0-clause", NAME, "bsd", r"(?:0 clause bsd|zero clause bsd|bsd 0 clause|0bsd)(?: licen[cs]e)?"),
    ("bsd", TEXT, "redistribution", r"redistribution and use in source and binary forms with or without modification are permitted"),
    ("bsd-3-clause", TEXT, "endorse", r"neither the name of (?:[^ ]+ ){1,200}?nor the names of its contributors may be used to endorse or promote products"),
    ("bsd-4-clause", TEXT, "advertising", r"all advertising materials mentioning features or use of this software must display the following acknowledg(?:e)?ment"),
    ("bsd-1-clause", NAME, "bsd", r"(?:1 clause bsd|bsd 1 clause)(?: licen[cs]e)?"),
    ("bsd-2-clause", NAME, "bsd", r"(?:2 clause bsd|bsd 2 clause|simplified bsd|freebsd)(?: licen[cs]e)?"),
    ("bsd-3-clause", NAME, "bsd", r"(?:3 clause bsd|bsd 3 clause|new bsd|modified bsd|revised bsd)(?: licen[cs]e)?"),
    ("bsd-4-clause", NAME, "bsd", r"(?:4 clause bsd|bsd 4 clause|original bsd)(?: licen[cs]e)?"),
    ("bsd", GRANT, "bsd", r"(?:licensed|released|distributed) under (?:the |a )?bsd(?: style)?(?: licen[cs]e)?"),
    ("bsd", NAME, "bsd", r"bsd(?: style)? licen[cs]e"),
    ("apache-2.0", TEXT, "apache", r"licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license"),
    ("apache-2.0", GRANT, "apache", r"(?:licensed|released|distributed|available) under (?:the )?(?:terms of (?:the )?)?apache(?: software)?(?: licen[cs]e)?(?: version| v)? ?2(?: 0)?"),
    ("apache-2.0", NAME, "apache", r"apache(?: software)? licen[cs]e(?: version| v)? ?2(?: 0)?|apache 2 0(?: licen[cs]e)?"),
    ("apache-1.1", NAME, "apache", r"apache(?: software)? licen[cs]e(?: version| v)? ?1 1"),
    ("apache-1.0", NAME, "apache", r"apache(?: software)? licen[cs]e(?: version| v)? ?1 0"),
    ("apache", NAME, "apache", r"apache(?: software)? licen[cs]e"),
    ("zlib", TEXT, "implied", r"this software is provided as is without any express or implied warranty in no event will the authors be held liable"),
    ("zlib", NAME, "zlib", r"zlib(?: libpng)? licen[cs]e"),
    ("boost-1.0", TEXT, "boost", r"distributed under the boost software license version 1 0"),
    ("boost-1.0", NAME, "boost", r"boost software licen[cs]e(?: version)?(?: 1 0)?"),
    ("unlicense", TEXT, "unencumbered", r"this is free and unencumbered software released into the public domain"),
    ("unlicense", NAME, "unlicense", r"(?:the )?unlicense"),
    ("wtfpl", TEXT, "fuck", r"do what the fuck you want to public licen[cs]e"),
    ("wtfpl", NAME, "wtfpl", r"wtfpl(?: version \d)?"),
    ("public-domain", GRANT, "domain", r"(?:released|placed|dedicated|put) (?:in ?to|in|to) the public domain"),
    ("public-domain", NAME, "domain", r"(?:is |are |in )the public domain|public domain dedication"),
    ("artistic", NAME, "artistic", r"(?:the )?(?:perl )?artistic licen[cs]e(?: version)?(?: [12] 0)?"),
    ("python-2.0", NAME, "python", r"python software foundation licen[cs]e(?: version 2)?"),
    ("python-2.0", NAME, "psf", r"psf licen[cs]e"),
    ("ruby", NAME, "ruby", r"ruby licen[cs]e|same (?:terms|licen[cs]e) as ruby"),
    ("perl", NAME, "perl", r"same (?:terms|licen[cs]e) as perl(?: itself)?"),
    ("postgresql", NAME, "postgresql", r"postgresql licen[cs]e"),
    ("openssl", NAME, "openssl", r"openssl licen[cs]e"),
    ("ofl-1.1", NAME, "font", r"(?:sil )?open font licen[cs]e(?: version)?(?: 1 1)?"),
    ("ms-pl", NAME, "microsoft", r"microsoft public licen[cs]e"),
    ("ms-rl", NAME, "microsoft", r"microsoft reciprocal licen[cs]e"),
    ("odbl-1.0", NAME, "database", r"open (?:data commons )?(?:open )?database licen[cs]e"),
    ("odc-by-1.0", NAME, "commons", r"open data commons attribution licen[cs]e"),
    ("pddl-1.0", NAME, "commons", r"open data commons public domain dedication(?: and)? licen[cs]e"),
    ("bsl-1.1", NAME, "business", r"business source licen[cs]e(?: 1 1)?"),
    ("sspl-1.0", NAME, "server", r"server side public licen[cs]e"),
    ("elastic-2.0", NAME, "elastic", r"elastic licen[cs]e(?: 2 0)?"),
    ("openrail", NAME, "rail", r"(?:creativeml )?open ?rail(?: [ms])?(?: licen[cs]e)?"),
    ("proprietary", GRANT, "proprietary", r"(?:this (?:software|document|work) is )?proprietary and confidential"),
    ("proprietary", GRANT, "permission", r"may not be (?:reproduced|copied|distributed)(?: or (?:reproduced|copied|distributed))? without (?:the )?(?:prior )?(?:express )?(?:written )?permission"),
    ("reserved", GRANT, "reserved", r"(?:copyright )?(?:c )?(?:\d{4} ){0,3}(?:\S+ ){0,4}all rights reserved"),
    ("reserved", NAME, "rights", r"(?:some|no) rights reserved"),
    ("copyright", NAME, "copyright", r"copyright (?:c )?(?:by )?\d{4}(?: \d{4})?"),
    ("free-use", GRANT, "free", r"free (?:for|to) (?:use in )?(?:personal|commercial|non ?commercial|academic|research)(?: and commercial)? use"),
    ("non-commercial", GRANT, "commercial", r"(?:for )?non ?commercial (?:use|purposes) only"),
]


def _gnu() -> list[tuple]:
    """The GNU family: name, full title, versions; each as grant, versioned name and bare name."""
    out = []
    titles = [
        ("gpl", "general public", ("1", "2", "3")),
        ("lgpl", "(?:lesser|library) general public", ("2", "2 1", "3")),
        ("agpl", "affero general public", ("1", "3")),
        ("fdl", "free documentation", ("1 1", "1 2", "1 3")),
    ]
    for short, title, versions in titles:
        named = rf"(?:gnu )?(?:{title} licen[cs]e|{short})"
        keywords = (title.split()[-1], short)
        for version in versions:
            label = f"{short}-{version.replace(' ', '.')}"
            tail = rf"(?: {short})?(?: version| v)? ?{version}(?: 0)?"
            for k in keywords:
                out.append((label, NAME, k, named + tail))
                out.append((label, GRANT, k, rf"(?:licensed|released|distributed|available) under (?:the )?(?:terms of (?:the )?)?{named}{tail}"))
                out.append((f"{label}-or-later", TEXT, k, rf"{named}(?: as published by the free software foundation)? either{tail} (?:of the licen[cs]e )?or (?:at your option )?any later version"))
        for k in keywords:
            out.append((short, NAME, k, named))
            out.append((short, TEXT, k, rf"redistribute it and or modify it under the terms of the {named}"))
    return out


def _creative_commons() -> list[tuple]:
    """Creative Commons: every element list and version, spelled short and in words."""
    words = {"by": "attribution", "sa": "share ?alike", "nc": "non ?commercial", "nd": "no ?deriv(?:ative)?s?(?: works)?"}
    out = [("cc0", NAME, "cc0", r"cc0(?: 1 0)?(?: universal)?"), ("cc0", NAME, "commons", r"creative commons (?:zero|cc0|public domain dedication)")]
    for elements in (("by",), ("by", "sa"), ("by", "nc"), ("by", "nd"), ("by", "nc", "sa"), ("by", "nc", "nd")):
        label = "cc-" + "-".join(elements)
        spelled = " ".join(words[e] for e in elements)
        for version in ("1 0", "2 0", "2 5", "3 0", "4 0", ""):
            tail = rf" {version}" if version else ""
            full = f"{label}-{version.replace(' ', '.')}" if version else label
            out.append((full, NAME, "cc", rf"cc {' '.join(elements)}{tail}"))
            out.append((full, GRANT, "commons", rf"creative commons {spelled}(?: licen[cs]e)?{tail}(?: (?:international|unported|generic))?(?: licen[cs]e)?"))
    return out


def _tags() -> list[tuple]:
    """Machine-readable tags of any license in the table."""
    ids = ("mit", "isc", "apache 2 0", "mpl 2 0", "epl 2 0", "bsd 2 clause", "bsd 3 clause", "gpl 2 0", "gpl 3 0", "lgpl 2 1", "lgpl 3 0", "agpl 3 0", "cc0 1 0", "unlicense")
    tags = [(i.replace(" clause", "-clause").replace("bsd ", "bsd-").replace(" ", "-", 1).replace(" ", "."), TEXT, "spdx", rf"spdx licen[cs]e identifier {i}(?: only| or later)?") for i in ids]
    weak = [("mpl", "mozilla public", ("1 0", "1 1", "2 0")), ("epl", "eclipse public", ("1 0", "2 0")), ("cddl", "common development and distribution", ("1 0", "1 1")), ("eupl", "european union public", ("1 1", "1 2"))]
    for short, title, versions in weak:
        for version in (*versions, ""):
            tail = rf"(?: version| v)? ?{version}" if version else ""
            label = f"{short}-{version.replace(' ', '.')}" if version else short
            out = rf"(?:{title} licen[cs]e|{short})"
            tags.append((label, NAME, title.split()[-1], out + tail))
            tags.append((label, NAME, short, out + tail))
    return tags


RULES = [*_WRITTEN, *_gnu(), *_creative_commons(), *_tags()]


def _spaces(text: Column) -> Column:
    return F.length(text) - F.length(F.replace(text, F.lit(" "), F.lit("")))


def normalised(text: Column) -> Column:
    """The words, each with a space before and after; a single space for a text without words.

    ``lower`` may change letters beyond A to Z; that neither parts nor joins words.
    """
    joined = F.regexp_replace(F.concat(F.lit(" "), F.lower(text), F.lit(" ")), NOT_WORD, " ")
    return joined


def _places(words: Column, phrase: str) -> Column:
    """``n, first, last``: the word positions at which a phrase stands, overlapping ones too."""

    def of(parts: Column) -> Column:
        return F.struct(
            (F.size(parts) - 1).cast("long").alias("n"),
            (_spaces(F.element_at(parts, 1)) - 1).cast("long").alias("first"),
            (_spaces(words) - _spaces(F.element_at(parts, -1)) - 1).cast("long").alias("last"),
        )

    # Cut where the phrase begins, taking nothing away.
    found = let(F.split(words, f"(?<= )(?={phrase} )", -1), of)
    none = F.struct(F.lit(0).cast("long").alias("n"), F.lit(None).cast("long").alias("first"), F.lit(None).cast("long").alias("last"))
    return F.when(words.contains(f" {phrase} "), found).otherwise(none)


def _detections(words: Column, rules: list[tuple]) -> Column:
    """All matches of all rules whose keyword is there, suppressed ones included."""
    table = F.array(*[F.struct(F.lit(label).alias("label"), F.lit(p).alias("priority"), F.lit(k).alias("keyword"), F.lit(rf"(?<= )(?:{rx})(?= )").alias("rx")) for label, p, k, rx in rules])

    def matches(rule: Column) -> Column:
        def of(both: Column) -> Column:
            gaps, hits = both["gaps"], both["hits"]
            sizes = F.transform(hits, lambda m: F.length(m))
            upto = F.aggregate(
                F.sequence(F.lit(0), F.size(hits) - 1),
                F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("begins")),
                lambda acc, i: F.struct(
                    (acc["at"] + F.length(F.get(gaps, i)) + F.get(sizes, i)).alias("at"),
                    F.array_append(acc["begins"], acc["at"] + F.length(F.get(gaps, i))).alias("begins"),
                ),
            )["begins"]
            spans = F.transform(
                F.arrays_zip(upto.alias("begin"), sizes.alias("size")),
                lambda s: F.struct(s["begin"].alias("begin"), (-(s["begin"] + s["size"])).alias("minus_end"), (-rule["priority"]).alias("minus_priority"), rule["label"].alias("label")),
            )
            return F.when(F.size(hits) > 0, spans).otherwise(F.array().cast(SPANS))

        return let(F.struct(F.split(words, rule["rx"], -1).alias("gaps"), F.regexp_extract_all(words, rule["rx"], F.lit(0)).alias("hits")), of)

    held = F.filter(table, lambda r: words.contains(r["keyword"]))
    return F.flatten(F.transform(held, matches))


SPANS = "array<struct<begin:int,minus_end:int,minus_priority:int,label:string>>"


def _unsuppressed(spans: Column) -> Column:
    """Spans that lie inside no other of the same or a higher priority.

    In order of begin, longest first and highest priority first, whatever holds a span stands
    before it; so the furthest end so far, kept for each priority and those above it, decides.
    """
    levels = sorted(CONFIDENCE)

    def step(acc: Column, s: Column) -> Column:
        end, priority = -s["minus_end"], -s["minus_priority"]
        covered = reduce(lambda c, p: F.when(priority == p, acc[f"p{p}"] >= end).otherwise(c), levels, F.lit(False))
        ends = [F.when((priority >= p) & (end > acc[f"p{p}"]), end).otherwise(acc[f"p{p}"]).alias(f"p{p}") for p in levels]
        return F.struct(*ends, F.when(covered, acc["kept"]).otherwise(F.array_append(acc["kept"], s)).alias("kept"))

    start = F.struct(*[F.lit(-1).alias(f"p{p}") for p in levels], F.array().cast(SPANS).alias("kept"))
    return F.aggregate(F.array_sort(F.array_distinct(spans)), start, step)["kept"]


def scan(docs: DataFrame, text: str = "text", rules: list[tuple] = RULES) -> DataFrame:
    """``docs`` with a struct column ``scan`` of what the rules and base phrases find.

    ``n_words``; ``n_base``, ``first_word``, ``last_word`` and ``base_labels`` of the base
    phrases; ``detections`` (label, priority, first and last word of every unsuppressed match, in
    order); ``labels`` (both kinds, distinct, sorted); ``score``, the best confidence. Null and
    empty texts have no words and find nothing; repeated rows are scanned each; an empty table
    stays empty; a column already named ``scan`` is replaced. Built-in functions only, no shuffle.
    """
    gate = "|".join(sorted({k for _, _, k, _ in rules}))

    def of(words: Column) -> Column:
        base = [_places(words, phrase).alias(f"b{i}") for i, (phrase, _) in enumerate(PHRASES)]
        kept = F.when(words.rlike(gate), _unsuppressed(_detections(words, rules))).otherwise(F.array().cast(SPANS))
        return let(F.struct(*base, kept.alias("kept"), (_spaces(words) - 1).cast("long").alias("n_words"), words.alias("words")), told)

    def told(m: Column) -> Column:
        each = [m[f"b{i}"] for i in range(len(PHRASES))]
        labels = F.array_sort(F.array_distinct(F.filter(F.array(*[F.when(b["n"] > 0, F.lit(label)) for b, (_, label) in zip(each, PHRASES, strict=True)]), lambda x: x.isNotNull())))
        word_at = lambda at: _spaces(F.substring(m["words"], F.lit(1), at)) - 1
        found = F.transform(
            m["kept"],
            lambda s: F.struct(
                s["label"].alias("label"), (-s["minus_priority"]).alias("priority"), word_at(s["begin"]).alias("first_word"), word_at(-s["minus_end"]).alias("last_word")
            ),
        )
        best = F.array_max(F.transform(m["kept"], lambda s: reduce(lambda c, p: F.when(-s["minus_priority"] == p, CONFIDENCE[p]).otherwise(c), CONFIDENCE, F.lit(0.0))))
        n_base = reduce(lambda a, b: a + b, [b["n"] for b in each])
        return F.struct(
            m["n_words"].alias("n_words"),
            n_base.alias("n_base"),
            F.least(*[b["first"] for b in each]).alias("first_word"),
            F.greatest(*[b["last"] for b in each]).alias("last_word"),
            labels.alias("base_labels"),
            found.alias("detections"),
            F.array_sort(F.array_distinct(F.concat(labels, F.transform(m["kept"], lambda s: s["label"])))).alias("labels"),
            F.greatest(F.coalesce(best, F.lit(0.0)), F.when(n_base > 0, BASE_CONFIDENCE).otherwise(0.0)).alias("score"),
        )

    kept = docs.drop("scan") if text != "scan" else docs
    found = let(normalised(whole(F.col(f"`{text}`"))), of)
    return kept.select("*", F.inline(F.array(F.struct(found.alias("scan")))))
