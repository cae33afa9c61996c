from itertools import product
from re import _parser

import pytest
import regex

from tests.llm import brute
from tickloom.llm import license_scan as L


def words_of(text):
    return regex.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", brute.ascii_lower(text))


def test_base_places_equal_brute_force(spark, docs, empty):
    more = [(900, "cc by cc by CC  BY!"), (901, "(cc)-by all RIGHTS\nreserved all rights reserved"), (902, "accc by cc bye"), (903, "general public license" * 2)]
    frame = docs.select("doc_id", "text").union(spark.createDataFrame(more, "doc_id bigint, text string")).withColumn("scan", L.F.lit(1))
    for r in L.scan(frame).collect():
        w, s = words_of(r["text"]), r["scan"]
        found = [(i, label) for phrase, label in L.PHRASES for i in range(len(w)) if w[i : i + len(phrase.split())] == phrase.split()]
        assert s["n_words"] == len(w)
        assert s["n_base"] == len(found)
        assert (s["first_word"], s["last_word"]) == ((min(found)[0], max(found)[0]) if found else (None, None))
        assert s["base_labels"] == sorted({x for _, x in found})
        assert set(s["base_labels"]) <= set(s["labels"]) and s["labels"] == sorted(set(s["labels"]))
        assert 0 <= s["score"] <= 1
    assert L.scan(empty).collect() == []


def test_detections_equal_brute_force(spark):
    """Every rule searched, every match that no other of its priority or above contains."""
    texts = [
        "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License.",
        "This is the MIT License. Permission is hereby granted, free of charge, to any person obtaining a copy of this software",
        "GNU General Public License version 2 or later; GPL v3; LGPL 2.1; the GNU Affero General Public License 3.0, mit mit license",
        "SPDX-License-Identifier: BSD-3-Clause and 2-clause BSD license, and cc-by-nc-sa 4.0. Creative Commons Attribution 4.0 International",
        "no licence here, only bsd and mozilla",
    ]
    rows = L.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")).collect()
    for r in rows:
        joined = " " + " ".join(words_of(r["text"])) + " "
        spans = {(m.start(), m.end(), p, label) for label, p, k, rx in L.RULES if k in joined for m in regex.finditer(rf"(?<= )(?:{rx})(?= )", joined)}
        kept = [a for a in spans if not any(b != a and b[0] <= a[0] and b[1] >= a[1] and b[2] >= a[2] and (b[:3] != a[:3] or b[3] < a[3]) for b in spans)]
        wanted = sorted((joined[:b].count(" ") - 1, joined[:e].count(" ") - 1, p, label) for b, e, p, label in kept)
        assert sorted((d["first_word"], d["last_word"], d["priority"], d["label"]) for d in r["scan"]["detections"]) == wanted


@pytest.mark.parametrize(
    ("text", "labels", "score"),
    [
        ("Released under the MIT license.", ["mit"], 0.9),
        ("the Apache License 2.0", ["apache-2.0"], 0.6),
        ("licensed under cc by sa 4.0", ["cc-by", "cc-by-sa-4.0"], 0.6),
        ("GNU Lesser General Public License v2.1", ["gpl", "lgpl-2.1"], 0.6),
        ("plain words about a river", [], 0.0),
    ],
)
def test_known_sentences(spark, text, labels, score):
    found = L.scan(spark.createDataFrame([(1, text)], "doc_id bigint, text string")).first()["scan"]
    assert (found["labels"], found["score"]) == (labels, score)


def test_no_python_on_the_main_path(docs):
    plan = L.scan(docs)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def spellings(pattern):
    """A text for every choice of alternatives of a pattern, without what may be left out."""

    def of(items):
        return ["".join(x) for x in product(*[one(str(op), arg) for op, arg in items])]

    def one(op, arg):
        if op == "LITERAL":
            return [chr(arg)]
        if op == "BRANCH":
            return [x for branch in arg[1] for x in of(branch)]
        if op == "SUBPATTERN":
            return of(arg[3])
        if op in ("MAX_REPEAT", "MIN_REPEAT"):
            return [x * arg[0] for x in of(arg[2])] if arg[0] else [""]
        if op == "IN":
            return one(*map(lambda x: str(x) if not isinstance(x, int) else x, arg[0])) if str(arg[0][0]) == "LITERAL" else ["1"]
        return ["1"]

    return of(_parser.parse(pattern))


def test_every_alternative_of_every_rule_holds_a_keyword_of_it():
    keywords = {}
    for label, priority, keyword, rx in L.RULES:
        keywords.setdefault((label, priority, rx), set()).add(keyword)
    shut = [(label, x) for (label, _, rx), ks in keywords.items() for x in spellings(rx) if not any(k in x for k in ks)]
    assert shut == []


@pytest.mark.parametrize(
    ("text", "label"),
    [
        ("under the Expat License.", "mit"),
        ("X11 licence", "mit"),
        ("PSF License", "python-2.0"),
        (f"Neither the name of {'The Regents of a very long Institution, ' * 12} nor the names of its contributors may be used to endorse or promote products", "bsd-3-clause"),
    ],
)
def test_names_behind_other_keywords(spark, text, label):
    assert L.scan(spark.createDataFrame([(1, text)], "doc_id bigint, text string")).first()["scan"]["labels"] == [label]
