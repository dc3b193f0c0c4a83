"""The license scan against every rule at every word, and all pairs of detections."""

import re

import pytest
from pyspark.sql import functions as F

from quern.llm import licenses as L

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
COMPILED = [re.compile("(?<![^ ])" + r.words + "(?= )") for r in L.RULES]


def brute(text):
    words = WORD.findall((text or "").translate(LOWER))
    places = [(k, label) for k in range(len(words)) for phrase, label in L.BASE.items() if words[k : k + phrase.count(" ") + 1] == phrase.split(" ")]
    found, whole = [], " ".join(words) + " "
    for order, (rule, pattern) in enumerate(zip(L.RULES, COMPILED, strict=True)):
        m = pattern.search(whole)
        while m:
            k = whole.count(" ", 0, m.start())
            found.append((k, k + m[0].count(" ") + 1, rule.priority, order, rule))
            m = pattern.search(whole, m.start() + 1)

    def superfluous(d):
        for e in found:
            around, within = e[0] <= d[0] and e[1] >= d[1], e[0] >= d[0] and e[1] <= d[1]
            if e[2] < d[2] and (around or within) or e[2] == d[2] and around and (not within or e[3] < d[3]):
                return True
        return False

    kept = [d for d in found if not superfluous(d)]
    doubt = 1.0
    for rule in {d[4] for d in kept}:
        doubt *= 1 - rule.confidence
    join = lambda labels: ",".join(sorted(set(labels)))
    base, own = [label for _, label in places], [d[4].label for d in kept]
    return len(words), len(places), min((k for k, _ in places), default=None), max((k for k, _ in places), default=None), join(base), join(base + own), round(1 - doubt, 9), sorted((d[0], d[1], d[4].name) for d in kept)


TEXTS = [
    None,
    "",
    " \n\t ",
    "no word of it here, and nothing else",
    "Released under the MIT License. Released under the MIT-License; MIT LICENSE",
    "This work is licensed under the GNU General Public License, version 3.",
    "Licensed under CC BY-NC 4.0. Also CC-BY-SA 3.0, cc by, and CC BY CC BY.",
    "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License.",
    "SPDX-License-Identifier: GPL-2.0-or-later\nSPDX-License-Identifier: MIT",
    "see https://creativecommons.org/licenses/by-sa/4.0/ and http://www.gnu.org/licenses/lgpl-2.1.html",
    "GNU General Public License GNU General Public License gnu  general\tpublic license's",
    "KIT License KIT LICENSE İ CC BYé ccby cc by",
    "gplv3 GPLv2 gpl-3.0+ lgpl2.1 MPL 2.0, mpl2 BSD 3-Clause License, 3-clause BSD, MIT",
    "\U0001f600 mit license \U0001f600mit license",
    "Redistribution and use in source and binary forms, with or without modification, are permitted. Neither the name of the Some Very Good Group nor the names of its contributors",
    "Permission is hereby granted, free of charge, to any person obtaining a copy of this software",
    "Unauthorised copying of this file. (c) Copyright (c) 2024 by X. All rights reserved. Public domain",
    "available under a very odd and new license; published under an End User License Agreement",
    "x" * 50_000 + " mit license",
    "mit license " * 300,
    "word " * 3000 + "apache license 2.0 " + "word " * 3000,
]


@pytest.fixture(scope="module")
def got(spark):
    docs = spark.createDataFrame([(k, t) for k, t in enumerate(TEXTS)], "doc_id long, text string")
    rows = L.scan(docs).withColumn("score", L.score(F.col("licenses"))).collect()
    return {r["doc_id"]: r for r in rows}


@pytest.mark.parametrize("k", range(len(TEXTS)))
def test_equals_brute_force(got, k):
    want, r = brute(TEXTS[k]), got[k]
    assert (r["n_words"], len(r["places"])) == want[:2]
    assert sorted((d["start"], d["end"], d["rule"]) for d in r["licenses"]) == want[7]
    assert round(r["score"], 9) == want[6]


def test_query_equals_brute_force(spark, small, tmp_path):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    extra = spark.createDataFrame([(None if k % 3 == 0 else 9_000_000 + k % 5, t) for k, t in enumerate(TEXTS)], "doc_id long, text string")
    docs.unionByName(extra, allowMissingColumns=True).write.parquet(f"{tmp_path}/documents.parquet")
    rows = [tuple(r)[:7] + (round(r["score"], 9),) for r in L.op13_licenses(spark, str(tmp_path)).collect()]
    want = [(r["doc_id"], *brute(r["text"])[:7]) for r in spark.read.parquet(f"{tmp_path}/documents.parquet").collect()]
    order = lambda r: tuple((x is not None, x if x is not None else 0) for x in r)
    assert sorted(rows, key=order) == sorted(want, key=order)


def test_planted_lines_are_found_and_others_are_left(spark, small):
    rows = L.scan(spark.read.parquet(f"{small}/documents.parquet")).withColumn("plain", F.expr("regexp_like(text, '(?i)licen[sc]e|copyright|rights reserved')"))
    assert rows.filter("size(licenses) > 0 and not plain").isEmpty()
    assert rows.filter("size(licenses) = 0 and text rlike '(?i)licensed under|MIT license'").isEmpty()


def variants(pattern):
    """The words of a rule with all optional parts, and without."""
    least = full = pattern
    while "(" in full:
        full = re.sub(r"\(\?:([^()|]*)(?:\|[^()]*)?\)(?:\?|\{\d+,\d+\})?", lambda m: m[1].replace("[^ ]+", "w"), full)
    before = ""
    while before != least:
        before, least = least, re.sub(r"\(\?:(?:[^()]|\(\?:[^()]*\))*\)\?", "", least)
    while "(" in least:
        least = re.sub(r"\(\?:([^()|]*)(?:\|[^()]*)?\)(?:\{\d+,\d+\})?", lambda m: m[1].replace("[^ ]+", "w"), least)
    plain = lambda s, keep: re.sub(r"\[0-9\]\{2\}", "24", re.sub(r"\[([a-z])[a-z]\]", r"\1", re.sub(r"(.)\?", r"\1" if keep else "", s)))
    return {plain(full, True), plain(least, False)}


def test_every_rule_fires_behind_its_gate(spark):
    samples = [(k, text) for k, r in enumerate(L.RULES) for text in variants(r.words)]
    for k, text in samples:
        assert COMPILED[k].match(f"{text} "), (L.RULES[k].words, text)
        assert any(g in f" {text} " for g in L.gates(L.RULES)), text
    rows = L.scan(spark.createDataFrame(samples, "doc_id long, text string")).filter("size(licenses) = 0").collect()
    assert not rows


def test_odd_rows(odd, none):
    assert L.scan(odd).count() == odd.count() and L.scan(none).count() == 0
    clash = odd.withColumn("n_words", F.lit("mine")).withColumn("licenses", F.lit("mine"))
    rows = L.scan(clash)
    assert {"n_words", "n_words_", "licenses", "licenses_", "places"} <= set(rows.columns) and rows.filter("n_words <> 'mine'").isEmpty()


def test_no_shuffle_and_no_python(spark, small):
    plan = L.op13_licenses(spark, small)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Exchange|Python|Arrow|Pandas|Window", plan)
