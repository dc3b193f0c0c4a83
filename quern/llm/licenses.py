"""License scans: ordered signature rules over a document's words, gated by keywords, resolved by priority and containment.

A text becomes words: runs of digits, letters a to z (capitals lowered) and characters
beyond ASCII. A rule is a regular expression over words with a space after each,
and matches from its first word on, so a match is an interval of word numbers.

1. A document is looked at if it holds the keyword of some rule (``gates``); all others cost one pass.
2. A word of it is looked at if some rule begins with it, and only these rules meet
   the ``WINDOW`` words from there on.
3. A detection goes if one of better priority lies within it or around it, or one
   of the same priority around it that is longer or by an earlier rule. Both begin
   less than ``WINDOW`` words apart, so only neighbours are compared and the
   work grows with the text.

Everything happens within a row, by DataFrame functions: no shuffle, no Python.

Nulls and limits: a null text is empty; texts of any length are whole; repeated
rows and rows without an id each get their own result; of equal detections the
earlier rule stays; an empty table gives no rows; further columns stay, and
where they are named as the result's the result's get an underscore more.
"""

from __future__ import annotations

import json
import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.llm.shared import free_names, let, only

#: What stands between words once A to Z are lowered, and the phrases of the base with their labels.
BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
BASE = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}

#: Words of which one is part of most rules: the keywords that are looked for first. A rule without any brings its own.
KEYWORDS = (" licen", " copyright", " creativecommons ", " creative commons ", " cc by", " cc0", " spdx ", " gpl", " lgpl", " agpl", " gnu ", " public domain", " terms of the ", " this software", " opensource org", " opendatacommons org ", " mozilla org ")
#: The most words that a rule can span; ``RULES`` refuses longer ones.
WINDOW = 40


@dataclass(frozen=True)
class Rule:
    """A signature: ``words`` is a regular expression over words that begins with a plain word."""

    name: str
    label: str
    priority: int
    confidence: float
    words: str

    @property
    def first(self) -> str:
        return self.words.split(" ")[0]


@dataclass(frozen=True)
class Family:
    """Licenses of one name: full names, short names (also fused with a version), versions, SPDX id without version, addresses."""

    label: str
    names: tuple[str, ...]
    short: tuple[str, ...] = ()
    versions: tuple[str, ...] = ()
    spdx: str = ""
    urls: tuple[str, ...] = ()


#: The families that rules are made from; ``{v}`` in an address stands for a version.
FAMILIES = (
    Family("gpl", ("gnu general public licen[sc]e", "gnu gpl", "general public licen[sc]e"), ("gpl",), ("1.0", "2.0", "3.0"), "gpl", ("gnu org licenses gpl {v}", "gnu org licenses old licenses gpl {v}", "gnu org copyleft gpl", "opensource org licenses gpl {v}")),
    Family("lgpl", ("gnu lesser general public licen[sc]e", "gnu library general public licen[sc]e", "gnu lgpl", "lesser general public licen[sc]e"), ("lgpl",), ("2.0", "2.1", "3.0"), "lgpl", ("gnu org licenses lgpl {v}", "gnu org licenses old licenses lgpl {v}", "opensource org licenses lgpl {v}")),
    Family("agpl", ("gnu affero general public licen[sc]e", "gnu agpl", "affero general public licen[sc]e"), ("agpl",), ("1.0", "3.0"), "agpl", ("gnu org licenses agpl {v}", "opensource org licenses agpl {v}")),
    Family("gfdl", ("gnu free documentation licen[sc]e", "gnu fdl"), ("gfdl",), ("1.1", "1.2", "1.3"), "gfdl", ("gnu org licenses fdl {v}", "gnu org copyleft fdl")),
    Family("apache", ("apache software licen[sc]e", "apache licen[sc]e", "apache public licen[sc]e"), ("apache",), ("1.0", "1.1", "2.0"), "apache", ("apache org licenses license {v}", "opensource org licenses apache {v}")),
    Family("mit", ("mit licen[sc]e", "mit x11 licen[sc]e", "mit style licen[sc]e", "expat licen[sc]e", "x11 licen[sc]e"), (), (), "mit", ("opensource org licenses mit", "opensource org license mit", "mit license org")),
    Family("bsd-2-clause", ("bsd 2 clause(?: simplified)? licen[sc]e", "simplified bsd licen[sc]e", "freebsd licen[sc]e", "2 clause bsd(?: licen[sc]e)?", "two clause bsd(?: licen[sc]e)?"), (), (), "bsd 2 clause", ("opensource org licenses bsd 2 clause",)),
    Family("bsd-3-clause", ("bsd 3 clause(?: new| revised)? licen[sc]e", "new bsd licen[sc]e", "modified bsd licen[sc]e", "revised bsd licen[sc]e", "3 clause bsd(?: licen[sc]e)?", "three clause bsd(?: licen[sc]e)?"), (), (), "bsd 3 clause", ("opensource org licenses bsd 3 clause",)),
    Family("bsd-4-clause", ("bsd 4 clause licen[sc]e", "original bsd licen[sc]e", "4 clause bsd(?: licen[sc]e)?"), (), (), "bsd 4 clause"),
    Family("bsd", ("bsd licen[sc]e", "bsd style licen[sc]e"), (), (), "0bsd", ("opensource org licenses bsd license",)),
    Family("mpl", ("mozilla public licen[sc]e",), ("mpl",), ("1.0", "1.1", "2.0"), "mpl", ("mozilla org mpl {v}", "mozilla org en us mpl {v}", "opensource org licenses mpl {v}")),
    Family("epl", ("eclipse public licen[sc]e",), ("epl",), ("1.0", "2.0"), "epl", ("eclipse org legal epl v10", "eclipse org legal epl {v}", "opensource org licenses epl {v}")),
    Family("cddl", ("common development and distribution licen[sc]e",), ("cddl",), ("1.0", "1.1"), "cddl", ("opensource org licenses cddl {v}",)),
    Family("cpl", ("common public licen[sc]e",), ("cpl",), ("1.0",), "cpl", ("opensource org licenses cpl {v}",)),
    Family("eupl", ("european union public licen[sc]e",), ("eupl",), ("1.0", "1.1", "1.2"), "eupl", ("joinup ec europa eu software page eupl",)),
    Family("artistic", ("artistic licen[sc]e", "perl artistic licen[sc]e"), (), ("1.0", "2.0"), "artistic", ("opensource org licenses artistic license {v}", "opensource org licenses artistic {v}")),
    Family("isc", ("isc licen[sc]e",), (), (), "isc", ("opensource org licenses isc",)),
    Family("zlib", ("zlib licen[sc]e", "zlib libpng licen[sc]e"), (), (), "zlib", ("opensource org licenses zlib",)),
    Family("boost", ("boost software licen[sc]e",), ("bsl",), ("1.0",), "bsl", ("boost org license 1 0", "opensource org licenses bsl {v}")),
    Family("unlicense", ("unlicense", "unlicence"), (), (), "unlicense", ("unlicense org",)),
    Family("wtfpl", ("wtfpl", "do what the fuck you want to public licen[sc]e"), (), ("2",), "wtfpl", ("wtfpl net",)),
    Family("osl", ("open software licen[sc]e",), ("osl",), ("1.0", "2.0", "2.1", "3.0"), "osl", ("opensource org licenses osl {v}",)),
    Family("afl", ("academic free licen[sc]e",), ("afl",), ("1.2", "2.0", "2.1", "3.0"), "afl", ("opensource org licenses afl {v}",)),
    Family("ofl", ("sil open font licen[sc]e", "open font licen[sc]e"), ("ofl",), ("1.0", "1.1"), "ofl", ("scripts sil org ofl",)),
    Family("odbl", ("open database licen[sc]e", "open data commons open database licen[sc]e"), ("odbl",), ("1.0",), "odbl", ("opendatacommons org licenses odbl {v}", "opendatacommons org licenses odbl")),
    Family("odc-by", ("open data commons attribution licen[sc]e",), (), ("1.0",), "odc by", ("opendatacommons org licenses by {v}", "opendatacommons org licenses by")),
    Family("pddl", ("public domain dedication and licen[sc]e", "open data commons public domain dedication and licen[sc]e"), ("pddl",), ("1.0",), "pddl", ("opendatacommons org licenses pddl",)),
    Family("python", ("python software foundation licen[sc]e", "psf licen[sc]e"), (), ("2",), "psf", ("docs python org 3 license", "opensource org licenses python {v}")),
    Family("php", ("php licen[sc]e",), (), ("3.0", "3.01"), "php", ("php net license",)),
    Family("ruby", ("ruby licen[sc]e",), (), (), "ruby"),
    Family("postgresql", ("postgresql licen[sc]e",), (), (), "postgresql", ("opensource org licenses postgresql",)),
    Family("w3c", ("w3c software licen[sc]e", "w3c software notice and licen[sc]e"), (), (), "w3c", ("w3 org consortium legal copyright software",)),
    Family("ms-pl", ("microsoft public licen[sc]e", "ms pl"), (), (), "ms pl", ("opensource org licenses ms pl",)),
    Family("ms-rl", ("microsoft reciprocal licen[sc]e", "ms rl"), (), (), "ms rl", ("opensource org licenses ms rl",)),
    Family("ecl", ("educational community licen[sc]e",), ("ecl",), ("1.0", "2.0"), "ecl", ("opensource org licenses ecl {v}",)),
    Family("cecill", ("cecill licen[sc]e", "cecill free software licen[sc]e"), ("cecill",), ("1.0", "2.0", "2.1"), "cecill", ("cecill info licences",)),
    Family("upl", ("universal permissive licen[sc]e",), ("upl",), ("1.0",), "upl", ("opensource org licenses upl",)),
    Family("ncsa", ("university of illinois ncsa open source licen[sc]e", "ncsa licen[sc]e"), (), (), "ncsa", ("opensource org licenses ncsa",)),
    Family("sspl", ("server side public licen[sc]e",), ("sspl",), ("1.0", "1"), "sspl"),
    Family("busl", ("business source licen[sc]e",), ("busl",), ("1.1",), "busl", ("mariadb com bsl11",)),
    Family("elastic", ("elastic licen[sc]e",), (), ("2.0",), "elastic", ("elastic co licensing elastic license",)),
    Family("cc0", ("creative commons zero", "creative commons cc0", "cc zero"), ("cc0",), ("1.0",), "cc0", ("creativecommons org publicdomain zero {v}",)),
    Family("openrail", ("openrail licen[sc]e", "creativeml open rail m", "bigscience openrail m"), ("openrail",), (), "openrail"),
    Family("llama", ("llama 2 community licen[sc]e", "llama 3 community licen[sc]e", "llama community licen[sc]e"), (), (), ""),
)

#: Creative Commons: the conditions with their full names, and the versions.
CC = {"by": "attribution", "by sa": "attribution share ?alike", "by nd": "attribution no ?deriv(?:ative|ive)?s?", "by nc": "attribution non ?commercial", "by nc sa": "attribution non ?commercial share ?alike", "by nc nd": "attribution non ?commercial no ?deriv(?:ative|ive)?s?"}
CC_VERSIONS = ("1.0", "2.0", "2.5", "3.0", "4.0")

#: Passages of license texts and notices, which name no version: label, priority, confidence, words.
PASSAGES = (
    ("mit", 3, 0.95, "permission is hereby granted free of charge to any person obtaining a copy of this software"),
    ("bsd", 3, 0.95, "redistribution and use in source and binary forms with or without modification are permitted"),
    ("bsd-3-clause", 3, 0.9, "neither the name of (?:[^ ]+ ){1,12}nor the names of its contributors"),
    ("bsd-4-clause", 3, 0.9, "all advertising materials mentioning features or use of this software must display"),
    ("isc", 3, 0.95, "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"),
    ("gpl", 3, 0.95, "this program is free software you can redistribute it and or modify it under the terms of the gnu general public licen[sc]e"),
    ("lgpl", 3, 0.95, "this (?:library|program) is free software you can redistribute it and or modify it under the terms of the gnu (?:lesser|library) general public licen[sc]e"),
    ("agpl", 3, 0.95, "this program is free software you can redistribute it and or modify it under the terms of the gnu affero general public licen[sc]e"),
    ("gfdl", 3, 0.95, "permission is granted to copy distribute and or modify this document under the terms of the gnu free documentation licen[sc]e"),
    ("apache-2.0", 3, 0.95, "licensed under the apache licen[sc]e version 2 0 the license you may not use this file except in compliance with the license"),
    ("mpl-2.0", 3, 0.95, "this source code form is subject to the terms of the mozilla public licen[sc]e v 2 0"),
    ("boost-1.0", 3, 0.95, "distributed under the boost software licen[sc]e version 1 0"),
    ("unlicense", 3, 0.95, "this is free and unencumbered software released into the public domain"),
    ("zlib", 3, 0.9, "this software is provided as is without any express or implied warranty in no event will the authors be held liable"),
    ("epl", 3, 0.9, "this program and the accompanying materials are made available under the terms of the eclipse public licen[sc]e"),
    ("ofl", 3, 0.95, "this font software is licensed under the sil open font licen[sc]e"),
    ("wtfpl", 3, 0.95, "you just do what the fuck you want to"),
    ("cc0", 3, 0.9, "no rights reserved"),
    ("public-domain", 6, 0.6, "released (?:in)?to the public domain"),
    ("public-domain", 6, 0.6, "dedicated to the public domain"),
    ("public-domain", 7, 0.4, "public domain"),
    ("copyleft", 7, 0.3, "copyleft"),
    ("all-rights-reserved", 6, 0.6, "all rights reserved"),
    ("proprietary", 6, 0.6, "proprietary and confidential"),
    ("proprietary", 6, 0.5, "confidential and proprietary"),
    ("proprietary", 6, 0.5, "end user licen[sc]e agreement"),
    ("proprietary", 6, 0.5, "eula"),
    ("proprietary", 6, 0.6, "unauthori[sz]ed copying of this (?:file|document|work)"),
    ("copyright", 8, 0.3, "copyright(?: c)? (?:19|20)[0-9]{2}"),
    ("copyright", 8, 0.3, "copyright(?: c)? by"),
    ("other", 9, 0.3, "licen[sc]ed under the terms of"),
    ("other", 9, 0.3, "distributed under the terms of"),
    ("other", 9, 0.3, "released under the terms of"),
    ("other", 9, 0.2, "open source licen[sc]e"),
    ("other", 9, 0.2, "free software licen[sc]e"),
)

LATER = "(?: (?:or later|or any later version|or newer|only))?"


def _version(v: str) -> str:
    """A version as words: 2.0 is "2 0", and "2" as well."""
    major, _, minor = v.partition(".")
    return major if not minor else f"{major}(?: {minor})?" if minor == "0" else f"{major} {minor}"


def _rules() -> tuple[Rule, ...]:
    """The ordered rules: tags, addresses, passages, names with a version, names alone, notices."""
    out: list[Rule] = []

    def add(label: str, priority: int, confidence: float, words: str) -> None:
        out.append(Rule(f"{label}/{priority}/{len(out)}", label, priority, confidence, words))

    for f in FAMILIES:
        versions = f.versions or ("",)
        for v in versions:
            label, spaced = f"{f.label}-{v}" if v else f.label, f" {_version(v)}" if v else ""
            if f.spdx:
                add(label, 1, 0.99, f"spdx license identifier {f.spdx}{spaced}{LATER}")
            for url in f.urls:
                if "{v}" not in url:
                    continue
                add(label, 2, 0.95, url.replace("{v}", _version(v)))
            if not v:
                continue
            for name in f.names:
                add(label, 4, 0.9, f"{name}(?: version| v| versions)?{spaced}{LATER}")
                add(label, 4, 0.9, f"{name} v{v[0]}(?: {v[2:] or 0})?{LATER}")
            for short in f.short:
                major, _, minor = v.partition(".")
                add(label, 4, 0.85, f"{short}(?: version| v| licen[sc]e version)?{spaced}{LATER}")
                add(label, 4, 0.85, f"{short}v{major}" + (f"(?: {minor})?" if minor == "0" else f" {minor}" if minor else "") + LATER)
                add(label, 4, 0.85, f"{short}{major}" + (f"(?: {minor})?" if minor == "0" else f" {minor}" if minor else "") + LATER)
        for url in f.urls:
            if "{v}" not in url:
                add(f.label, 2, 0.95, url)
        for name in f.names:
            add(f.label, 5, 0.7, name)
        for short in f.short:
            add(f.label, 5, 0.6, f"{short} licen[sc]ed?")
            if short in ("gpl", "lgpl", "agpl", "gfdl", "cddl", "eupl", "cc0", "odbl"):
                add(f.label, 5, 0.5, short)
    for code, name in CC.items():
        label = "cc-" + code.replace(" ", "-")
        for v in CC_VERSIONS:
            add(f"{label}-{v}", 1, 0.99, f"spdx license identifier cc {code} {_version(v)}")
            add(f"{label}-{v}", 2, 0.95, f"creativecommons org licenses {code} {v.replace('.', ' ')}")
            add(f"{label}-{v}", 4, 0.9, f"cc {code} {_version(v)}")
            add(f"{label}-{v}", 4, 0.9, f"creative commons {name} {_version(v)}")
            add(f"{label}-{v}", 4, 0.9, f"creative commons {name}(?: international| unported)? licen[sc]e(?: version)? {_version(v)}")
        add(label, 5, 0.7, f"cc {code}")
        add(label, 5, 0.7, f"creative commons {name}")
    add("cc", 6, 0.5, "creative commons licen[sc]e")
    for label, priority, confidence, words in PASSAGES:
        add(label, priority, confidence, words)
    # A license named where the text says that it applies: the name's own rule says which; this says that it does.
    for verb in ("licensed", "licenced", "released", "distributed", "available", "published"):
        add("other", 9, 0.4, f"{verb} under (?:the |a |an )?(?:[^ ]+ ){{1,5}}licen[sc]e")
    return tuple(out)


def _longest(words: str) -> int:
    """The most words that a pattern can match, by its spaces and bounded repeats."""
    flat = re.sub(r"\(\?:\[\^ \]\+ \)\{1,(\d+)\}", lambda m: "w " * int(m[1]), words)
    return flat.count(" ") + 1


RULES = _rules()
for _rule in RULES:
    if _longest(_rule.words) > WINDOW:
        raise ValueError(f"{_rule.name} can span more than {WINDOW} words")


def keyword(rule: Rule) -> str:
    """What a text must hold, with a space before each word, for the rule to match: one of KEYWORDS, or else the rule's longest plain run of words."""
    plain, before = rule.words, ""
    while plain != before:  # optional groups from the inside out, then optional characters
        plain, before = re.sub(r"\(\?:(?:[^()]|\(\?:[^()]*\))*\)\?", "\0", plain), plain
    runs = [f" {x}" if k == 0 else x for k, x in enumerate(re.split(r"[^a-z0-9 ]+", re.sub(r"(?<=[a-z ])\?", "\0", re.sub(r"[a-z ]\?", "\0", plain))))]
    for word in KEYWORDS:
        if any(word in f"{x} " if rule.words.endswith(x) and x else word in x for x in runs):
            return word
    return max(runs, key=len).rstrip()


def gates(rules: tuple[Rule, ...]) -> list[str]:
    """The keywords of all rules, without those that hold another one. A document without any of them holds no detection."""
    words = {keyword(r) for r in rules} | {f" {p}" for p in BASE}
    return sorted(w for w in words if not any(x in w and x != w for x in words))


def _starts(rules: tuple[Rule, ...]) -> dict[str, list[Rule]]:
    """Rules by the words that they can begin with: the first token, with its optional parts and choices written out."""
    by: dict[str, list[Rule]] = {}
    for r in rules:
        first = re.sub(r"\(\?:.*", "", r.first)
        letters = [first]
        for choice in re.findall(r"\[([a-z]+)\]", first):
            letters = [x.replace(f"[{choice}]", c, 1) for x in letters for c in choice]
        for word in letters:
            by.setdefault(word, []).append(r)
    return by


def words_text(text: Column) -> Column:
    """The text's words with one space between, capitals as they are: A to Z are part of words here as their small letters are."""
    return F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", " "))


def _found(words: Column, at: Column, by: dict[str, list[Rule]], order: dict[str, int]) -> Column:
    """Detections that begin at each word number of ``at``: an array for each."""
    shape = "array<struct<rule:string,label:string,priority:int,confidence:double,ord:int,pattern:string>>"
    # One constant: as many expressions as there are rules would take the planner longer than the scan.
    table = {w: [{"rule": r.name, "label": r.label, "priority": r.priority, "confidence": r.confidence, "ord": order[r.name], "pattern": f"^{r.words}(?= )"} for r in own] for w, own in by.items()}
    rules = F.from_json(F.lit(json.dumps(table)), f"map<string,{shape}>")

    def here(i: Column) -> Column:
        ahead = F.concat(F.array_join(F.slice(words, i + 1, F.lit(WINDOW)), " "), F.lit(" "))
        matched = lambda w, r: F.struct(r.alias("r"), F.call_function("regexp_extract", w, r["pattern"], F.lit(0)).alias("m"))
        span = lambda x: F.struct(i.alias("start"), (i + F.size(F.split(x["m"], " "))).alias("end"), *(x["r"][c].alias(c) for c in ("rule", "label", "priority", "confidence", "ord")))
        own = F.coalesce(F.try_element_at(rules, F.get(words, i)), F.array().cast(shape))
        return let(ahead, lambda w: F.transform(F.filter(F.transform(own, lambda r: matched(w, r)), lambda x: x["m"] != ""), span))

    return F.transform(at, here)


def _beats(e: Column, d: Column) -> Column:
    """Whether detection e makes d superfluous: one of better priority that lies within d or around it, or a better one of the same around it."""
    around, within = (e["start"] <= d["start"]) & (e["end"] >= d["end"]), (e["start"] >= d["start"]) & (e["end"] <= d["end"])
    same = around & within
    return ((e["priority"] < d["priority"]) & (around | within)) | ((e["priority"] == d["priority"]) & around & (~same | (e["ord"] < d["ord"])))


def _resolved(found: Column) -> Column:
    """Detections against those of neighbouring starts: what lies around or within one begins less than WINDOW words, so less than WINDOW entries, away."""
    near = lambda k: F.flatten(F.slice(found, F.greatest(k + 2 - WINDOW, F.lit(1)), F.least(k + WINDOW, F.lit(2 * WINDOW))))
    return F.flatten(F.transform(found, lambda own, k: F.when(F.size(own) == 0, own).otherwise(let(near(k), lambda all_: F.filter(own, lambda d: ~F.exists(all_, lambda e: _beats(e, d)))))))


def scan(docs: DataFrame, text: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """``docs`` plus n_words, places (start, label of the base phrases) and licenses (start, end, rule, label, priority, confidence): word numbers from 0, end exclusive."""
    by, order = _starts(rules), {r.name: k for k, r in enumerate(rules)}
    starts = sorted({*by, *(p.split(" ")[0] for p in BASE)})
    n_words, places, licenses, spaced, words, at, found = free_names(docs.columns, "n_words", "places", "licenses", "spaced", "words", "at", "found")
    held = [f"`{c}`" for c in docs.columns]
    rows = docs.withColumn(spaced, words_text(F.col(f"`{text}`")))
    # Lowered by Unicode's rules a text holds every keyword that it holds lowered by ASCII's.
    keywords = F.array(*map(F.lit, gates(rules)))
    gate = let(F.concat(F.lit(" "), F.lower(spaced), F.lit(" ")), lambda t: F.exists(keywords, lambda word: F.contains(t, word)))
    lowered = F.translate(spaced, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    none = F.array().cast("array<string>")
    rows = rows.withColumn(words, F.when((F.col(spaced) != "") & gate, F.split(lowered, " ")).otherwise(none))
    count = F.when(F.col(spaced) == "", 0).otherwise(F.length(spaced) - F.length(F.replace(F.col(spaced), F.lit(" "), F.lit(""))) + 1)
    rows = rows.select(*held, count.cast("long").alias(n_words), words)
    numbers = F.when(F.size(words) > 0, F.sequence(F.lit(0), F.size(words) - 1)).otherwise(F.array().cast("array<int>"))
    rows = rows.withColumn(at, F.filter(numbers, lambda i: F.get(words, i).isin(starts)))

    def phrase(i: Column) -> Column:
        out = F.when(F.lit(False), "")
        for p, label in BASE.items():
            same = F.lit(True)
            for k, w in enumerate(p.split(" ")):
                same = same & (F.get(words, i + k) == w)
            out = out.when(same, label)
        return out

    based = F.filter(F.transform(at, lambda i: F.struct(i.cast("long").alias("start"), phrase(i).alias("label"))), lambda x: x["label"].isNotNull())
    rows = rows.select(*held, n_words, based.alias(places), _found(F.col(words), F.col(at), by, order).alias(found))
    kept = F.transform(_resolved(F.col(found)), lambda d: F.struct(d["start"].cast("long").alias("start"), d["end"].cast("long").alias("end"), *(d[c].alias(c) for c in ("rule", "label", "priority", "confidence"))))
    return rows.select(*held, n_words, places, kept.alias(licenses))


def score(licenses: Column) -> Column:
    """How sure a document names a license: one less the product of its rules' doubts, each rule once."""
    rules = F.array_distinct(F.transform(licenses, lambda d: F.struct(d["rule"].alias("rule"), d["confidence"].alias("confidence"))))
    return F.lit(1.0) - F.aggregate(rules, F.lit(1.0), lambda doubt, r: doubt * (1 - r["confidence"]))


def op13_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base places, labels and score of every document."""
    docs = only(spark.read.parquet(f"{sf_dir}/documents.parquet"), doc_id="long", text="string")
    rows = scan(docs)
    sorted_ = lambda labels: F.array_join(F.array_sort(F.array_distinct(labels)), ",")
    base, own, at = F.transform("places", lambda x: x["label"]), F.transform("licenses", lambda x: x["label"]), F.transform("places", lambda x: x["start"])
    return rows.select("doc_id", "n_words", F.size("places").cast("long").alias("n_base"), F.array_min(at).alias("first_word"), F.array_max(at).alias("last_word"), sorted_(base).alias("base_labels"), sorted_(F.concat(base, own)).alias("labels"), score(F.col("licenses")).alias("score"))
