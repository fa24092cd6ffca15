"""License scans: ordered signature rules over whole texts.

A rule is a regular expression with a label, a keyword and a priority. A text is looked at
more closely only if it holds any keyword; then the rules of its keywords run. Detections
are intervals of the text: one that lies inside an interval of a rule of higher priority, or
of the same priority and listed earlier, is suppressed. Only SQL functions are used.
"""

from __future__ import annotations

import json
import re
from functools import reduce
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hydroseries.llm.words import GAP, WORD, count_words

#: A word in a text that is not lower-cased.
ANY_WORD = WORD.replace(r"\x3A-\x60", r"\x3A-\x40\x5B-\x60")
_BEFORE, _AFTER = r"(?<![^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F])", r"(?![^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F])"
#: One of these stands in every text that a name, a statement or a link can match; identifiers also match by themselves.
#: ("public domain" besides, with any gap.)
ROOTS = ("licen", "rights", "copyright", "creative", "permission", "redistribution", "proprietary", "warranty", "©")
_RULE = "keyword:string,pattern:string,label:string,priority:int,order:int,weight:double"


class Rule(NamedTuple):
    label: str
    keyword: str  # one word, lower case; the rule runs only on texts that hold it
    pattern: str
    priority: int  # 3 base phrase, 2 statement of a grant, 1 name or title, 0 identifier
    weight: float  # how far a detection alone supports the label


def phrase(text: str) -> str:
    """Words of a phrase standing one after the other, each whole."""
    return _BEFORE + GAP.join(text.split()) + _AFTER


def wrapped(pattern: str) -> str:
    """The pattern with a gap of any characters between words (line ends, comment signs) for each of its blanks."""
    loose = f"(?:{GAP})"
    return re.sub(" [?]?", lambda m: loose + "?" if m[0] == " ?" else loose, pattern)


def _name(pattern: str) -> str:
    """A name, in which a dot is a gap too."""
    return wrapped(pattern.replace(".?", " ?").replace(".", " "))


def _word(keyword: str) -> str:
    """The longest word of a keyword that says more than that this is a license."""
    return max((w for w in keyword.split() if w not in ("licen", "license")), key=len, default=keyword)


#: Phrases that every scan reports, with their labels; fixed values.
BASE = (("cc by", "cc-by"), ("general public license", "gpl"), ("all rights reserved", "reserved"))

#: (label, keyword, names as written, identifier); V stands for a version that becomes part of the label.
FAMILIES = (
    ("apache", "apache", ("apache(?: software)? licen[cs]e",), "apache", ("1.0", "1.1", "2.0")),
    ("gpl", "general public", ("gnu general public licen[cs]e",), "gpl", ("1.0", "2.0", "3.0")),
    ("lgpl", "general public", ("(?:gnu )?(?:lesser|library) general public licen[cs]e",), "lgpl", ("2.0", "2.1", "3.0")),
    ("agpl", "general public", ("(?:gnu )?affero general public licen[cs]e",), "agpl", ("1.0", "3.0")),
    ("gfdl", "documentation", ("gnu free documentation licen[cs]e",), "gfdl", ("1.1", "1.2", "1.3")),
    ("mpl", "mozilla", ("mozilla public licen[cs]e",), "mpl", ("1.0", "1.1", "2.0")),
    ("epl", "eclipse", ("eclipse public licen[cs]e",), "epl", ("1.0", "2.0")),
    ("cddl", "common development", ("common development and distribution licen[cs]e",), "cddl", ("1.0", "1.1")),
    ("cpl", "common public", ("common public licen[cs]e",), "cpl", ("1.0",)),
    ("eupl", "european union", ("european union public licen[cs]e",), "eupl", ("1.0", "1.1", "1.2")),
    ("osl", "open software", ("open software licen[cs]e",), "osl", ("1.0", "2.0", "2.1", "3.0")),
    ("afl", "academic free", ("academic free licen[cs]e",), "afl", ("1.1", "2.0", "2.1", "3.0")),
    ("artistic", "artistic", ("artistic licen[cs]e",), "artistic", ("1.0", "2.0")),
    ("zpl", "zope", ("zope public licen[cs]e",), "zpl", ("1.1", "2.0", "2.1")),
    ("lppl", "latex", ("latex project public licen[cs]e",), "lppl", ("1.0", "1.1", "1.2", "1.3")),
    ("ofl", "open font", ("(?:sil )?open font licen[cs]e",), "ofl", ("1.0", "1.1")),
    ("boost", "boost", ("boost software licen[cs]e",), "bsl", ("1.0",)),
    ("upl", "universal permissive", ("universal permissive licen[cs]e",), "upl", ("1.0",)),
    ("ms-pl", "microsoft", ("microsoft public licen[cs]e",), "ms-pl", ()),
    ("ms-rl", "microsoft", ("microsoft reciprocal licen[cs]e",), "ms-rl", ()),
    ("mit", "mit licen", ("mit licen[cs]e",), "mit", ()),
    ("x11", "x11", ("x11 licen[cs]e",), "x11", ()),
    ("isc", "isc licen", ("isc licen[cs]e",), "isc", ()),
    ("zlib", "zlib", ("zlib licen[cs]e",), "zlib", ()),
    ("wtfpl", "public license", ("do what the fuck you want to public licen[cs]e",), "wtfpl", ()),
    ("unlicense", "unlicense", ("the unlicense",), "unlicense", ()),
    ("bsd-2-clause", "bsd", ("(?:2|two).clause bsd licen[cs]e", "simplified bsd licen[cs]e", "freebsd licen[cs]e"), "bsd-2-clause", ()),
    ("bsd-3-clause", "bsd", ("(?:3|three).clause bsd licen[cs]e", "(?:new|revised|modified) bsd licen[cs]e"), "bsd-3-clause", ()),
    ("bsd-4-clause", "bsd", ("(?:4|four).clause bsd licen[cs]e", "original bsd licen[cs]e"), "bsd-4-clause", ()),
    ("bsd", "bsd", ("bsd licen[cs]e", "berkeley software distribution licen[cs]e"), "bsd", ()),
    ("python", "python", ("python software foundation licen[cs]e", "psf licen[cs]e"), "python", ("2.0",)),
    ("php", "php licen", ("php licen[cs]e",), "php", ("3.0", "3.01")),
    ("ruby", "ruby licen", ("ruby licen[cs]e",), "ruby", ()),
    ("openssl", "openssl", ("openssl licen[cs]e",), "openssl", ()),
    ("curl", "curl", ("curl licen[cs]e",), "curl", ()),
    ("postgresql", "postgresql", ("postgresql licen[cs]e",), "postgresql", ()),
    ("ncsa", "ncsa", ("ncsa open source licen[cs]e",), "ncsa", ()),
    ("odbl", "open database", ("open database licen[cs]e",), "odbl", ("1.0",)),
    ("odc-by", "open data", ("open data commons attribution licen[cs]e",), "odc-by", ("1.0",)),
    ("pddl", "public domain", ("public domain dedication and licen[cs]e",), "pddl", ("1.0",)),
    ("json", "json licen", ("json licen[cs]e",), "json", ()),
    ("beerware", "beer", ("beer.?ware licen[cs]e",), "beerware", ()),
    ("ecl", "educational community", ("educational community licen[cs]e",), "ecl", ("1.0", "2.0")),
    ("rpl", "reciprocal public", ("reciprocal public licen[cs]e",), "rpl", ("1.1", "1.5")),
    ("qpl", "q public", ("q public licen[cs]e",), "qpl", ("1.0",)),
    ("sspl", "server side", ("server side public licen[cs]e",), "sspl", ("1.0",)),
    ("busl", "business source", ("business source licen[cs]e",), "busl", ("1.1",)),
    ("elastic", "elastic", ("elastic licen[cs]e",), "elastic", ("2.0",)),
    ("mulan", "mulan", ("mulan (?:permissive software|psl) licen[cs]e",), "mulanpsl", ("1.0", "2.0")),
    ("cecill", "cecill", ("cecill(?: free software)? licen[cs]e",), "cecill", ("1.0", "2.0", "2.1")),
)

#: Parts of a creative-commons label, as an identifier and in words.
CC_PARTS = (("by", "attribution"), ("by-sa", "attribution.share.?alike"), ("by-nc", "attribution.non.?commercial"), ("by-nd", "attribution.no.?derivatives"),
            ("by-nc-sa", "attribution.non.?commercial.share.?alike"), ("by-nc-nd", "attribution.non.?commercial.no.?derivatives"))

#: Statements that name no license, or one by its wording.
STATEMENTS = (
    ("mit", "hereby granted", r"permission is hereby granted,? free of charge,? to any person obtaining a copy", 2, 0.95),
    ("isc", "permission to", r"permission to use, copy, modify,? and(?:/or)? distribute this software for any purpose", 2, 0.9),
    ("bsd", "redistribution", r"redistribution and use in source and binary forms,? with or without modification", 2, 0.95),
    ("gpl", "free software foundation", r"under the terms of the gnu general public licen[cs]e as published by the free software foundation", 2, 0.98),
    ("public-domain", "public domain", r"(?:released|placed|dedicated|is) (?:in|into|to) the public domain", 2, 0.8),
    ("public-domain", "public domain", r"public domain", 1, 0.5),
    ("cc0", "cc0", r"\bcc0\b(?: 1\.0)?", 1, 0.9),
    ("cc0", "no rights reserved", r"no rights reserved", 1, 0.6),
    ("copyright", "copyright", r"copyright\s*(?:\(c\)|©)?\s*(?:19|20)\d\d", 1, 0.4),
    ("copyright", "©", r"©\s*(?:19|20)\d\d", 1, 0.4),
    ("proprietary", "proprietary", r"proprietary and confidential", 2, 0.8),
    ("warranty", "warranty", r"provided \W?as is\W?,? without (?:any )?(?:express or implied )?warranty", 1, 0.3),
    ("license-link", "licen", r"https?://[^\s\"'<>]*licen[cs]e[^\s\"'<>]*", 0, 0.3),
)


def build_rules() -> list[Rule]:
    """Several hundred rules, in the order in which equal priorities are preferred."""
    rules = [Rule(label, max(text.split(), key=len) if label != "reserved" else "rights", phrase(text), 3, 1.0) for text, label in BASE]
    grant = wrapped(r"(?:licen[cs]ed|released|distributed|published|available|covered|made available) under (?:the )?(?:terms of )?(?:the )?")
    gap = f"(?:{GAP})"
    # A number on the next line counts only with its word or its point, as it may number a clause.
    version = lambda v: rf"(?:{gap}?(?:version|v\.?){gap}?{re_version(v)}|,? ?{re_version(v)}|{gap}{re.escape(v)})"


    def add(label: str, keyword: str, name: str, weight: float) -> None:
        rules.append(Rule(label, _word(keyword), grant + name, 2, min(1.0, weight + 0.1)))
        rules.append(Rule(label, _word(keyword), r"(?<![A-Za-z0-9])" + name + r"(?![A-Za-z0-9])", 1, weight))

    for label, keyword, names, ident, versions in FAMILIES:
        for v in versions:
            for name in names:
                add(f"{label}-{v}", keyword, _name(name) + version(v), 0.9)
            rules.append(Rule(f"{label}-{v}", "spdx", rf"spdx-license-identifier:\s*{ident}-{re_version(v)}(?:-only|-or-later|\+)?", 2, 1.0))
            rules.append(Rule(f"{label}-{v}", ident, rf"(?<![A-Za-z0-9-]){ident}[ -]v?{re_version(v)}(?![.\d]*\d)", 0, 0.7))
        for name in names:
            add(label, keyword, _name(name), 0.75)
        rules.append(Rule(label, "spdx", rf"spdx-license-identifier:\s*{ident}(?![A-Za-z0-9.-])", 2, 1.0))
    for part, spoken in CC_PARTS:
        for v in ("1.0", "2.0", "2.5", "3.0", "4.0"):
            rules.append(Rule(f"cc-{part}-{v}", "cc", rf"(?<![A-Za-z0-9])cc[ -]{part.replace('-', '[ -]')}[ -]{re_version(v)}(?![.\d]*\d)", 1, 0.95))
        add(f"cc-{part}", "creative commons", _name(rf"creative commons {spoken}(?: licen[cs]e)?"), 0.9)
        rules.append(Rule(f"cc-{part}", "creativecommons", rf"creativecommons\.org/licenses/{part}(?![a-z-])[^\s\"'<>]*", 1, 0.9))
        rules.append(Rule(f"cc-{part}", "cc", rf"(?<![A-Za-z0-9])cc[ -]{part.replace('-', '[ -]')}(?![A-Za-z0-9-])", 0, 0.7))
    rules += [Rule(label, _word(keyword), wrapped(pattern), priority, weight) for label, keyword, pattern, priority, weight in STATEMENTS]
    return rules


def re_version(v: str) -> str:
    return v.replace(".", r"\.") if not v.endswith(".0") else rf"{v[:-2]}(?:\.0)?"


def _starts(text: Column, pattern: Column, label: Column, priority: Column, order: Column, weight: Column) -> Column:
    """Detections of one rule: structs of start and end (characters from 0) and the rule's own values."""
    zero = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int>>").alias("spans"))
    # What stands between the matches, each with the match after it; a match starts at the length of all that stands before it.
    lengths = F.zip_with(F.split(text, pattern, -1), F.regexp_extract_all(text, pattern, F.lit(0)), lambda p, m: F.struct(F.length(p).alias("gap"), F.length(m).alias("n")))
    walk = F.aggregate(lengths, zero, lambda acc, p: F.struct(
        (acc["at"] + p["gap"] + F.coalesce(p["n"], F.lit(0))).alias("at"),
        F.when(p["n"].isNotNull(), F.concat(acc["spans"], F.array(F.struct((acc["at"] + p["gap"]).alias("start"), (acc["at"] + p["gap"] + p["n"]).alias("end"))))).otherwise(acc["spans"]).alias("spans")))
    return F.transform(walk["spans"], lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), priority.alias("priority"), order.alias("order"),
                                                         label.alias("label"), weight.alias("weight")))


def gate(low: Column, keywords: list[str]) -> Column:
    """May any rule match? ``low`` holds a root; the ``keywords`` of identifiers count only as a word before a number, "cc" as a word."""
    idents = "|".join(sorted(k for k in set(keywords) if k != "cc" and not any(root in k for root in ROOTS)))
    numbered = low.rlike(r"[a-z0-9][ -]v?\d") & low.rlike(rf"(?<![a-z0-9-])(?:{idents})[ -]v?\d")
    as_word = F.contains(low, F.lit("cc")) & low.rlike(rf"(?<![^\x00-\x2F\x3A-\x60\x7B-\x7F])cc(?:{GAP}|0)")
    return reduce(lambda a, b: a | b, [*(F.contains(low, F.lit(root)) for root in ROOTS), F.contains(low, F.lit("public")) & low.rlike(f"public{GAP}domain"), as_word, numbered])


def detect(docs: DataFrame, rules: list[Rule] | None = None, text: str = "text") -> DataFrame:
    """``docs`` with a column ``detections``: what is left after suppression, as structs of start, end (characters), priority, order, label, weight.

    Sorted by start. A null or empty text has none; every row of ``docs`` stays as it is.
    """
    rules = build_rules() if rules is None else rules
    by_keyword: dict[str, list[dict]] = {}
    for i, r in enumerate(rules):
        by_keyword.setdefault(r.keyword, []).append(r._asdict() | {"pattern": "(?i)" + r.pattern, "order": i})
    table = F.from_json(F.lit(json.dumps([{"keyword": k, "rules": v} for k, v in by_keyword.items()])), f"array<struct<keyword:string,rules:array<struct<{_RULE}>>>>")
    read = docs.withColumn("_low", F.lower(F.coalesce(F.col(text), F.lit(""))))
    read = read.withColumn("_low", F.when(gate(F.col("_low"), [r.keyword for r in rules if r.priority == 0]), F.col("_low")))
    read = read.withColumn("_plain", F.when(F.col("_low").isNotNull(), F.col(text)))
    due = F.flatten(F.transform(F.filter(table, lambda k: F.contains(F.col("_low"), k["keyword"])), lambda k: k["rules"]))
    read = read.withColumn("_runs", F.when(F.col("_low").isNotNull(), due))
    found = F.flatten(F.transform("_runs", lambda r: _starts(F.col("_plain"), r["pattern"], r["label"], r["priority"], r["order"], r["weight"])))
    read = read.withColumn("_found", found)
    inside = lambda x, y: (y["start"] <= x["start"]) & (x["end"] <= y["end"]) & (
        (y["priority"] > x["priority"]) | (y["priority"] == x["priority"]) & (y["order"] < x["order"]))
    kept = F.filter("_found", lambda x: (x["priority"] == 3) | ~F.exists("_found", lambda y: inside(x, y)))
    none = F.array().cast("array<struct<start:int,end:int,priority:int,order:int,label:string,weight:double>>")
    return read.withColumn("detections", F.coalesce(F.array_sort(kept), none)).drop("_plain", "_low", "_runs", "_found")


def license_report(docs: DataFrame, rules: list[Rule] | None = None) -> DataFrame:
    """Per row of ``docs`` (doc_id, text): doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, n_detections.

    n_base counts all places of the base phrases, first_word and last_word are their smallest and
    largest start in words from 0 (null without any), labels are sorted and distinct, and score
    is the largest weight of a detection (0 without any). A null text is empty.
    """
    found = detect(docs.select("doc_id", "text"), rules)
    base = F.filter("detections", lambda d: d["priority"] == 3)
    names = lambda a: F.array_join(F.array_sort(F.array_distinct(F.transform(a, lambda d: d["label"]))), ",")
    word_at = lambda start: F.regexp_count(F.substring(F.col("text"), F.lit(1), start), F.lit(ANY_WORD)).cast("long")
    starts = F.transform("base", lambda d: d["start"])
    return found.withColumn("base", base).select(
        "doc_id", count_words(F.col("text")).alias("n_words"), F.size("base").cast("long").alias("n_base"),
        F.when(F.size("base") > 0, word_at(F.array_min(starts))).alias("first_word"), F.when(F.size("base") > 0, word_at(F.array_max(starts))).alias("last_word"),
        names(F.col("base")).alias("base_labels"), names(F.col("detections")).alias("labels"),
        F.coalesce(F.array_max(F.transform("detections", lambda d: d["weight"])), F.lit(0.0)).alias("score"), F.size("detections").cast("long").alias("n_detections"))
