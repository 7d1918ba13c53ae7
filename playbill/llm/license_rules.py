"""Licence scans by ordered signature rules.

A text is lower-cased (A-Z) and reduced to its words, joined by one space. A text that holds no trigger word ends there.
Otherwise each rule is gated by its keyword, the rules that pass are matched as regular expressions over the words, and
every match becomes a detection with a span of words. Rules are ordered: their place is their priority. A detection is
suppressed when another one contains its span and is longer, or has the same span and a better priority.

Rules come from families (name, keyword, identifier) and from hand-written forms of text that each family is put into,
after the base phrases, which come first. Everything is built-in expressions inside a row: nothing is shuffled.

Null and empty texts have no words, no detections and score 0. Repeated rows give repeated results. A very long text costs
one pass for the words, one for the gates, and one for each rule that passes its gate."""

from __future__ import annotations

import json
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

# Fixed values of the contract: phrases and labels.
BASE = (
    ("gnu general public license", "gpl"),
    ("apache license", "apache"),
    ("cc by", "cc-by"),
    ("mit license", "mit"),
)
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

# Licence families: label, keyword of the gate, name as a pattern over words, identifier as a pattern over words.
FAMILIES = (
    ("gpl-1.0", "gnu general public", "gnu general public licen[cs]e(?: version| v)? 1(?: 0)?", "gpl 1 0(?: only| or later)?"),
    ("gpl-2.0", "gnu general public", "gnu general public licen[cs]e(?: version| v)? 2(?: 0)?", "gpl 2 0(?: only| or later)?"),
    ("gpl-3.0", "gnu general public", "gnu general public licen[cs]e(?: version| v)? 3(?: 0)?", "gpl 3 0(?: only| or later)?"),
    ("lgpl-2.0", "general public", "gnu (?:library|lesser) general public licen[cs]e(?: version| v)? 2(?: 0)?", "lgpl 2 0(?: only| or later)?"),
    ("lgpl-2.1", "general public", "gnu lesser general public licen[cs]e(?: version| v)? 2 1", "lgpl 2 1(?: only| or later)?"),
    ("lgpl-3.0", "general public", "gnu lesser general public licen[cs]e(?: version| v)? 3(?: 0)?", "lgpl 3 0(?: only| or later)?"),
    ("agpl-3.0", "affero", "gnu affero general public licen[cs]e(?: version| v)?(?: 3(?: 0)?)?", "agpl 3 0(?: only| or later)?"),
    ("gfdl-1.2", "free documentation", "gnu free documentation licen[cs]e(?: version| v)? 1 2", "gfdl 1 2(?: only| or later)?"),
    ("gfdl-1.3", "free documentation", "gnu free documentation licen[cs]e(?: version| v)? 1 3", "gfdl 1 3(?: only| or later)?"),
    ("apache-1.1", "apache", "apache(?: software)? licen[cs]e(?: version| v)? 1 1", "apache 1 1"),
    ("apache-2.0", "apache", "apache(?: software)? licen[cs]e(?: version| v)? 2(?: 0)?", "apache 2 0"),
    ("mit-0", "mit", "mit no attribution licen[cs]e", "mit 0"),
    ("mit", "mit", "(?:the )?mit(?: x11)? licen[cs]e", "mit"),
    ("x11", "x11", "(?:the )?x11 licen[cs]e", "x11"),
    ("bsd-1", "bsd", "(?:1|one) clause bsd licen[cs]e", "bsd 1 clause"),
    ("bsd-2", "bsd", "(?:(?:2|two) clause|simplified|freebsd) bsd licen[cs]e", "bsd 2 clause"),
    ("bsd-3", "bsd", "(?:(?:3|three) clause|new|modified|revised) bsd licen[cs]e", "bsd 3 clause"),
    ("bsd-4", "bsd", "(?:(?:4|four) clause|original|old) bsd licen[cs]e", "bsd 4 clause"),
    ("0bsd", "bsd", "(?:zero|0) clause bsd licen[cs]e", "0bsd"),
    ("isc", "isc", "(?:the )?isc licen[cs]e", "isc"),
    ("zlib", "zlib", "(?:the )?zlib(?: libpng)? licen[cs]e", "zlib"),
    ("mpl-1.0", "mozilla", "mozilla public licen[cs]e(?: version| v)? 1 0", "mpl 1 0"),
    ("mpl-1.1", "mozilla", "mozilla public licen[cs]e(?: version| v)? 1 1", "mpl 1 1"),
    ("mpl-2.0", "mozilla", "mozilla public licen[cs]e(?: version| v)? 2(?: 0)?", "mpl 2 0"),
    ("epl-1.0", "eclipse", "eclipse public licen[cs]e(?: version| v)? 1(?: 0)?", "epl 1 0"),
    ("epl-2.0", "eclipse", "eclipse public licen[cs]e(?: version| v)? 2(?: 0)?", "epl 2 0"),
    ("eupl-1.2", "european union", "european union public licen[cs]e(?: version| v)? 1 2", "eupl 1 2"),
    ("cddl-1.0", "common development", "common development and distribution licen[cs]e(?: version| v)? 1 0", "cddl 1 0"),
    ("cddl-1.1", "common development", "common development and distribution licen[cs]e(?: version| v)? 1 1", "cddl 1 1"),
    ("cpl-1.0", "common public", "common public licen[cs]e(?: version| v)? 1 0", "cpl 1 0"),
    ("ms-pl", "microsoft", "microsoft public licen[cs]e", "ms pl"),
    ("ms-rl", "microsoft", "microsoft reciprocal licen[cs]e", "ms rl"),
    ("artistic-1.0", "artistic", "artistic licen[cs]e(?: version| v)? 1(?: 0)?", "artistic 1 0"),
    ("artistic-2.0", "artistic", "artistic licen[cs]e(?: version| v)? 2(?: 0)?", "artistic 2 0"),
    ("bsl-1.0", "boost", "boost software licen[cs]e(?: version| v)?(?: 1(?: 0)?)?", "bsl 1 0"),
    ("busl-1.1", "business", "business source licen[cs]e(?: version| v)?(?: 1 1)?", "busl 1 1"),
    ("unlicense", "unlicense", "(?:the )?unlicense", "unlicense"),
    ("wtfpl", "do what the", "do what the fuck you want to public licen[cs]e", "wtfpl"),
    ("psf-2.0", "python", "python software foundation licen[cs]e(?: version| v)?(?: 2)?", "psf 2 0"),
    ("php-3.01", "php", "php licen[cs]e(?: version| v)? 3 01", "php 3 01"),
    ("ofl-1.1", "font", "(?:sil )?open font licen[cs]e(?: version| v)?(?: 1 1)?", "ofl 1 1"),
    ("odbl-1.0", "open", "open (?:data commons open )?database licen[cs]e(?: version| v)?(?: 1 0)?", "odbl 1 0"),
    ("pddl-1.0", "public domain", "public domain dedication and licen[cs]e", "pddl 1 0"),
    ("cc0-1.0", "cc0", "(?:creative commons )?cc0(?: 1 0)?(?: universal)?", "cc0 1 0"),
    ("cc-by-2.0", "attribution", "creative commons attribution 2 0", "cc by 2 0"),
    ("cc-by-3.0", "attribution", "creative commons attribution 3 0", "cc by 3 0"),
    ("cc-by-4.0", "attribution", "creative commons attribution 4 0(?: international)?", "cc by 4 0"),
    ("cc-by-sa-3.0", "attribution", "creative commons attribution share ?alike 3 0", "cc by sa 3 0"),
    ("cc-by-sa-4.0", "attribution", "creative commons attribution share ?alike 4 0(?: international)?", "cc by sa 4 0"),
    ("cc-by-nc-3.0", "attribution", "creative commons attribution non ?commercial 3 0", "cc by nc 3 0"),
    ("cc-by-nc-4.0", "attribution", "creative commons attribution non ?commercial 4 0(?: international)?", "cc by nc 4 0"),
    ("cc-by-nd-4.0", "attribution", "creative commons attribution no ?deriv(?:s|atives) 4 0(?: international)?", "cc by nd 4 0"),
    ("cc-by-nc-sa-4.0", "attribution", "creative commons attribution non ?commercial share ?alike 4 0(?: international)?", "cc by nc sa 4 0"),
    ("cc-by-nc-nd-4.0", "attribution", "creative commons attribution non ?commercial no ?deriv(?:s|atives) 4 0(?: international)?", "cc by nc nd 4 0"),
    ("sspl-1.0", "server side", "server side public licen[cs]e(?: version| v)?(?: 1)?", "sspl 1 0"),
    ("elastic-2.0", "elastic", "elastic licen[cs]e(?: version| v)?(?: 2 0)?", "elastic 2 0"),
    ("openssl", "openssl", "openssl licen[cs]e", "openssl"),
    ("ncsa", "ncsa", "(?:university of illinois )?ncsa open source licen[cs]e", "ncsa"),
    ("postgresql", "postgresql", "postgresql licen[cs]e", "postgresql"),
    ("upl-1.0", "universal", "universal permissive licen[cs]e(?: version| v)?(?: 1 0)?", "upl 1 0"),
    ("vim", "vim", "vim licen[cs]e", "vim"),
    ("w3c", "w3c", "w3c software(?: notice and)? licen[cs]e", "w3c"),
)

# Forms of text, written by hand: name of the form, keyword of its gate (empty: the family's), pattern around {name} or {id}, relevance.
FORMS = (
    ("grant", "", "(?:licensed|released|distributed|published|available) under(?: the)?(?: terms of)?(?: the)? {name}", 1.0),
    ("tag", "spdx", "spdx license identifier {id}", 1.0),
    ("field", "licen", "licen[cs]e {id}", 0.8),
    ("name", "", "{name}", 0.6),
)
# Texts of notices, written by hand: label, keyword, pattern, relevance.
NOTICES = (
    ("mit", "granted", "permission is hereby granted free of charge to any person obtaining a copy", 1.0),
    ("isc", "granted", "permission to use copy modify and or distribute this software for any purpose", 1.0),
    ("bsd", "redistribution", "redistribution and use in source and binary forms with or without modification are permitted", 1.0),
    ("bsd-3", "endorse", "may be used to endorse or promote products derived from this software without specific prior written permission", 1.0),
    ("apache-2.0", "apache", "you may not use this file except in compliance with the license", 0.9),
    ("apache-2.0", "apache", "www apache org licenses license 2 0", 0.9),
    ("gpl", "redistribute", "this program is free software you can redistribute it and or modify it", 1.0),
    ("lgpl", "redistribute", "this library is free software you can redistribute it and or modify it", 1.0),
    ("gpl", "gnu", "www gnu org licenses gpl(?: [0-9]+ [0-9]+)?", 0.9),
    ("lgpl", "gnu", "www gnu org licenses lgpl(?: [0-9]+ [0-9]+)?", 0.9),
    ("agpl-3.0", "gnu", "www gnu org licenses agpl(?: [0-9]+ [0-9]+)?", 0.9),
    ("mpl-2.0", "mozilla", "this source code form is subject to the terms of the mozilla public license", 1.0),
    ("unlicense", "unencumbered", "this is free and unencumbered software released into the public domain", 1.0),
    ("zlib", "altered", "altered source versions must be plainly marked as such", 0.9),
    ("bsl-1.0", "boost", "www boost org license 1 0 txt", 0.9),
    ("wtfpl", "wtfpl", "www wtfpl net", 0.8),
    ("cc-by", "creativecommons", "creativecommons org licenses by [0-9] [0-9]", 0.9),
    ("cc-by-sa", "creativecommons", "creativecommons org licenses by sa [0-9] [0-9]", 0.9),
    ("cc-by-nc", "creativecommons", "creativecommons org licenses by nc [0-9] [0-9]", 0.9),
    ("cc0-1.0", "creativecommons", "creativecommons org publicdomain zero 1 0", 0.9),
    ("public-domain", "public", "(?:dedicated to|released into|placed in|in) the public domain", 0.7),
    ("all-rights-reserved", "reserved", "all rights reserved", 0.5),
    ("proprietary", "confidential", "proprietary and confidential", 0.7),
)
#: A text with none of these holds no keyword of any rule.
TRIGGERS = "licen|spdx|cc by|cc0|creative|permission|redistribut|domain|reserved|gnu|propriet|altered|wtfpl|apache"


@dataclass(frozen=True)
class Rule:
    priority: int
    label: str
    keyword: str
    pattern: str
    relevance: float


def signature_rules() -> list[Rule]:
    """Base phrases first, then tags, grants and notices, then fields and names; within a form, families in their order."""
    found = [(label, phrase, phrase, 0.6) for phrase, label in BASE]
    by_form = {form: [(label, gate or keyword, pattern.format(name=name, id=ident), relevance)
                      for label, keyword, name, ident in FAMILIES] for form, gate, pattern, relevance in FORMS}
    found += by_form["tag"] + by_form["grant"] + list(NOTICES) + by_form["field"] + by_form["name"]
    return [Rule(i, *rule) for i, rule in enumerate(found)]


def _let(value: Column, body) -> Column:
    return F.get(F.transform(F.array(value), body), F.lit(0))


def word_line(text: Column) -> Column:
    """Words of the text, each with one space before it and after it; one space if there are none."""
    tidy = F.regexp_replace(F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER), SEPARATORS, " ")
    return F.concat(F.lit(" "), F.trim(tidy), F.when(F.trim(tidy) == "", "").otherwise(" "))


def spaces(line: Column) -> Column:
    return F.length(line) - F.length(F.replace(line, F.lit(" "), F.lit("")))


def rule_literals(rules: list[Rule]) -> Column:
    """All rules as one literal array, folded by the optimizer."""
    rows = json.dumps([{"p": r.priority, "l": r.label, "k": r.keyword, "x": f" {r.pattern}(?= )", "s": r.relevance, "b": r.priority < len(BASE)} for r in rules])
    return F.from_json(F.lit(rows), "array<struct<p: int, l: string, k: string, x: string, s: double, b: boolean>>")


#: Passes of a running value: enough for 2 ** DOUBLINGS items.
DOUBLINGS = 24


def running(values: Column, combine, level: int = 0) -> Column:
    """At each place the combined value of all items up to it. Each pass reaches twice as far back as the one before, so n items take log n passes."""
    if level == DOUBLINGS:
        return values
    step = 1 << level

    def deeper(v: Column) -> Column:
        reached = F.transform(v, lambda x, i: F.when(i >= step, combine(x, F.get(v, i - step))).otherwise(x))
        return F.when(F.size(v) > step, running(reached, combine, level + 1)).otherwise(v)

    return _let(values, deeper)


def _matches(line: Column, rule: Column) -> Column:
    """Detections of one rule: the text between matches gives the words before each."""
    def placed(found: Column) -> Column:
        parts = F.slice(F.split(line, rule["x"], F.lit(-1)), 1, F.size(found))
        ends = running(F.zip_with(parts, found, lambda p, m: (spaces(p) + spaces(m)).cast("long")), lambda x, y: x + y)
        return F.zip_with(found, ends, lambda match, end: F.struct(
            (end - spaces(match)).cast("long").alias("start"), (-end).cast("long").alias("minus_end"), rule["p"].alias("priority"),
            rule["l"].alias("label"), rule["s"].alias("relevance"), rule["b"].alias("base")))

    return _let(F.regexp_extract_all(line, rule["x"], F.lit(0)), placed)


def _unsuppressed(sorted_found: Column) -> Column:
    """Keeps a detection if none before it (start ascending, end descending, priority ascending) reaches its end."""
    def kept(found: Column) -> Column:
        reach = running(F.transform(found, lambda d: -d["minus_end"]), lambda x, y: F.greatest(x, y))
        return _let(reach, lambda r: F.filter(found, lambda d, i: (i == 0) | (F.get(r, i - 1) < -d["minus_end"])))

    return _let(sorted_found, kept)


def scanned(documents: DataFrame, rules: list[Rule] | None = None) -> DataFrame:
    """The documents with ``n_words``, all base detections ``base_found``, and the surviving ``detections``
    (start and end in words, rule priority, label, relevance)."""
    rules = rules or signature_rules()
    line = F.col("_line")
    gated = F.filter(F.col("_rules"), lambda r: F.contains(line, r["k"]))
    every = F.array_sort(F.flatten(F.transform(gated, lambda r: _matches(line, r))))
    kind = "array<struct<start: bigint, minus_end: bigint, priority: int, label: string, relevance: double, base: boolean>>"
    open_ = lambda d: F.struct(
        d["start"].alias("start"), (-d["minus_end"]).alias("end"), d["priority"].alias("priority"), d["label"].alias("label"), d["relevance"].alias("relevance"))
    rows = documents.withColumn("_line", word_line(F.col("text"))).withColumn("_rules", rule_literals(rules))
    rows = rows.withColumn("_found", F.when(F.regexp_like(line, F.lit(TRIGGERS)), every).otherwise(F.array().cast(kind)))
    return rows.withColumns({
        "n_words": (spaces(line) - 1).cast("long"),
        "base_found": F.transform(F.filter("_found", lambda d: d["base"]), open_),
        "detections": F.transform(_unsuppressed(F.col("_found")), open_),
    }).drop("_line", "_rules", "_found")


def digest(documents: DataFrame) -> DataFrame:
    rows = scanned(documents.select("doc_id", "text"))
    base = F.array_sort(F.array_distinct(F.transform("base_found", lambda d: d["label"])))
    all_labels = F.array_sort(F.array_union(base, F.transform("detections", lambda d: d["label"])))
    return rows.select(
        "doc_id", "n_words", F.size("base_found").cast("long").alias("n_base"),
        F.array_min(F.transform("base_found", lambda d: d["start"])).alias("first_word"),
        F.array_max(F.transform("base_found", lambda d: d["start"])).alias("last_word"),
        F.array_join(base, ",").alias("base_labels"), F.array_join(all_labels, ",").alias("labels"),
        F.coalesce(F.array_max(F.transform("detections", lambda d: d["relevance"])), F.lit(0.0)).alias("score"))
