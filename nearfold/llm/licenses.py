"""License scan by ordered signature rules, in DataFrame operations only.

Every rule is a regular expression over a text's words in lower case, each parted from the next by one space. A text
is looked at only where a cheap pattern finds some keyword, and a rule runs only where its own keyword stands. Each
detection is an interval of the word text; one that lies inside an interval of higher priority, or inside a longer one
of its own priority, is dropped. A text's labels are those of the detections left and of the base phrases.

Null and empty texts have no words, no labels and score 0; repeated rows give repeated results; extra columns are
ignored. A row's work grows with its own text only; no row is shuffled.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .hosts import LOWER, UPPER

#: Phrases of whole words, and their labels.
BASE = [("gnu general public license", "gpl"), ("apache license", "apache"), ("cc by", "cc-by"), ("mit license", "mit")]
#: Between words: every ASCII character that is no digit and no letter.
GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
WORD = r"[0-9A-Za-z\x{80}-\x{10FFFF}]+"
#: Family, keyword, name over words, versions (number words -> label), SPDX words, words of its web address.
FAMILIES = [
    ("apache", "apache", r"apache(?: software)? licen[cs]e", {"2 0": "apache-2.0", "1 1": "apache-1.1", "1 0": "apache-1.0"}, "apache", r"apache org licenses"),
    ("gpl", "general public", r"gnu general public licen[cs]e", {"3 0?": "gpl-3.0", "2 0?": "gpl-2.0", "1 0?": "gpl-1.0"}, "gpl", r"gnu org licenses gpl"),
    ("lgpl", "lesser general", r"gnu lesser general public licen[cs]e", {"3 0?": "lgpl-3.0", "2 1": "lgpl-2.1"}, "lgpl", r"gnu org licenses lgpl"),
    ("lgpl", "library general", r"gnu library general public licen[cs]e", {"2 0?": "lgpl-2.0"}, "lgpl", r"gnu org copyleft library"),
    ("agpl", "affero", r"(?:gnu )?affero general public licen[cs]e", {"3 0?": "agpl-3.0", "1 0?": "agpl-1.0"}, "agpl", r"gnu org licenses agpl"),
    ("gfdl", "free documentation", r"gnu free documentation licen[cs]e", {"1 3": "gfdl-1.3", "1 2": "gfdl-1.2", "1 1": "gfdl-1.1"}, "gfdl", r"gnu org licenses fdl"),
    ("mpl", "mozilla", r"mozilla public licen[cs]e", {"2 0": "mpl-2.0", "1 1": "mpl-1.1", "1 0": "mpl-1.0"}, "mpl", r"mozilla org mpl"),
    ("epl", "eclipse", r"eclipse public licen[cs]e", {"2 0": "epl-2.0", "1 0": "epl-1.0"}, "epl", r"eclipse org legal epl"),
    ("cddl", "common development", r"common development and distribution licen[cs]e", {"1 1": "cddl-1.1", "1 0": "cddl-1.0"}, "cddl", r"opensource org licenses cddl"),
    ("cpl", "common public", r"common public licen[cs]e", {"1 0": "cpl-1.0"}, "cpl", r"opensource org licenses cpl"),
    ("eupl", "european union", r"european union public licen[cs]e", {"1 2": "eupl-1.2", "1 1": "eupl-1.1"}, "eupl", r"joinup ec europa eu"),
    ("osl", "open software", r"open software licen[cs]e", {"3 0": "osl-3.0", "2 1": "osl-2.1", "2 0": "osl-2.0"}, "osl", r"opensource org licenses osl"),
    ("afl", "academic free", r"academic free licen[cs]e", {"3 0": "afl-3.0", "2 1": "afl-2.1"}, "afl", r"opensource org licenses afl"),
    ("artistic", "artistic", r"(?:perl )?artistic licen[cs]e", {"2 0": "artistic-2.0", "1 0": "artistic-1.0"}, "artistic", r"perlfoundation org artistic"),
    ("boost", "boost", r"boost software licen[cs]e", {"1 0": "bsl-1.0"}, "bsl", r"boost org license"),
    ("ms-pl", "microsoft public", r"microsoft public licen[cs]e", {"1 0": "ms-pl-1.0"}, "ms pl", r"opensource org licenses ms pl"),
    ("ms-rl", "microsoft reciprocal", r"microsoft reciprocal licen[cs]e", {"1 0": "ms-rl-1.0"}, "ms rl", r"opensource org licenses ms rl"),
    ("python", "python software", r"python software foundation licen[cs]e", {"2 0?": "psf-2.0"}, "psf", r"python org psf license"),
    ("php", "php", r"php licen[cs]e", {"3 01": "php-3.01", "3 0": "php-3.0"}, "php", r"php net license"),
    ("zpl", "zope", r"zope public licen[cs]e", {"2 1": "zpl-2.1", "2 0": "zpl-2.0"}, "zpl", r"zope org zpl"),
    ("odbl", "open database", r"open (?:data commons open )?database licen[cs]e", {"1 0": "odbl-1.0"}, "odbl", r"opendatacommons org licenses odbl"),
    ("odc-by", "open data commons", r"open data commons attribution licen[cs]e", {"1 0": "odc-by-1.0"}, "odc by", r"opendatacommons org licenses by"),
    ("pddl", "public domain dedication", r"public domain dedication and licen[cs]e", {"1 0": "pddl-1.0"}, "pddl", r"opendatacommons org licenses pddl"),
    ("ofl", "open font", r"sil open font licen[cs]e", {"1 1": "ofl-1.1", "1 0": "ofl-1.0"}, "ofl", r"scripts sil org ofl"),
    ("cecill", "cecill", r"cecill(?: free software)? licen[cs]e", {"2 1": "cecill-2.1", "2 0?": "cecill-2.0"}, "cecill", r"cecill info licences"),
    ("cc-by-nc-nd", "creative commons", r"creative commons (?:by|attribution) (?:nc|noncommercial|non commercial) (?:nd|noderivatives|no derivatives|noderivs)", {"4 0": "cc-by-nc-nd-4.0", "3 0": "cc-by-nc-nd-3.0"}, "cc by nc nd", r"creativecommons org licenses by nc nd"),
    ("cc-by-nc-nd", " cc ", r"cc (?:by|attribution) (?:nc|noncommercial|non commercial) (?:nd|noderivatives|no derivatives|noderivs)", {"4 0": "cc-by-nc-nd-4.0", "3 0": "cc-by-nc-nd-3.0"}, "cc by nc nd", r"creativecommons org licenses by nc nd"),
    ("cc-by-nc-sa", "creative commons", r"creative commons (?:by|attribution) (?:nc|noncommercial|non commercial) (?:sa|sharealike|share alike)", {"4 0": "cc-by-nc-sa-4.0", "3 0": "cc-by-nc-sa-3.0"}, "cc by nc sa", r"creativecommons org licenses by nc sa"),
    ("cc-by-nc-sa", " cc ", r"cc (?:by|attribution) (?:nc|noncommercial|non commercial) (?:sa|sharealike|share alike)", {"4 0": "cc-by-nc-sa-4.0", "3 0": "cc-by-nc-sa-3.0"}, "cc by nc sa", r"creativecommons org licenses by nc sa"),
    ("cc-by-nc", "creative commons", r"creative commons (?:by|attribution) (?:nc|noncommercial|non commercial)", {"4 0": "cc-by-nc-4.0", "3 0": "cc-by-nc-3.0"}, "cc by nc", r"creativecommons org licenses by nc"),
    ("cc-by-nc", " cc ", r"cc (?:by|attribution) (?:nc|noncommercial|non commercial)", {"4 0": "cc-by-nc-4.0", "3 0": "cc-by-nc-3.0"}, "cc by nc", r"creativecommons org licenses by nc"),
    ("cc-by-sa", "cc by sa", r"cc by sa", {"4 0": "cc-by-sa-4.0", "3 0": "cc-by-sa-3.0", "2 0": "cc-by-sa-2.0"}, "cc by sa", r"creativecommons org licenses by sa"),
    ("cc-by-sa", "creative commons", r"creative commons attribution (?:sharealike|share alike)", {"4 0": "cc-by-sa-4.0", "3 0": "cc-by-sa-3.0"}, "cc by sa", r"creativecommons org licenses by sa"),
    ("cc-by-nd", "creative commons", r"creative commons attribution (?:noderivatives|no derivatives|noderivs)", {"4 0": "cc-by-nd-4.0", "3 0": "cc-by-nd-3.0"}, "cc by nd", r"creativecommons org licenses by nd"),
    ("cc-by", "creative commons", r"creative commons attribution", {"4 0": "cc-by-4.0", "3 0": "cc-by-3.0", "2 0": "cc-by-2.0"}, "cc by", r"creativecommons org licenses by"),
    ("cc-by", "cc by", r"cc by", {"4 0": "cc-by-4.0", "3 0": "cc-by-3.0", "2 0": "cc-by-2.0"}, "cc by", r"creativecommons org licenses by"),
    ("cc0", "cc0", r"cc0", {"1 0": "cc0-1.0"}, "cc0", r"creativecommons org publicdomain zero"),
    ("mit", "mit", r"mit licen[cs]e", {}, "mit", r"opensource org licenses mit"),
    ("x11", "x11", r"x11 licen[cs]e", {}, "x11", r"x org license"),
    ("isc", "isc", r"isc licen[cs]e", {}, "isc", r"opensource org licenses isc"),
    ("zlib", "zlib", r"zlib(?: libpng)? licen[cs]e", {}, "zlib", r"zlib net zlib license"),
    ("bsd-3-clause", "bsd", r"(?:bsd 3 clause|3 clause bsd|new bsd|revised bsd|modified bsd) licen[cs]e", {}, "bsd 3 clause", r"opensource org licenses bsd 3 clause"),
    ("bsd-2-clause", "bsd", r"(?:bsd 2 clause|2 clause bsd|simplified bsd|freebsd) licen[cs]e", {}, "bsd 2 clause", r"opensource org licenses bsd 2 clause"),
    ("bsd-4-clause", "bsd", r"(?:bsd 4 clause|4 clause bsd|original bsd) licen[cs]e", {}, "bsd 4 clause", r"opensource org licenses bsd 4 clause"),
    ("bsd-0-clause", "bsd", r"(?:zero clause bsd|bsd zero clause) licen[cs]e", {}, "0bsd", r"opensource org licenses 0bsd"),
    ("bsd", "bsd", r"bsd(?: style)? licen[cs]e", {}, "bsd", r"opensource org licenses bsd"),
    ("unlicense", "unlicense", r"the unlicense", {}, "unlicense", r"unlicense org"),
    ("wtfpl", "you want to public", r"do what the [a-z]+ you want to public licen[cs]e", {"2 0?": "wtfpl-2"}, "wtfpl", r"wtfpl net"),
    ("beerware", "beer", r"(?:beer ?ware|beer ware) licen[cs]e", {}, "beerware", r"people freebsd org phk"),
    ("ncsa", "illinois", r"university of illinois(?: ncsa)? open source licen[cs]e", {}, "ncsa", r"opensource org licenses ncsa"),
    ("postgresql", "postgresql", r"postgresql licen[cs]e", {}, "postgresql", r"postgresql org about licence"),
    ("openssl", "openssl", r"openssl licen[cs]e", {}, "openssl", r"openssl org source license"),
    ("ruby", "ruby", r"ruby licen[cs]e", {}, "ruby", r"ruby lang org license"),
    ("vim", "vim", r"vim licen[cs]e", {}, "vim", r"vimdoc sourceforge net license"),
    ("ijg", "jpeg", r"independent jpeg group licen[cs]e", {}, "ijg", r"ijg org"),
    ("curl", "curl", r"curl licen[cs]e", {}, "curl", r"curl se docs copyright"),
    ("hpnd", "historical permission", r"historical permission notice and disclaimer", {}, "hpnd", r"opensource org licenses hpnd"),
    ("bsl", "business source", r"business source licen[cs]e", {"1 1": "busl-1.1"}, "busl", r"mariadb com bsl"),
    ("sspl", "server side", r"server side public licen[cs]e", {"1 0?": "sspl-1.0"}, "sspl", r"mongodb com licensing server side public license"),
    ("elastic", "elastic", r"elastic licen[cs]e", {"2 0": "elastic-2.0"}, "elastic", r"elastic co licensing elastic license"),
]
#: Whole sentences. Label, keyword, pattern.
SENTENCES = [
    ("mit", "permission is hereby granted", r"permission is hereby granted free of charge to any person obtaining a copy of this software"),
    ("isc", "permission to use copy modify", r"permission to use copy modify and or distribute this software for any purpose with or without fee"),
    ("bsd", "redistribution and use in source", r"redistribution and use in source and binary forms with or without modification are permitted"),
    ("gpl", "free software you can redistribute", r"free software you can redistribute it and or modify it under the terms of the gnu general public licen[cs]e"),
    ("unlicense", "free and unencumbered", r"free and unencumbered software released into the public domain"),
    ("zlib", "express or implied warranty", r"provided as is without any express or implied warranty in no event will the authors be held liable"),
    ("public-domain", "public domain", r"(?:dedicated|released|placed) (?:to|into|in) the public domain"),
    ("all-rights-reserved", "all rights reserved", r"all rights reserved"),
    ("proprietary", "proprietary", r"(?:proprietary and confidential|confidential and proprietary)"),
]
_GRANT = r"(?:licensed|released|distributed|available|published|provided|covered|used) (?:to you )?under (?:the )?(?:terms (?:and conditions )?of (?:the )?)?"
_VERSION = r" (?:version |v)?"
#: How sure a detection is, by priority: name, name with version, grant, address, sentence, SPDX tag.
SURE = [0.5, 0.7, 0.8, 0.85, 0.9, 0.95]


def rules() -> list[tuple[str, int, str, str]]:
    """Label, priority, keyword, pattern of every rule: six forms of every family, one of every sentence. A match holds its keyword."""
    out = []
    for family, key, name, versions, spdx, site in FAMILIES:
        out += [(family, 0, key, name), (family, 2, key, _GRANT + name), (family, 5, "spdx", f"spdx license identifier {spdx}"), (family, 3, site.split(" ")[0], site)]
        for number, label in versions.items():
            number = number.replace(" 0?", "(?: 0)?")
            out += [(label, 1, key, name + _VERSION + number), (label, 2, key, _GRANT + name + _VERSION + number)]
            out += [(label, 5, "spdx", f"spdx license identifier {spdx} {number}"), (label, 3, site.split(" ")[0], f"{site}(?: [a-z]+)? {number}")]
    out += [(label, 4, key, pattern) for label, key, pattern in SENTENCES]
    return sorted(set(out), key=lambda r: (r[2], -r[1], r[0], r[3]))


def _gate() -> str:
    """A pattern of raw texts that finds a literal of every rule and base phrase: licen[cs] where it has to stand in a match, else an address or a keyword."""
    asked = [(key, name) for _, key, name, *_ in FAMILIES] + [(x[5], x[5]) for x in FAMILIES] + [(key, pattern) for _, key, pattern in SENTENCES] + [(p, p) for p, _ in BASE]
    other = {key.strip() for key, pattern in asked if not re.search("licen(?:s|c|\\[cs\\])", re.sub(r"\(\?:[^()]*\)", "", pattern))}
    return r"(?i)licen[cs]|(?<![0-9a-z])(?:" + "|".join(sorted(other)).replace(" ", r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+") + ")"


#: What stands in every text with a match or a base phrase; SPDX tags hold "license" too.
GATE = _gate()


def words_text(text: Column) -> Column:
    """The words of a text in lower case, a space before, between and after them."""
    return F.concat(F.lit(" "), F.trim(F.regexp_replace(F.translate(text, UPPER, LOWER), GAP, " ")), F.lit(" "))


def _keyed(rule_list) -> list[tuple[str, list]]:
    by: dict[str, list] = {}
    for label, priority, key, pattern in rule_list:
        by.setdefault(key, []).append((label, priority, rf"(?<= ){pattern}(?= )"))
    return list(by.items())


def detections(words: Column, rule_list=None) -> Column:
    """Array of (start, -stop, -priority, label) of all rules' matches in a words_text, in that order."""

    def lit_rules(group):
        return F.array(*[F.struct(F.lit(x).alias("label"), F.lit(p).alias("priority"), F.lit(r).alias("pattern")) for x, p, r in group])

    groups = F.array(*[F.struct(F.lit(key).alias("key"), lit_rules(group).alias("rules")) for key, group in _keyed(rule_list or rules())])
    asked = F.flatten(F.transform(F.filter(groups, lambda g: F.contains(words, g["key"])), lambda g: g["rules"]))

    def places(rule):
        lens = F.transform(F.regexp_extract_all(words, rule["pattern"], F.lit(0)), lambda h: F.length(h))
        gaps = F.transform(F.split(words, rule["pattern"], -1), lambda p: F.length(p))
        start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,stop:int>>").alias("found"))
        step = lambda acc, x: F.struct(
            (acc["at"] + x["gaps"] + x["lens"]).alias("at"),
            F.concat(acc["found"], F.array(F.struct((acc["at"] + x["gaps"]).alias("start"), (acc["at"] + x["gaps"] + x["lens"]).alias("stop")))).alias("found"),
        )
        pairs = F.arrays_zip(F.slice(gaps, F.lit(1), F.size(lens)).alias("gaps"), lens.alias("lens"))
        found = F.aggregate(pairs, start, step, lambda acc: acc["found"])
        return F.transform(found, lambda i: F.struct(i["start"].alias("start"), (-i["stop"]).alias("below"), (-rule["priority"]).alias("rank"), rule["label"].alias("label")))

    return F.array_sort(F.flatten(F.transform(asked, places)))


def resolve(found: Column) -> Column:
    """Labels and doubt (product of 1 - sureness) of the detections that no containing one of at least their priority hides."""
    n = len(SURE)
    start = F.struct(F.array(*[F.lit(-1)] * n).alias("tops"), F.array().cast("array<string>").alias("labels"), F.lit(1.0).alias("doubt"), F.lit(0).cast("long").alias("kept"))
    sure = F.array(*[F.lit(x) for x in SURE])

    def step(acc, d):
        stop, priority = -d["below"], -d["rank"]
        hidden = F.array_max(F.slice(acc["tops"], priority + 1, F.lit(n))) >= stop
        tops = F.transform(acc["tops"], lambda t, i: F.when(i == priority, F.greatest(t, stop)).otherwise(t))
        return F.struct(
            tops.alias("tops"),
            F.when(hidden, acc["labels"]).otherwise(F.array_union(acc["labels"], F.array(d["label"]))).alias("labels"),
            F.when(hidden, acc["doubt"]).otherwise(acc["doubt"] * (1 - F.element_at(sure, priority + 1))).alias("doubt"),
            (acc["kept"] + F.when(hidden, F.lit(0)).otherwise(F.lit(1))).cast("long").alias("kept"),
        )

    return F.aggregate(found, start, step, lambda acc: F.struct(acc["labels"].alias("labels"), acc["doubt"].alias("doubt"), acc["kept"].alias("kept")))


def scan(docs: DataFrame, rule_list=None) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, n_detections, one row for each row of docs."""
    text = F.coalesce(F.col("text"), F.lit(""))
    gated = F.col("lic_text").rlike(GATE)
    df = docs.select("doc_id", text.alias("lic_text"))
    df = df.select("doc_id", F.regexp_count("lic_text", F.lit(WORD)).cast("long").alias("n_words"), F.when(gated, words_text(F.col("lic_text"))).alias("w"))
    wide = F.replace(F.col("w"), F.lit(" "), F.lit("  "))
    own = [f" {p.replace(' ', '  ')} " for p, _ in BASE]
    count = [((F.length("wide") - F.length(F.replace(F.col("wide"), F.lit(p), F.lit("")))) / len(p)).cast("long") for p in own]
    spaces = lambda s: F.length(s) - F.length(F.replace(s, F.lit(" "), F.lit("")))
    # each word has a space of its own on both sides; the text has one more at either end
    before = lambda p: F.when(F.locate(p, F.col("wide")) > 0, F.expr("int(0)") + (spaces(F.substring(F.col("wide"), F.lit(1), F.locate(p, F.col("wide")) - 1)) - 1) / 2)
    back = lambda p: F.when(F.locate(p[::-1], F.col("ediw")) > 0, (spaces(F.substring(F.col("wide"), F.lit(1), F.length("wide") - F.locate(p[::-1], F.col("ediw")) + 1 - len(p))) - 1) / 2)
    df = df.withColumn("wide", wide).withColumn("ediw", F.reverse("wide"))
    base = F.filter(F.array(*[F.when(c > 0, F.lit(label)) for c, (_, label) in zip(count, BASE)]), lambda x: x.isNotNull())
    df = df.select(
        "doc_id", "n_words", "w",
        F.coalesce(sum(count[1:], count[0]), F.lit(0)).cast("long").alias("n_base"),
        F.least(*[before(p) for p in own]).cast("long").alias("first_word"),
        F.greatest(*[back(p) for p in own]).cast("long").alias("last_word"),
        F.when(F.col("w").isNotNull(), base).otherwise(F.array().cast("array<string>")).alias("base"),
    )
    df = df.withColumn("r", F.when(F.col("w").isNotNull(), resolve(detections(F.col("w"), rule_list))))
    none = F.array().cast("array<string>")
    labels = F.array_sort(F.array_union("base", F.coalesce(F.col("r.labels"), none)))
    doubt = F.coalesce(F.col("r.doubt"), F.lit(1.0)) * F.pow(F.lit(0.5), F.least(F.size("base"), F.lit(4)))
    return df.select(
        "doc_id", "n_words", "n_base", "first_word", "last_word", F.array_join(F.array_sort("base"), ",").alias("base_labels"),
        F.array_join(labels, ",").alias("labels"), F.round(1 - doubt, 6).alias("score"), F.coalesce(F.col("r.kept"), F.lit(0)).cast("long").alias("n_detections"),
    )
