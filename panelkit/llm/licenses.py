"""License scan by ordered signature rules, in DataFrame functions only.

A keyword test gates the texts; each rule (forms of licence names and ids, and
words of licence texts and notices) is gated by its own keyword before its
expression runs.  Where detections overlap, those inside
another go, and of two that cross, the one of better priority stays."""

from __future__ import annotations

import json
from dataclasses import dataclass
from functools import cache, reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import id_and_text, lower_ascii

# Base phrases, words apart, and their labels.
BASE = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}

# Licence families. SPDX-like id: (names as they are written, in
# lower case with single spaces; the first is the full name).
FAMILIES = {
    "agpl": ("gnu affero general public license", "affero gpl", "agpl"),
    "lgpl": ("gnu lesser general public license", "gnu library general public license", "lgpl"),
    "gpl": ("gnu general public license", "gnu gpl", "gpl"),
    "gfdl": ("gnu free documentation license", "gfdl"),
    "apache": ("apache license", "apache software license", "asl-2.0"),
    "mit": ("mit license", "expat license", "x11 license"),
    "bsd": ("bsd license", "berkeley software distribution license", "modified bsd license"),
    "isc": ("isc license", "internet systems consortium license"),
    "mpl": ("mozilla public license", "mpl-2.0"),
    "epl": ("eclipse public license", "epl-2.0"),
    "cddl": ("common development and distribution license", "cddl"),
    "cpl": ("common public license", "ibm public license"),
    "artistic": ("artistic license", "perl artistic license"),
    "zlib": ("zlib license", "zlib/libpng license"),
    "boost": ("boost software license", "bsl-1.0"),
    "python": ("python software foundation license", "psf license"),
    "php": ("php license",),
    "ruby": ("ruby license",),
    "openssl": ("openssl license", "ssleay license"),
    "unlicense": ("the unlicense", "unlicense license"),
    "wtfpl": ("do what the fuck you want to public license", "wtfpl"),
    "eupl": ("european union public licence", "european union public license", "eupl"),
    "osl": ("open software license",),
    "afl": ("academic free license",),
    "ms-pl": ("microsoft public license", "ms-pl"),
    "ms-rl": ("microsoft reciprocal license", "ms-rl"),
    "ofl": ("sil open font license", "open font license"),
    "cc0": ("cc0", "creative commons zero"),
    "cc-by-nc-nd": ("cc by-nc-nd", "creative commons attribution-noncommercial-noderivatives"),
    "cc-by-nc-sa": ("cc by-nc-sa", "creative commons attribution-noncommercial-sharealike"),
    "cc-by-nc": ("cc by-nc", "creative commons attribution-noncommercial"),
    "cc-by-nd": ("cc by-nd", "creative commons attribution-noderivatives"),
    "cc-by-sa": ("cc by-sa", "creative commons attribution-sharealike"),
    "cc-by": ("cc by", "creative commons attribution"),
    "odbl": ("open database license", "odbl"),
    "pddl": ("public domain dedication and license", "pddl"),
    "elastic": ("elastic license",),
    "sspl": ("server side public license", "sspl"),
    "busl": ("business source license",),
    "commons-clause": ("commons clause",),
    "llama": ("llama community license", "llama 2 community license", "llama 3 community license"),
    "rail": ("openrail license", "responsible ai license", "bigscience rail license"),
    "proprietary": ("all rights reserved", "proprietary license"),
    "public-domain": ("public domain",),
}

# SPDX ids that no family label with a version gives.
SPDX_IDS = {
    "mit": ("mit-0", "mit-modern-variant", "x11"), "python": ("psf-2.0",), "boost": ("bsl-1.0",), "0bsd": ("0bsd",),
    "bsd": ("bsd-3-clause-clear", "bsd-2-clause-patent", "bsd-4-clause-uc"), "zlib": ("libpng", "libpng-2.0", "zlib-acknowledgement"),
    "cpl": ("ipl-1.0",), "artistic": ("artistic-1.0-perl", "clartistic"), "mpl": ("mpl-2.0-no-copyleft-exception",),
    "gpl": ("gpl-2.0-with-classpath-exception",), "gfdl": ("gfdl-1.3-invariants-only", "gfdl-1.3-no-invariants-only"),
    "ofl": ("ofl-1.1-rfn", "ofl-1.1-no-rfn"), "public-domain": ("cc-pddc",), "ncsa": ("ncsa",), "postgresql": ("postgresql",),
    "hpnd": ("hpnd",), "unicode": ("unicode-3.0", "unicode-dfs-2016"), "json": ("json",),
}

# Words of licence texts and notices that need not name the licence.
# label: (words, weight); what stands between two words does not matter.
SIGNATURES = {
    "mit": (
        ("permission is hereby granted free of charge", 0.7),
        ("permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files"
         " the software to deal in the software without restriction", 0.95),
        ("the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software", 0.9),
    ),
    "ncsa": (("permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files"
              " the software to deal with the software without restriction", 0.95),),
    "unicode": (("permission is hereby granted free of charge to any person obtaining a copy of the unicode data files", 0.95),
                ("permission is hereby granted free of charge to any person obtaining a copy of data files and any associated documentation", 0.95)),
    "json": (("the software shall be used for good not evil", 0.95),),
    "boost": (
        ("permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying"
         " documentation covered by this license", 0.95),
        ("the copyright notices in the software and this entire statement including the above license grant this restriction and the"
         " following disclaimer must be included in all copies of the software", 0.95),
    ),
    "ofl": (("permission is hereby granted free of charge to any person obtaining a copy of the font software", 0.95),
            ("the font software may be sold as part of a larger software package but no copy of one or more of the font software", 0.8),
            ("this font software is licensed under the sil open font license", 0.95)),
    "bsd": (
        ("redistribution and use in source and binary forms", 0.7),
        ("redistribution and use in source and binary forms with or without modification are permitted provided that the following"
         " conditions are met", 0.95),
        ("redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer", 0.9),
        ("redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer", 0.9),
        ("contributors may be used to endorse or promote products derived from this software without specific prior written permission", 0.85),
    ),
    "php": (("redistribution and use in source and binary forms with or without modification is permitted provided that the following"
             " conditions are met", 0.95),),
    "isc": (
        ("permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", 0.7),
        ("permission to use copy modify and distribute this software for any purpose with or without fee is hereby granted", 0.7),
        ("permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that"
         " the above copyright notice and this permission notice appear in all copies", 0.95),
        ("permission to use copy modify and distribute this software for any purpose with or without fee is hereby granted provided that"
         " the above copyright notice and this permission notice appear in all copies", 0.95),
    ),
    "0bsd": (("permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"
              " the software is provided as is", 0.95),),
    "hpnd": (("permission to use copy modify and distribute this software and its documentation for any purpose and without fee is hereby"
              " granted", 0.9),),
    "postgresql": (("permission to use copy modify and distribute this software and its documentation for any purpose without fee and"
                    " without a written agreement is hereby granted", 0.95),),
    "zlib": (
        ("this software is provided as is without any express or implied warranty in no event will the authors be held liable for any"
         " damages arising from the use of this software", 0.9),
        ("permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and"
         " redistribute it freely", 0.95),
        ("the origin of this software must not be misrepresented you must not claim that you wrote the original software", 0.95),
        ("altered source versions must be plainly marked as such and must not be misrepresented as being the original software", 0.95),
    ),
    "apache": (
        ("you may not use this file except in compliance with the license", 0.85),
        ("unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis", 0.9),
        ("subject to the terms and conditions of this license each contributor hereby grants to you a perpetual worldwide non exclusive"
         " no charge royalty free irrevocable copyright license", 0.9),
        ("this product includes software developed by the apache software foundation", 0.8),
        ("this product includes software developed at the apache software foundation", 0.8),
    ),
    "openssl": (("this product includes software developed by the openssl project", 0.9),
                ("this product includes cryptographic software written by eric young", 0.9)),
    "gpl": (
        ("this program is free software you can redistribute it and or modify it under the terms of the gnu general public license", 0.95),
        ("you should have received a copy of the gnu general public license along with", 0.9),
        ("the licenses for most software are designed to take away your freedom to share and change it", 0.85),
        ("the gnu general public license is a free copyleft license for software and other kinds of works", 0.95),
    ),
    "lgpl": (
        ("this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license", 0.95),
        ("you should have received a copy of the gnu lesser general public license along with", 0.9),
        ("incorporates the terms and conditions of version 3 of the gnu general public license supplemented by the additional permissions"
         " listed below", 0.95),
    ),
    "agpl": (
        ("this program is free software you can redistribute it and or modify it under the terms of the gnu affero general public license", 0.95),
        ("your modified version must prominently offer all users interacting with it remotely through a computer network", 0.9),
    ),
    "gfdl": (("permission is granted to copy distribute and or modify this document under the terms of the gnu free documentation license", 0.95),
             ("with no invariant sections no front cover texts and no back cover texts", 0.85)),
    "mpl": (
        ("this source code form is subject to the terms of the mozilla public license", 0.95),
        ("if a copy of the mpl was not distributed with this file you can obtain one at", 0.9),
        ("the contents of this file are subject to the mozilla public license", 0.95),
    ),
    "epl": (
        ("the accompanying program is provided under the terms of this eclipse public license", 0.95),
        ("this program and the accompanying materials are made available under the terms of the eclipse public license", 0.95),
    ),
    "cpl": (("the accompanying program is provided under the terms of this common public license", 0.95),),
    "cddl": (("the contents of this file are subject to the terms of the common development and distribution license", 0.95),),
    "artistic": (
        ("the intent of this document is to state the conditions under which a package may be copied", 0.95),
        ("this license establishes the terms under which a given free software package may be copied modified distributed and or"
         " redistributed", 0.95),
    ),
    "ruby": (("you may make and give away verbatim copies of the source form of the software without restriction", 0.8),),
    "python": (("this license agreement is between the python software foundation", 0.95),),
    "unlicense": (
        ("this is free and unencumbered software released into the public domain", 0.95),
        ("anyone is free to copy modify publish use compile sell or distribute this software either in source code form or as a compiled"
         " binary", 0.95),
    ),
    "wtfpl": (("you just do what the fuck you want to", 0.9),),
    "ms-pl": (("this license governs use of the accompanying software if you use the software you accept this license", 0.8),),
    "ms-rl": (("for any file you distribute that contains code from the software in source code or binary format you must provide"
               " recipients the source code to that file", 0.95),),
    "cc0": (("has dedicated the work to the public domain by waiving all of his or her rights to the work worldwide under copyright law", 0.95),
            ("affirmer hereby overtly fully permanently irrevocably and unconditionally waives abandons and surrenders all of affirmer s"
             " copyright and related rights", 0.95)),
    "elastic": (("you may not provide the software to third parties as a hosted or managed service", 0.9),),
    "sspl": (("if you make the functionality of the program or a modified version available to third parties as a service", 0.9),),
    "busl": (("the licensor hereby grants you the right to copy modify create derivative works redistribute and make non production use of"
              " the licensed work", 0.95),),
    "commons-clause": (("the grant of rights under the license will not include and the license does not grant to you the right to sell the"
                        " software", 0.95),),
    "eupl": (("you may not use this work except in compliance with the licence", 0.85),),
}
#: Each signature holds one of these, or a keyword of a name.
SIGNATURE_GATE = frozenset("software permission redistribution contributors prominently invariant distributed package fuck affirmer "
                           "functionality".split())

# Forms of a mention. (expression around the name {n} or the id
# {i}, priority, smaller is better, weight of the evidence)
NAME_FORMS = (
    (r"\b(?:released|licensed|distributed|available|published) under (?:the |a )?(?:terms of (?:the )?)?{n}", 10, 0.95),
    (r"\b(?:subject to|governed by) (?:the )?(?:terms of (?:the )?)?{n}", 20, 0.9),
    (r"\b(?:see|read|copy of) (?:the )?{n}", 30, 0.8),
    (r"\b{n}(?:,? ?\(?v(?:ersion)?\.? ?[0-9]{1,9}(?:\.[0-9]{1,9})?\)?)", 40, 0.85),
    (r"\b{n}", 50, 0.6),
)
ID_FORMS = (
    (r"spdx-license-identifier: ?{i}(?:-[0-9.]{1,19})?(?:-only|-or-later|-clause)?", 5, 1.0),
    (r"\blicense ?[:=] ?[\"']?{i}(?:[- ][0-9.]{1,19})?", 8, 0.9),
)
#: Between two words of a signature: line ends, comment marks, quotes.
GAP = "[^a-z0-9]{1,16}"
#: No rule matches more characters: its blanks and digits are bounded below.
LONGEST = 4096
VERSION_TAIL = r"(?:,? ?\(?v(?:ersion)?\.? ?[0-9]{1,9}(?:\.[0-9]{1,9})?\)?| [0-9]\.[0-9])?"


@dataclass(frozen=True)
class Rule:
    keyword: str  # lower-case text without which the expression cannot match
    regex: str
    label: str
    priority: int
    weight: float


#: Words too general to gate a rule, unless a name has no other.
GENERAL = frozenset("a the you to do what want and license licence public software general open free source".split())


def _escape(name: str) -> str:
    """The name with up to eight blanks or line ends between its words."""
    return "".join(r"[ \t\r\n]{1,8}" if c == " " else c if c.isalnum() else "\\" + c for c in name)


def _keyword(name: str) -> str:
    words = name.split(" ")
    return max([w for w in words if w not in GENERAL] or words, key=len)


@cache
def rules() -> tuple[Rule, ...]:
    """All rules, best priority first: forms of names and ids, and signatures."""
    out = []
    for label, names in FAMILIES.items():
        for name in names:
            for form, priority, weight in NAME_FORMS:
                tail = "" if "ersion" in form else VERSION_TAIL
                regex = form.replace("{n}", _escape(name)) + tail + r"(?![a-z0-9-])"
                out.append(Rule(_keyword(name), regex, label, priority, weight))
        for form, priority, weight in ID_FORMS:
            regex = form.replace("{i}", _escape(label)) + r"(?![a-z0-9-])"
            out.append(Rule(label.split("-")[0], regex, label, priority, weight))
    for label, ids in SPDX_IDS.items():
        for name in ids:
            for form, priority, weight in ID_FORMS:
                start = form.partition("{i}")[0]
                out.append(Rule(name, start + _escape(name) + r"(?:-only|-or-later)?(?![a-z0-9-])", label, priority, weight))
    for label, signatures in SIGNATURES.items():
        for words, weight in signatures:
            regex = r"\b" + GAP.join(words.split(" ")) + "(?![a-z0-9])"
            out.append(Rule(max(words.split(" "), key=len), regex, label, 7 if weight > 0.7 else 45, weight))
    return tuple(sorted(out, key=lambda r: (r.priority, r.label, r.regex)))


#: What stands between words, and words, in the raw text.
BREAK = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]"
WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def _gate(text: Column) -> Column:
    """True if any base phrase or rule may match: they all hold one of a few
    keywords (``lower`` only adds texts, it loses none)."""
    low = F.lower(text)
    names = [n for names in FAMILIES.values() for n in names]
    keywords = {"licen"} | {_keyword(n) for n in names if "licen" not in n}
    keywords |= SIGNATURE_GATE
    plain = reduce(or_, [F.contains(low, F.lit(k)) for k in sorted(keywords - {"cc"})])
    return plain | (F.contains(low, F.lit("cc")) & text.rlike(f"(?i)cc{BREAK}+by"))


def _base_places(words: Column) -> Column:
    """Struct of count, smallest and largest first word, and labels of the base
    phrases, from the array of words."""
    phrases = "|".join(BASE)
    line = F.concat(F.lit(" "), F.array_join(words, " "), F.lit(" "))
    # each part but the first begins with a phrase; the first may
    parts = F.split(line, f"(?= (?:{phrases}) )", -1)
    spaces = lambda s: F.length(s) - F.length(F.replace(s, F.lit(" "), F.lit("")))
    start = F.struct(F.lit(0).cast("long").alias("at"), F.lit(0).cast("long").alias("n"),
                     F.lit(None).cast("long").alias("first"), F.lit(None).cast("long").alias("last"),
                     F.array().cast("array<string>").alias("labels"))

    def step(acc: Column, part: Column) -> Column:
        phrase = F.regexp_extract(part, f"^ ({phrases})(?: |$)", 1)
        hit = phrase != ""
        label = F.element_at(F.create_map(*[F.lit(x) for kv in BASE.items() for x in kv]), phrase)
        return F.struct(
            (acc["at"] + spaces(part)).alias("at"), (acc["n"] + hit.cast("long")).alias("n"),
            F.when(hit, F.coalesce(acc["first"], acc["at"])).otherwise(acc["first"]).alias("first"),
            F.when(hit, acc["at"]).otherwise(acc["last"]).alias("last"),
            F.when(hit, F.array_union(acc["labels"], F.array(label))).otherwise(acc["labels"]).alias("labels"))

    return F.aggregate(parts, start, step)


def _detections(low: Column) -> Column:
    """All detections of all rules: (start, end, priority, label, weight)."""
    # one literal, folded when the plan is made
    table = F.from_json(F.lit(json.dumps([
        {"keyword": r.keyword, "ahead": f"(?={r.regex})", "regex": f"^(?:{r.regex})", "label": r.label,
         "priority": r.priority, "weight": r.weight} for r in rules()])),
        "array<struct<keyword:string,ahead:string,regex:string,label:string,priority:int,weight:double>>")
    live = F.filter(table, lambda r: F.contains(low, r["keyword"]) & F.regexp_like(low, r["ahead"]))

    def places(r: Column) -> Column:
        parts = F.split(low, r["ahead"], -1)
        empty = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<s:int,e:int>>").alias("found"))

        def step(acc: Column, part: Column) -> Column:
            # a match may run on past the next one's start, so it is read from the text
            size = F.length(F.regexp_substr(F.substring(low, acc["at"] + 1, F.lit(LONGEST)), r["regex"]))
            span = F.array(F.struct(acc["at"].alias("s"), (acc["at"] + size).alias("e")))
            return F.struct((acc["at"] + F.length(part)).alias("at"),
                            F.when(size.isNotNull(), F.concat(acc["found"], span)).otherwise(acc["found"]).alias("found"))

        found = F.aggregate(parts, empty, step)["found"]
        return F.transform(found, lambda x: F.struct(
            x["s"].alias("s"), (-x["e"]).alias("neg_e"), r["priority"].alias("priority"), r["label"].alias("label"),
            r["weight"].alias("weight")))

    return F.flatten(F.transform(live, places))


def _resolved(found: Column) -> Column:
    """Containment and priority: in order of start, a detection inside one that
    is kept goes; of two that cross, the better priority stays. One pass."""
    kept = F.array().cast("array<struct<s:int,neg_e:int,priority:int,label:string,weight:double>>")

    def step(acc: Column, x: Column) -> Column:
        last = F.element_at(acc, -1)
        apart = (F.size(acc) == 0) | (x["s"] >= -last["neg_e"])
        inside = -x["neg_e"] <= -last["neg_e"]
        return (F.when(apart, F.concat(acc, F.array(x)))
                .when(inside | (x["priority"] >= last["priority"]), acc)
                .otherwise(F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(x))))

    # sorted by start, then the longest first, then priority
    return F.aggregate(F.array_sort(found), kept, step)


def scan_licenses(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: the id, ``n_words``, ``n_base`` (places of base
    phrases), ``first_word`` and ``last_word`` (their smallest and largest
    start, words from 0), ``base_labels``, ``labels`` (base and rule labels,
    distinct, sorted, comma-joined), ``score`` (largest weight of the evidence,
    0 without any) and ``detections`` (kept ones: start, end, label, weight in
    characters of the text).

    A null or empty text has no words, empty labels, null places and score 0.
    Null ids and repeated rows pass as they are; an empty table gives an empty
    result; other columns are ignored. There is no join and no shuffle."""
    base = id_and_text(df, id_col, text_col)
    gated = base.select("id", "text", F.when(_gate(F.col("text")), F.col("text")).alias("hot"))
    words = F.transform(F.regexp_extract_all("hot", F.lit(WORD), F.lit(0)), lower_ascii)
    found = gated.select(
        "id", F.regexp_count("text", F.lit(WORD)).cast("long").alias("n_words"),
        F.when(F.col("hot").isNotNull(), _base_places(words)).alias("b"), "hot", lower_ascii(F.col("hot")).alias("low"))
    found = found.withColumn("d", F.when(F.col("hot").isNotNull(), _resolved(_detections(F.col("low")))))
    none = F.array().cast("array<string>")
    base_labels = F.coalesce(F.col("b.labels"), none)
    every = F.coalesce(F.array_union(base_labels, F.transform("d", lambda x: x["label"])), none)
    weight = F.coalesce(F.array_max(F.transform("d", lambda x: x["weight"])), F.lit(0.0))
    return found.select(
        F.col("id").alias(id_col), "n_words", F.coalesce(F.col("b.n"), F.lit(0).cast("long")).alias("n_base"),
        F.col("b.first").alias("first_word"), F.col("b.last").alias("last_word"),
        F.array_join(F.array_sort(base_labels), ",").alias("base_labels"),
        F.array_join(F.array_sort(every), ",").alias("labels"),
        F.greatest(weight, F.when(F.size(base_labels) > 0, F.lit(0.6)).otherwise(F.lit(0.0))).alias("score"),
        F.coalesce(F.transform("d", lambda x: F.struct(x["s"].alias("start"), (-x["neg_e"]).alias("end"),
                                                       x["label"].alias("label"), x["weight"].alias("weight"))),
                   F.array().cast("array<struct<start:int,end:int,label:string,weight:double>>")).alias("detections"))
