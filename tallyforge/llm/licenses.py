"""License scan: ordered signature rules over normalised words, in DataFrame functions alone.

Method. Each rule is a regular expression over the words of a text (lower-cased, one space between words), with a
label, a priority and a keyword that every match contains. Every rule also belongs to a class of rules with one trigger
(``TRIGGERS``): words that every match of the class holds. A text that holds a plain piece of no trigger is let go; any
other is normalised once, its classes are found, and it meets only the rules of those classes whose keyword it holds.
Neither step can lose a match: triggers and keywords are parts of the patterns themselves, and a test draws matches of
every rule to see that they pass. Matches become intervals. A span falls where a span of higher priority overlaps it, or
one of its own priority contains it; what is left gives the labels. Rules marked base are exact phrases that nothing
suppresses.

Everything happens inside one row: no shuffle, no join, no Python. A hot source or a copied document costs no more
than its own rows.

Defined cases. Null and empty texts have no word and no label; score 0. Equal rows give equal rows. Very long texts are
scanned whole, in one row. An empty table gives an empty table. Other columns of the input are ignored, whatever their names.
"""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: What stands between words (before and after lower-casing), and ASCII case.
SEPARATORS = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: The base phrases and their labels.
BASE = [("mit", "under the mit license"), ("apache-2", "apache license version 2"), ("cc-by-nc", "cc by nc")]

#: (label, name pattern, identifier words or None, address words or None). Patterns are over normalised words.
FAMILIES = [
    ("mit", r"mit", "mit", "opensource org licenses mit"),
    ("mit", r"expat", None, None),
    ("mit", r"x11", "x11", None),
    ("mit-0", r"mit no attribution", "mit 0", "opensource org licenses mit 0"),
    ("apache-1", r"apache(?: software)?(?: license)?(?: version)? 1(?: [01])?", "apache 1 1", "apache org licenses license 1 1"),
    ("apache-2", r"(?:the )?apache(?: software)?(?: licen[cs]e)?(?: version| v)? ?2(?: 0)?", "apache 2 0", "apache org licenses license 2 0"),
    ("bsd-1-clause", r"(?:1|one) clause bsd", "bsd 1 clause", None),
    ("bsd-2-clause", r"(?:(?:2|two) clause|simplified|freebsd) bsd", "bsd 2 clause", "opensource org licenses bsd 2 clause"),
    ("bsd-3-clause", r"(?:(?:3|three) clause|new|modified|revised) bsd", "bsd 3 clause", "opensource org licenses bsd 3 clause"),
    ("bsd-4-clause", r"(?:(?:4|four) clause|original) bsd", "bsd 4 clause", None),
    ("bsd", r"bsd(?: style)?", None, None),
    ("0bsd", r"zero clause bsd", "0bsd", None),
    ("0bsd", r"bsd zero clause", None, None),
    ("isc", r"isc", "isc", "opensource org licenses isc"),
    ("gpl-1", r"(?:gnu )?general public licen[cs]e(?: version| v)? ?1(?: 0)?", "gpl 1 0(?: only| or later)?", "gnu org licenses gpl 1 0"),
    ("gpl-1", r"(?:gnu )?gpl(?: version| v|v)? ?1(?: 0)?", None, None),
    ("gpl-2", r"(?:gnu )?general public licen[cs]e(?: version| v)? ?2(?: 0)?", "gpl 2 0(?: only| or later)?", "gnu org licenses (?:old licenses )?gpl 2 0"),
    ("gpl-2", r"(?:gnu )?gpl(?: version| v|v)? ?2(?: 0)?", None, None),
    ("gpl-3", r"(?:gnu )?general public licen[cs]e(?: version| v)? ?3(?: 0)?", "gpl 3 0(?: only| or later)?", "gnu org licenses gpl 3 0"),
    ("gpl-3", r"(?:gnu )?gpl(?: version| v|v)? ?3(?: 0)?", None, None),
    ("gpl", r"gnu general public", None, "gnu org licenses gpl html"),
    ("lgpl-2", r"(?:gnu )?library general public licen[cs]e(?: version| v)? ?2(?: 0)?", "lgpl 2 0(?: only| or later)?", "gnu org licenses (?:old licenses )?lgpl 2 0"),
    ("lgpl-2", r"(?:gnu )?lgpl(?: version| v|v)? ?2(?: 0)?", None, None),
    ("lgpl-2.1", r"(?:gnu )?lesser general public licen[cs]e(?: version| v)? ?2 1", "lgpl 2 1(?: only| or later)?", "gnu org licenses (?:old licenses )?lgpl 2 1"),
    ("lgpl-2.1", r"(?:gnu )?lgpl(?: version| v|v)? ?2 1", None, None),
    ("lgpl-3", r"(?:gnu )?lesser general public licen[cs]e(?: version| v)? ?3(?: 0)?", "lgpl 3 0(?: only| or later)?", "gnu org licenses lgpl 3 0"),
    ("lgpl-3", r"(?:gnu )?lgpl(?: version| v|v)? ?3(?: 0)?", None, None),
    ("lgpl", r"gnu lesser general public", None, "gnu org licenses lgpl html"),
    ("agpl-3", r"(?:gnu )?affero general public licen[cs]e(?: version| v)? ?3(?: 0)?", "agpl 3 0(?: only| or later)?", "gnu org licenses agpl 3 0"),
    ("agpl-3", r"(?:gnu )?agpl(?: version| v|v)? ?3(?: 0)?", None, None),
    ("agpl", r"gnu affero general public", None, "gnu org licenses agpl html"),
    ("gfdl-1.1", r"(?:gnu )?free documentation licen[cs]e(?: version| v)? ?1 1", "gfdl 1 1(?: only| or later)?", None),
    ("gfdl-1.2", r"(?:gnu )?free documentation licen[cs]e(?: version| v)? ?1 2", "gfdl 1 2(?: only| or later)?", "gnu org licenses (?:old licenses )?fdl 1 2"),
    ("gfdl-1.3", r"(?:gnu )?free documentation licen[cs]e(?: version| v)? ?1 3", "gfdl 1 3(?: only| or later)?", "gnu org licenses fdl 1 3"),
    ("gfdl", r"gnu free documentation", None, "gnu org licenses fdl html"),
    ("mpl-1.0", r"mozilla public licen[cs]e(?: version| v)? ?1 0", "mpl 1 0", None),
    ("mpl-1.1", r"mozilla public licen[cs]e(?: version| v)? ?1 1", "mpl 1 1", "mozilla org mpl 1 1 license"),
    ("mpl-2", r"mozilla public licen[cs]e(?: version| v)? ?2(?: 0)?", "mpl 2 0", "opensource org licenses mpl 2 0"),
    ("mpl", r"mozilla public", None, None),
    ("epl-1", r"eclipse public licen[cs]e(?: version| v)? ?1(?: 0)?", "epl 1 0", "opensource org licenses epl 1 0"),
    ("epl-2", r"eclipse public licen[cs]e(?: version| v)? ?2(?: 0)?", "epl 2 0", "opensource org licenses epl 2 0"),
    ("epl", r"eclipse public", None, None),
    ("edl-1", r"eclipse distribution", None, None),
    ("cddl-1.0", r"common development and distribution licen[cs]e(?: version| v)? ?1 0", "cddl 1 0", "opensource org licenses cddl 1 0"),
    ("cddl-1.1", r"common development and distribution licen[cs]e(?: version| v)? ?1 1", "cddl 1 1", None),
    ("cpl-1", r"common public licen[cs]e(?: version| v)? ?1(?: 0)?", "cpl 1 0", "opensource org licenses cpl 1 0"),
    ("ipl-1", r"ibm public", "ipl 1 0", "opensource org licenses ipl 1 0"),
    ("eupl-1.1", r"european union public licen[cs]e(?: version| v)? ?1 1", "eupl 1 1", None),
    ("eupl-1.2", r"european union public licen[cs]e(?: version| v)? ?1 2", "eupl 1 2", "opensource org licenses eupl 1 2"),
    ("eupl", r"european union public", None, None),
    ("osl-3", r"open software licen[cs]e(?: version| v)? ?3(?: 0)?", "osl 3 0", "opensource org licenses osl 3 0"),
    ("afl-3", r"academic free licen[cs]e(?: version| v)? ?3(?: 0)?", "afl 3 0", "opensource org licenses afl 3 0"),
    ("artistic-1", r"artistic licen[cs]e(?: version| v)? ?1(?: 0)?", "artistic 1 0", "opensource org licenses artistic 1 0"),
    ("artistic-2", r"artistic licen[cs]e(?: version| v)? ?2(?: 0)?", "artistic 2 0", "opensource org licenses artistic 2 0"),
    ("artistic", r"artistic", None, None),
    ("zlib", r"zlib(?: libpng)?", "zlib", "opensource org licenses zlib"),
    ("bsl-1", r"boost software", "bsl 1 0", "boost org license 1 0"),
    ("unlicense", r"(?:the )?unlicense", "unlicense", "unlicense org"),
    ("wtfpl", r"do what the f\S* you want to public", "wtfpl", None),
    ("postgresql", r"postgresql", "postgresql", "opensource org licenses postgresql"),
    ("python-2", r"python software foundation", "psf 2 0", "opensource org licenses python 2 0"),
    ("php-3", r"php", "php 3 0(?:1)?", "php net license 3 01"),
    ("ruby", r"ruby", "ruby", None),
    ("perl", r"perl", None, None),
    ("openssl", r"openssl", "openssl", None),
    ("curl", r"curl", "curl", None),
    ("ncsa", r"ncsa open source", "ncsa", "opensource org licenses ncsa"),
    ("w3c", r"w3c software(?: notice and)?", "w3c", None),
    ("ofl-1.1", r"(?:sil )?open font", "ofl 1 1", "scripts sil org ofl"),
    ("ms-pl", r"microsoft public", "ms pl", "opensource org licenses ms pl"),
    ("ms-rl", r"microsoft reciprocal", "ms rl", "opensource org licenses ms rl"),
    ("odbl-1", r"open database", "odbl 1 0", "opendatacommons org licenses odbl"),
    ("odc-by-1", r"open data commons attribution", "odc by 1 0", "opendatacommons org licenses by"),
    ("pddl-1", r"public domain dedication and", "pddl 1 0", "opendatacommons org licenses pddl"),
    ("ogl-uk-3", r"open government", "ogl uk 3 0", None),
    ("cecill-2", r"cecill", "cecill 2(?: [01])?", None),
    ("sspl-1", r"server side public", "sspl 1 0", None),
    ("busl-1.1", r"business source", "busl 1 1", None),
    ("elastic-2", r"elastic licen[cs]e(?: version| v)? ?2(?: 0)?", "elastic 2 0", None),
    ("mulan-2", r"mulan permissive software", "mulanpsl 2 0", None),
    ("vim", r"vim", "vim", None),
    ("sleepycat", r"sleepycat", "sleepycat", None),
    ("upl-1", r"universal permissive", "upl 1 0", None),
    ("openrail-m", r"openrail(?: m)?", None, None),
    ("llama", r"llama(?: \d)?(?: \d)? community", None, None),
]

#: Creative Commons terms; labels, patterns and addresses follow from them by rule.
CC_TERMS = [("by", "attribution"), ("by-sa", "attribution share ?alike"), ("by-nc", "attribution non ?commercial"), ("by-nd", "attribution no ?deriv(?:ative)?s?"), ("by-nc-sa", "attribution non ?commercial share ?alike"), ("by-nc-nd", "attribution non ?commercial no ?deriv(?:ative)?s?")]

#: Sentences of the licences themselves: (label, pattern over normalised words). Fixed values, from the public texts.
BODIES = [
    ("mit", r"permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files(?: the software)? to deal in the software without restriction"),
    ("mit", r"the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software"),
    ("bsl-1", r"permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation"),
    ("isc", r"permission to use copy modify and(?: or)? distribute this software for any purpose with or without fee is hereby granted"),
    ("bsd", r"redistribution and use in source and binary forms with or without modification are permitted"),
    ("bsd", r"redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer"),
    ("bsd", r"redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer"),
    ("bsd-3-clause", r"neither the name of (?:[^ ]+ ){1,12}nor the names of its contributors may be used to endorse or promote products derived from this software"),
    ("bsd-4-clause", r"all advertising materials mentioning features or use of this software must display the following acknowledge?ment"),
    ("apache-2", r"you may not use this file except in compliance with the licen[cs]e"),
    ("gpl", r"is free software you can redistribute it and or modify it under the terms of the gnu general public licen[cs]e"),
    ("gpl-2", r"is free software you can redistribute it and or modify it under the terms of the gnu general public licen[cs]e(?: [^ ]+){0,8} version 2(?: of the licen[cs]e)?(?: or(?: at your option)? any later version)?"),
    ("gpl-3", r"is free software you can redistribute it and or modify it under the terms of the gnu general public licen[cs]e(?: [^ ]+){0,8} version 3(?: of the licen[cs]e)?(?: or(?: at your option)? any later version)?"),
    ("lgpl", r"is free software you can redistribute it and or modify it under the terms of the gnu (?:lesser|library) general public licen[cs]e"),
    ("agpl", r"is free software you can redistribute it and or modify it under the terms of the gnu affero general public licen[cs]e"),
    ("gpl", r"without even the implied warranty of merchantability or fitness for a particular purpose see the gnu general public licen[cs]e for more details"),
    ("gfdl", r"permission is granted to copy distribute and or modify this document under the terms of the gnu free documentation licen[cs]e"),
    ("mpl-2", r"this source code form is subject to the terms of the mozilla public licen[cs]e"),
    ("zlib", r"permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely"),
    ("unlicense", r"this is free and unencumbered software released into the public domain"),
    ("unlicense", r"anyone is free to copy modify publish use compile sell or distribute this software"),
    ("cc0", r"the person who associated a work with this deed has dedicated the work to the public domain"),
    ("epl", r"this program and the accompanying materials are made available under the terms of the eclipse public licen[cs]e"),
    ("python-2", r"psf hereby grants licensee a nonexclusive royalty free world wide licen[cs]e"),
    ("postgresql", r"permission to use copy modify and distribute this software and its documentation for any purpose without fee and without a written agreement is hereby granted"),
]

#: A class of rules has a trigger: pieces of which one stands in every text that holds a match, as it is written there,
#: and a pattern over the normalised words, part of every match.
VERBS = r"licen[cs]ed|released|distributed|available|provided|published|covered|shared|offered"
TRIGGERS = {
    "licence": (["licen"], r"licen[cs]e"),
    "apache": (["apache"], r"apache"),
    "spdx": (["spdx"], r"spdx licen"),
    "grant": (["under", "according"], rf"(?:{VERBS}) (?:only )?(?:under|according to) "),
    "address": (["org", "net"], r" (?:org|net) "),
    "cc by": (["cc"], r"cc by"),
    "creative": (["creative"], r"creative commons"),
    "cc0": (["cc0"], r"cc0"),
    "domain": (["domain"], r"the public domain"),
    "body": (["permission", "redistribution", "endorse", "advertising", "compliance", "free", "warranty", "licen", "domain"], r"permission is |permission to |permission notice|redistribution|endorse or promote|advertising materials|in compliance with|is free |implied warranty|source code form|dedicated the work|made available|hereby grants"),
}

GRANT = r"(?:licen[cs]ed|released|distributed|available|provided|published|covered|shared|offered|made available) (?:only )?(?:under|according to) (?:the )?(?:terms of (?:the )?)?"
TAIL = r"(?: licen[cs]e)?"


def literal(pattern: str) -> str:
    """The longest piece that every match of the pattern holds as it stands."""
    flat = pattern
    while (less := re.sub(r"\([^()]*\)(?:[?*]|\{[^}]*\})?", "|", flat)) != flat:
        flat = less
    return max(re.sub(r"(?:\[[^\]]*\]|\\.|.)[?*+]|\[[^\]]*\]|\\.", "|", flat).split("|"), key=len).strip()


def rules() -> list[tuple[str, str, str, int, float]]:
    """(label, keyword, pattern, priority, confidence), in order; the first of equal spans wins."""
    return [r[:5] for r in classed_rules()]


def classed_rules() -> list[tuple[str, str, str, int, float, str]]:
    """The rules, each with its class of ``TRIGGERS``."""
    out = [(label, phrase, phrase, 5, 1.0, "cc by" if phrase.startswith("cc") else "licence") for label, phrase in BASE]
    for label, name, spdx, address in FAMILIES:
        key = literal(name)
        if spdx:
            out.append((label, "spdx license identifier " + literal(spdx), rf"spdx license identifier {spdx}", 4, 1.0, "spdx"))
        out.append((label, key, rf"{GRANT}{name}{TAIL}", 3, 0.95, "grant"))
        out.append((label, key, name if "licen" in name else rf"{name} licen[cs]e", 2, 0.7, "apache" if label.startswith("apache") else "licence"))
        if address:
            out.append((label, literal(address), rf"(?:https? )?(?:www )?{address}", 2, 0.9, "address"))
    for terms, name in CC_TERMS:
        words = terms.replace("-", " ")
        label = f"cc-{terms}"
        out.append((label, f"spdx license identifier cc {words}", rf"spdx license identifier cc {words} \d 0", 4, 1.0, "spdx"))
        out.append((label, f"cc {words}", rf"(?:{GRANT})?(?:creative commons )?cc {words}(?: (?:[1-4] 0|licen[cs]e))*", 3, 0.95, "cc by"))
        out.append((label, "creative commons attribution", rf"(?:{GRANT})?creative commons {name}(?: (?:[1-4] 0|international|licen[cs]e))*", 3, 0.95, "creative"))
        out.append((label, f"creativecommons org licenses {words}", rf"(?:https? )?creativecommons org licenses {words}(?: [1-4] 0)?", 3, 0.95, "address"))
    out += [
        ("cc0", "cc0", r"cc0(?: 1 0)?(?: universal)?", 3, 0.9, "cc0"),
        ("cc", "creative commons", r"creative commons(?: licen[cs]e)?", 1, 0.5, "creative"),
        ("public-domain", "the public domain", r"(?:dedicated to|released into|placed in|in) the public domain", 2, 0.8, "domain"),
        ("proprietary", "without", r"(?:may not be|not) (?:copied|used|reproduced|redistributed) without (?:a |prior )?(?:written )?licen[cs]e", 2, 0.6, "licence"),
        ("license-notice", "licen", r"(?:see|refer to) (?:the )?licen[cs]e(?: file)?", 1, 0.3, "licence"),
        ("license-notice", "licen", rf"{GRANT}(?:the |a )?[^ ]+ licen[cs]e", 1, 0.4, "grant"),
    ]
    return out + [(label, literal(body), body, 4, 0.98, "body") for label, body in BODIES]


def gated(text: Column) -> Column:
    """Whether the text holds a piece of some trigger, and so may hold a match; a text that does not has none."""
    low = F.lower(text)
    return _let(low, lambda t: reduce(lambda a, b: a | b, [F.contains(t, F.lit(w)) for w in dict.fromkeys(w for pieces, _ in TRIGGERS.values() for w in pieces)]))


def classes(norm: Column) -> Column:
    """The classes of rules, as an array of names, whose trigger stands in the normalised text."""
    return F.filter(F.array(*[F.when(norm.rlike(pattern), F.lit(name)) for name, (_, pattern) in TRIGGERS.items()]), lambda c: c.isNotNull())


def word_count(text: Column) -> Column:
    """Number of words: the pieces between separators, without an empty one at either end."""
    edge = lambda at: F.when(F.substring(text, at, 1).rlike(f"^{SEPARATORS}$"), 1).otherwise(0)
    return F.when(text == "", 0).otherwise(F.size(F.split(text, SEPARATORS, -1)) - edge(1) - edge(-1)).cast("long")


def normalised(text: Column) -> Column:
    """The words with one space around each."""
    return F.concat(F.lit(" "), F.trim(F.regexp_replace(F.translate(text, UPPER, LOWER), SEPARATORS, " ")), F.lit(" "))


def _let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once for a row."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _spans(norm: Column, rule: Column) -> Column:
    """Where a rule's pattern stands in the normalised text, left to right, from its pieces and matches."""
    pattern = F.concat(F.lit("(?<= )(?:"), rule["pattern"], F.lit(")(?= )"))
    pairs = F.zip_with(
        F.split(norm, pattern, -1), F.regexp_extract_all(norm, pattern, F.lit(0)), lambda gap, hit: F.struct(F.length(gap).alias("gap"), F.length(hit).alias("hit"))
    )
    start = F.struct(F.lit(0).alias("at"), F.expr("cast(array() as array<struct<b:int,e:int>>)").alias("out"))

    def step(acc, x):
        begin = acc["at"] + x["gap"]
        return F.struct((begin + x["hit"]).alias("at"), F.concat(acc["out"], F.array(F.struct(begin.alias("b"), (begin + x["hit"]).alias("e")))).alias("out"))

    found = F.aggregate(F.filter(pairs, lambda x: x["hit"].isNotNull()), start, step, lambda acc: acc["out"])
    return F.transform(
        found,
        lambda s: F.struct(
            s["b"].alias("b"), (-s["e"]).alias("ne"), (-rule["priority"]).alias("np"), rule["n"].alias("n"), s["e"].alias("e"), rule["label"].alias("label"), rule["confidence"].alias("confidence")
        ),
    )


_LEVELS = [1, 2, 3, 4, 5]


def _suppressed(spans: Column) -> Column:
    """The spans that stand: none of higher priority overlaps them, none of the same contains them. One sweep each way."""

    def pick(states, level):
        return reduce(lambda acc, k: F.when(level == k, states[k - 1]).otherwise(acc), _LEVELS, F.lit(None).cast("int"))

    empty = F.expr("cast(array() as array<struct<b:int,e:int,p:int,n:int,label:string,confidence:double>>)")

    def sweep(items, forward):
        blank = -1 if forward else 2**31 - 1
        start = F.struct(*[F.lit(blank).alias(f"m{k}") for k in _LEVELS], empty.alias("out"))

        def step(acc, s):
            m = [acc[f"m{k}"] for k in _LEVELS]
            fold = F.greatest if forward else F.least
            above = [fold(*m[k:], F.lit(blank)) if k < len(m) else F.lit(blank) for k in _LEVELS]
            over = pick(above, s["p"])
            bad = (over > s["b"]) | (pick(m, s["p"]) >= s["e"]) if forward else over < s["e"]
            bad = bad & (s["p"] < 5)
            edge = s["e"] if forward else s["b"]
            return F.struct(
                *[F.when(s["p"] == k, fold(m[k - 1], edge)).otherwise(m[k - 1]).alias(f"m{k}") for k in _LEVELS],
                F.concat(acc["out"], F.array(F.struct(s["b"].alias("b"), F.when(bad, -1).otherwise(s["e"]).alias("e"), *[s[c].alias(c) for c in ("p", "n", "label", "confidence")]))).alias("out"),
            )

        return F.aggregate(items, start, step, lambda acc: acc["out"])

    plain = F.transform(F.array_sort(spans), lambda s: F.struct(s["b"].alias("b"), s["e"].alias("e"), (-s["np"]).alias("p"), *[s[c].alias(c) for c in ("n", "label", "confidence")]))
    forward = _let(plain, lambda p: F.zip_with(p, sweep(p, True), lambda a, f: F.struct(a["b"].alias("b"), a["e"].alias("e"), a["p"].alias("p"), a["n"].alias("n"), a["label"].alias("label"), a["confidence"].alias("confidence"), (f["e"] < 0).alias("bad"))))
    both = _let(
        F.reverse(forward),
        lambda p: F.zip_with(p, sweep(F.transform(p, lambda s: F.struct(*[s[c].alias(c) for c in ("b", "e", "p", "n", "label", "confidence")])), False), lambda a, f: F.struct(*[a[c].alias(c) for c in ("b", "e", "p", "n", "label", "confidence")], (a["bad"] | (f["e"] < 0)).alias("bad"))),
    )
    return F.filter(F.reverse(both), lambda s: ~s["bad"])


def _word_at(norm: Column, at: Column) -> Column:
    """Words before the character offset ``at`` of the normalised text."""
    head = F.substring(norm, F.lit(1), at)
    return (F.length(head) - F.length(F.replace(head, F.lit(" "), F.lit(""))) - 1).cast("long")


def scan(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, n_words and detections, an array of the spans that stand.

    A detection has first_word and end_word (from 0, end exclusive), label, priority (5: base) and confidence.
    """
    table = F.array(*[F.struct(F.lit(k).alias("n"), F.lit(a).alias("label"), F.lit(w).alias("keyword"), F.lit(p).alias("pattern"), F.lit(q).alias("priority"), F.lit(c).alias("confidence"), F.lit(t).alias("trigger")) for k, (a, w, p, q, c, t) in enumerate(classed_rules())])
    text = F.coalesce(F.col("text"), F.lit(""))

    def detect(norm):
        open_ = _let(classes(norm), lambda c: F.filter(table, lambda r: F.array_contains(c, r["trigger"]) & F.contains(norm, r["keyword"])))
        return F.transform(
            _suppressed(F.flatten(F.transform(open_, lambda r: _spans(norm, r)))),
            lambda s: F.struct(_word_at(norm, s["b"]).alias("first_word"), _word_at(norm, s["e"] + 1).alias("end_word"), s["label"].alias("label"), s["p"].alias("priority"), s["confidence"].alias("confidence")),
        )

    empty = F.expr("cast(array() as array<struct<first_word:bigint,end_word:bigint,label:string,priority:int,confidence:double>>)")
    return docs.select(F.col(id_column).alias("doc_id"), F.col(text_column).alias("text")).select(
        "doc_id", word_count(text).alias("n_words"), F.when(gated(text), _let(normalised(text), detect)).otherwise(empty).alias("detections")
    )


def license_report(docs: DataFrame) -> DataFrame:
    """The digest of ``scan``: counts, first and last base word, base labels, all labels and a score for each row."""

    def joined(items):
        return F.array_join(F.array_sort(F.array_distinct(F.transform(items, lambda s: s["label"]))), ",")

    def digest(found):
        base = F.filter(found, lambda s: s["priority"] == 5)
        starts = F.transform(base, lambda s: s["first_word"])
        return F.struct(
            F.size(base).cast("long").alias("n_base"), F.array_min(starts).alias("first_word"), F.array_max(starts).alias("last_word"), joined(base).alias("base_labels"), joined(found).alias("labels"),
            F.coalesce(F.array_max(F.transform(found, lambda s: s["confidence"])), F.lit(0.0)).alias("score"),
        )

    return scan(docs).select("doc_id", "n_words", F.inline(F.transform(F.array("detections"), digest)))
