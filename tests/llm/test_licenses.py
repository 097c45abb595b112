import random
import re
from re import _constants as sre
from re import _parser

from tallyforge.llm import licenses


def words(text):
    low = (text or "").translate({c: c + 32 for c in range(65, 91)})
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)


def spans(w):
    """Every match of every rule, by the definition: (first character, end, priority, rule) over the words."""
    norm = " " + " ".join(w) + " "
    return norm, [(m.start(), m.end(), p, n, label, c) for n, (label, _, pattern, p, c) in enumerate(licenses.rules()) for m in re.finditer(rf"(?<= )(?:{pattern})(?= )", norm)]


def standing(found):
    out = []
    for s in found:
        higher = any(t[2] > s[2] and t[0] < s[1] and s[0] < t[1] for t in found)
        inside = any(t[2] == s[2] and t is not s and t[0] <= s[0] and s[1] <= t[1] and ((t[0], t[1]) != (s[0], s[1]) or t[3] < s[3]) for t in found)
        if s[2] == 5 or not (higher or inside):
            out.append(s)
    return out


def brute(doc_id, text):
    w = words(text)
    base = [i for i in range(len(w)) for _, phrase in licenses.BASE if w[i : i + len(phrase.split())] == phrase.split()]
    labels = {label for label, phrase in licenses.BASE for i in range(len(w)) if w[i : i + len(phrase.split())] == phrase.split()}
    kept = standing(spans(w)[1])
    return (doc_id, len(w), len(base), min(base, default=None), max(base, default=None), ",".join(sorted(labels)), ",".join(sorted({s[4] for s in kept})), max((s[5] for s in kept), default=0.0))


PIECES = ["Released under the MIT License.", "Apache License, Version 2.0", "CC BY-NC 4.0", "cc by nc cc by nc", "GNU General Public License, version 3", "SPDX-License-Identifier: GPL-2.0-or-later", "Licensed under the Mozilla Public License 2.0",
          "https://opensource.org/licenses/MIT", "creative commons attribution share alike 4.0", "CC0 1.0 Universal", "see the LICENSE file", "released into the public domain", "modified BSD license", "lgpl v2.1 license", "ÉTÉ naïve 日本", "plain words", "organ CC by", "UNDER THE MIT", "license", "x\x00y"]


def test_against_brute_force(spark):
    rng = random.Random(5)
    rows = [(None, "under the mit license"), (1, None), (2, ""), (3, " ,.;\n"), (4, "İ under the mit license"), (5, "K"), (6, "under the mit license " * 300)]
    rows += [(i, "".join(rng.choice(PIECES) + rng.choice([" ", ", ", "\n"]) for _ in range(rng.randrange(1, 9)))) for i in range(10, 160)]
    df = spark.createDataFrame([(i, t, "x", 1) for i, t in rows], "doc_id long, text string, labels string, n long")
    got = [tuple(r) for r in licenses.license_report(df).collect()]
    for g, (i, t) in zip(got, rows, strict=True):
        assert g == brute(i, t), (t, spans(words(t))[1])
    assert licenses.license_report(df.limit(0)).count() == 0


def test_rules_hold_their_keywords():
    assert 250 <= len(licenses.rules()) < 1000
    for label, phrase in licenses.BASE:
        assert any(r[:3] == (label, phrase, phrase) for r in licenses.rules())


def drawn(tree, rng):
    """A random match of a parsed pattern, with few repeats."""
    out = ""
    for op, arg in tree:
        if op is sre.LITERAL:
            out += chr(arg)
        elif op is sre.BRANCH:
            out += drawn(rng.choice(arg[1]), rng)
        elif op is sre.SUBPATTERN:
            out += drawn(arg[3], rng)
        elif op is sre.MAX_REPEAT:
            out += "".join(drawn(arg[2], rng) for _ in range(rng.randint(arg[0], min(arg[1], arg[0] + 2))))
        elif op is sre.IN:
            kinds = [chr(v) if o is sre.LITERAL else chr(v[0]) if o is sre.RANGE else "7" if o is sre.CATEGORY else "x" for o, v in arg]
            out += "x" if arg[0][0] is sre.NEGATE else rng.choice(kinds)
        elif op is sre.NOT_LITERAL:
            out += "x"
        else:
            raise AssertionError(op)
    return out


def test_every_rule_passes_its_gate(spark):
    rng = random.Random(8)
    rows = []
    for label, keyword, pattern, _, _, trigger in licenses.classed_rules():
        for _ in range(4):
            text = drawn(_parser.parse(pattern), rng)
            assert re.fullmatch(pattern, text) and keyword in text and re.search(licenses.TRIGGERS[trigger][1], f" {text} "), (pattern, text)
            assert any(w in text for w in licenses.TRIGGERS[trigger][0]), (pattern, text)
            rows.append((len(rows), f"Before; {text.upper() if rng.random() < 0.5 else text}. After"))
    got = [tuple(r) for r in licenses.license_report(spark.createDataFrame(rows, "doc_id long, text string")).orderBy("doc_id").collect()]
    for g, (i, t) in zip(got, rows, strict=True):
        assert g == brute(i, t) and g[6], t


def test_texts_without_the_word_license(spark):
    texts = {"Distributed under the GNU GPL v3.": "gpl-3", "Released under MIT.": "mit", "available under the terms of the Apache 2.0": "apache-2", "Licensed under the Do What The F... You Want To Public License": "wtfpl",
             "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction": "mit",
             "Redistribution and use in source and binary forms, with or without modification, are permitted": "bsd", "it is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License": "gpl"}
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for r in licenses.license_report(df).collect():
        assert list(texts.values())[r.doc_id] in r.labels.split(","), r


def test_very_long_text(spark):
    text = "word " * 30_000 + "under the MIT license " + "word " * 30_000
    r = licenses.license_report(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    assert (r.n_words, r.n_base, r.first_word, r.base_labels) == (60_004, 1, 30_000, "mit")
