import random
import zlib

import numpy as np

from tallyforge.llm import toxicity as tox


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def test_matches_equal_brute_force():
    rng = random.Random(1)
    stems = ["idiot", "moron", "abcabc", "trash", "scu"]
    match = tox.Matcher(dict.fromkeys(stems, 1.0))
    for _ in range(4000):
        w = rng.choice(stems) if rng.random() < 0.7 else "".join(rng.choice("abcdit") for _ in range(6))
        w = list(w)
        for _ in range(rng.randrange(3)):
            at = rng.randrange(len(w) + 1)
            w[at : at + rng.randrange(2)] = rng.choice(["", "a", "x"])
        w = "".join(w)
        if not w:
            continue
        exact = any(w.startswith(s) for s in stems)
        near = any(len(s) >= 5 and distance(w, s) <= 1 for s in stems)
        hit = match(w)
        assert (hit is not None) == (exact or near), w
        assert hit is None or hit[1] == (not exact)


def test_quotation_is_told_from_abuse():
    match = tox.Matcher({"idiot": 1.0})
    w = tox.PRIOR
    score = lambda t: w[0] + sum(a * b for a, b in zip(w[1:], tox.features(t, match)))
    assert score("you are an idiot and an idiot") > score('he said the word "idiot" is an insult')
    assert tox.features("", match) == tox.features(None, match) == tox.features("nothing here", match) == [0.0] * tox.FEATURES


def test_fit_does_not_diverge_on_separable_rows():
    rng = np.random.default_rng(0)
    y = (rng.random(3500) < 0.1).astype(float)
    x = np.zeros((3500, tox.FEATURES))
    x[:, 0] = y * np.log1p(rng.integers(1, 20, 3500))
    x[:, 1] = (rng.random(3500) < 0.02) * 0.7
    x[:, 4], x[:, 5] = y, x[:, 1] * rng.random(3500) * 3
    w = tox.fit(x, y)
    p = 1 / (1 + np.exp(-(w[0] + x @ w[1:])))
    assert np.abs(w).max() < 50 and ((p >= 0.3) == (y == 1)).all()


def test_held_out_accuracy_and_edge_cases(spark):
    rng = random.Random(2)
    words = ["la", "mer", "vent", "rue", "bleu", "porte", "livre", "jour"]
    rows, labels = [], []
    for i in range(1200):
        t = [rng.choice(words) for _ in range(30)]
        bad = i % 6 == 0
        if bad:
            t[5] = "zorgu" + rng.choice(["", "bla", "fno"])
        rows.append((i, " ".join(t), "x"))
        labels.append((i, None, int(bad)))
    rows += [(5000, None, "x"), (5001, "", "x"), (None, "zorgu zorgubla", "x"), (0, rows[0][1], "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, toxic string")
    known = spark.createDataFrame([*labels, (5001, 1, None)], "doc_id long, quality int, toxic int")
    got = tox.toxicity_report(docs, known).collect()
    assert len(got) == len(rows)
    for r in got:
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3)
        assert r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 4 == 2)
        if r.doc_id is not None and r.doc_id < 5000:
            assert r.predicted == int(r.doc_id % 6 == 0)
    assert {r.doc_id for r in got if r.predicted and (r.doc_id is None or r.doc_id >= 5000)} == {None}
    assert tox.drop_toxic(docs, known).columns == docs.columns
    assert tox.toxicity_report(docs.limit(0), known.limit(0)).count() == 0
    assert tox.toxicity_report(docs, known.limit(0)).count() == len(rows)


def test_chance_insults_and_digits():
    match = tox.Matcher({"idiot": (1e-5, 2e-5), "rebo": (4e-4, None)})
    score = lambda t: tox.PRIOR[0] + sum(a * b for a, b in zip(tox.PRIOR[1:], tox.features(t, match)))
    assert score("rebola " + "lorem " * 60) > -0.85 > score("rebola " + "lorem " * 20_000) and score("rebola rebota rebomi rebosi " + "lorem " * 600) > 0
    assert match("whore") and not match("whorea") and not match("oron")
    assert match("1diot") == match("id1ot") == (0, True) and score("what an 1diot that is") > score("what a day that is")
    assert tox.surprise(3, 3.0) == 0 and tox.surprise(0, 0.1) == 0 and tox.surprise(9, 1.0) > tox.surprise(5, 1.0)


def test_stems_count_without_their_longer_ones():
    rows = [("stupid", 60, 0), ("stu", 63, 300), ("rebo", 90, 5), ("rebola", 20, 0), ("re", 120, 4000)]
    assert tox.choose(rows, 10_000, 100_000) == {"rebo": 5, "stupid": 0}


def test_clashing_columns_and_long_texts(spark):
    rows = [(i, f"calm day {i} in the sun " * 3 + ("zorgu zorgula" if i % 4 == 0 else ""), "t", 1.0, 2, 3) for i in range(400)] + [(401, "calm day " * 30_000, "t", 1.0, 2, 3), (402, "zorgu zorgula " * 15_000, "t", 1.0, 2, 3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, tf_text string, tf_score double, `a.b` int, toxic int")
    known = spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(400)], "doc_id long, toxic int")
    kept = tox.drop_toxic(docs, known)
    assert kept.columns == docs.columns and {r[0] for r in kept.collect()} == {i for i in range(400) if i % 4} | {401}
