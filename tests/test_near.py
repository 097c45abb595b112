import random
import re

import pytest

from tallyforge.operators import near


def brute(rows, similarity):
    """Pairs of distinct texts of a type, by sets of word 5-grams."""
    texts = sorted(set(rows))
    sets = {}
    for kind, t in texts:
        w = re.findall(r"\w+", t)
        s = {tuple(w[i : i + 5]) for i in range(len(w) - 4)}
        if len(s) >= 26:
            sets[kind, t] = s
    out = {}
    keys = sorted(sets)
    for i, a in enumerate(keys):
        for b in keys[i + 1 :]:
            if a[0] == b[0]:
                both = len(sets[a] & sets[b])
                j = both / (len(sets[a]) + len(sets[b]) - both)
                if j >= similarity:
                    out[a, b] = j
    return sets, out


def corpus(seed, families=12, members=14):
    rng = random.Random(seed)
    vocabulary = [f"w{k}" for k in range(400)]
    boiler = [rng.choice(vocabulary) for _ in range(60)]
    rows = []
    for f in range(families):
        base = [rng.choice(vocabulary) for _ in range(rng.choice([30, 34, 60, 200, 900]))] + (boiler if f % 2 else [])
        for _ in range(members):
            w = list(base)
            for _ in range(rng.randrange(0, 5)):
                k = rng.randrange(len(w))
                w[k : k + rng.randrange(0, 2)] = [rng.choice(vocabulary)] * rng.randrange(0, 2)
            rows.append((rng.choice("ab"), " ".join(w + [rng.choice(vocabulary) for _ in range(rng.randrange(0, 9))])))
    rows += [("a", " ".join(boiler)), ("b", " ".join(boiler)), ("a", "x " * 400), ("a", "short one"), ("a", ""), rows[0], rows[0]]
    return rows


@pytest.mark.parametrize(("similarity", "block"), [(0.9, None), (0.8, 6), (0.97, 5)])
def test_pairs_and_classes_against_brute_force(spark, monkeypatch, similarity, block):
    if block:
        monkeypatch.setattr(near, "MEETING_BLOCK", block)
        monkeypatch.setattr(near, "FAMILY_BLOCK", block)
    rows = corpus(int(similarity * 100))
    sets, want = brute(rows, similarity)
    df = spark.createDataFrame(rows, "text_type string, norm string").selectExpr("*", "sha2(norm, 256) h")
    names = {(r.text_type, r.norm): r.h for r in df.collect()}
    made = near.text_sets(df)
    got = near.near_pairs(made, similarity).collect()
    assert len(got) == len(want) > 20
    expected = {(a[0], *sorted((names[a], names[b]))): j for (a, b), j in want.items()}
    assert {(r.text_type, r.left, r.right): r.jaccard for r in got} == pytest.approx(expected)
    parent = {k: k for k in sets}

    def find(k):
        while parent[k] != k:
            k = parent[k]
        return k

    count = dict.fromkeys(sets, 0)
    for a, b in want:
        parent[find(a)] = find(b)
        count[a] += 1
        count[b] += 1
    least = {}
    for k in sets:
        least[find(k)] = min(names[k], least.get(find(k), "g"))
    classes = {(r.text_type, r.h): (r.class_h, r.links) for r in near.near_classes(made, similarity).collect()}
    assert classes == {(k[0], names[k]): (least[find(k)], count[k]) for k in sets}


def test_a_large_family_makes_rows_by_text(spark, monkeypatch):
    """3,000 near-equal texts have 4.5 million pairs; no stage hands on more than a few rows a text."""
    rng = random.Random(9)
    base = [f"v{k}" for k in range(120)]
    rows = []
    for i in range(3000):
        w = list(base)
        w[rng.randrange(0, 3)] = f"u{i}"
        rows.append(("a", " ".join(w)))
    sets = near.text_sets(spark.createDataFrame(rows, "text_type string, norm string"))
    texts = near.ordered(sets, 0.9)
    assert near.links(texts, 0.9).count() < 30 * 3000
    compared = near._compared(sets, 0.9, False)[1]
    assert compared.count() < 20 * 3000
    got = near.near_classes(sets, 0.9).collect()
    assert len(got) == 3000 and {r.links for r in got} == {2999} and len({r.class_h for r in got}) == 1


def test_nothing_to_compare(spark):
    sets = near.text_sets(spark.createDataFrame([], "text_type string, norm string"))
    assert near.near_pairs(sets).count() == 0 and near.near_classes(sets).count() == 0
