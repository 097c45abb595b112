import random
import re

from tallyforge.llm import near


def brute(rows, words=5, similarity=0.8):
    seqs = [(i, tuple(re.findall(r"[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+", (t or "").lower()))) for i, t in rows]
    texts = sorted({s for _, s in seqs if s})
    grams = {s: {s[j : j + words] for j in range(len(s) - words + 1)} for s in texts}
    parent = {s: s for s in texts}

    def find(s):
        while parent[s] != s:
            s = parent[s]
        return s

    links = dict.fromkeys(texts, 0)
    for a in texts:
        for b in texts:
            if a < b and grams[a] and len(grams[a] & grams[b]) >= similarity * len(grams[a] | grams[b]):
                links[a] += 1
                links[b] += 1
                parent[find(a)] = find(b)
    least, copies = {}, {}
    for i, s in seqs:
        if s:
            copies[s] = copies.get(s, 0) + 1
            if i is not None:
                least[find(s)] = min(i, least.get(find(s), i))
    return sorted(((i, least.get(find(s)), copies[s], links[s]) if s else (i, i, 1, 0) for i, s in seqs), key=str)


def corpus(seed, n=120):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(300)]
    bases = [[rng.choice(vocabulary) for _ in range(rng.randrange(60, 120))] for _ in range(6)]
    rows = [(1, None), (2, ""), (3, "one two"), (4, "One, two!"), (5, " ".join(["x"] * 40)), (6, " ".join(["X"] * 30))]
    for i in range(10, n):
        w = list(rng.choice(bases)) if i % 4 else [rng.choice(vocabulary) for _ in range(50)]
        for _ in range(rng.randrange(0, 6)):
            w[rng.randrange(len(w))] = rng.choice(vocabulary)
        rows.append((i, " ".join(w)))
    return rows


def test_against_brute_force(spark, monkeypatch):
    rows = corpus(3)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((tuple(r) for r in near.near_report(df).collect()), key=str)
    assert got == brute(rows)
    kept = {r.doc_id for r in near.deduplicate(df).collect()}
    assert kept == {c for _, c, _, _ in brute(rows)}


def test_blocks_give_the_same(spark, monkeypatch):
    monkeypatch.setattr(near, "BUCKET_BLOCK", 7)
    monkeypatch.setattr(near, "FAMILY_BLOCK", 5)
    rows = corpus(4, 80)
    got = sorted((tuple(r) for r in near.near_report(spark.createDataFrame(rows, "doc_id long, text string")).collect()), key=str)
    assert got == brute(rows)


def test_empty_and_repeated(spark):
    df = spark.createDataFrame([], "doc_id long, text string, node long, row string, family int")
    assert near.near_report(df).count() == 0 and near.deduplicate(df).count() == 0
    df = spark.createDataFrame([(1, "a b c d e f", "x"), (1, "a b c d e f", "x"), (None, "A b c d e f", "y")], "doc_id long, text string, node string")
    assert [tuple(r) for r in near.deduplicate(df).collect()] == [(1, "a b c d e f", "x")]


def test_bands_reach_recall():
    bands, rows = near.choose_bands(0.8, 0.999)
    assert 1 - (1 - 0.8**rows) ** bands >= 0.999


def test_one_row_of_each_class_and_clashing_columns(spark):
    text = " ".join(f"w{i}" for i in range(40))
    rows = [(1, text), (1, text), (1, text + " more"), (2, text), (None, text), (None, "other words that nobody else has here"), (None, "Other words that nobody else has here!"), (None, None), (None, None), (5, ""), (6, "")]
    df = spark.createDataFrame([(i, t, 7, "x", 1, 2) for i, t in rows], "doc_id long, text string, tf_row int, label string, tf_class int, `a.b` int")
    kept = near.deduplicate(df)
    assert kept.columns == df.columns
    got = sorted(((r[0], (r[1] or "")[:5].lower()) for r in kept.collect()), key=str)
    assert got == sorted([(1, "w0 w1"), (None, "other"), (None, ""), (5, ""), (6, "")], key=str) and kept.first()[2] == 7


def test_very_long_texts(spark):
    words = [f"w{i}" for i in range(40_000)]
    rows = [(1, " ".join(words)), (2, " ".join([*words[:20_000], "x", *words[20_001:]])), (3, " ".join(words[20_000:]))]
    got = {r.doc_id: (r.class_id, r.n_links) for r in near.near_report(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: (1, 1), 2: (1, 1), 3: (3, 0)}


def test_components_do_not_end_early(spark):
    import pytest

    from tallyforge.llm.graph import components

    chain = spark.createDataFrame([(i, i + 1) for i in range(200)] + [(1000, 1000 + i) for i in range(1, 300)], "u long, v long")
    got = {r.node: r.label for r in components(chain).collect()}
    assert all(got[i] == 0 for i in range(201)) and all(got[1000 + i] == 1000 for i in range(300))
    with pytest.raises(RuntimeError, match="not settled"):
        components(chain, rounds=2)
