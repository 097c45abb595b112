import hashlib
import random

import numpy as np

from tallyforge.llm import substrings


def brute(rows, window=13):
    docs = [(2**63 - 1 if i is None else i, i, (t or "").encode().split()) for i, t in rows]
    least = {}
    for k, _, w in docs:
        for j in range(len(w) - window + 1):
            g = tuple(w[j : j + window])
            least[g] = min(k, least.get(g, k))
    out = []
    for k, i, w in docs:
        keep = [True] * len(w)
        for j in range(len(w) - window + 1):
            if least[tuple(w[j : j + window])] < k:
                keep[j : j + window] = [False] * window
        kept = b" ".join(x for x, y in zip(w, keep) if y)
        out.append((i, len(w), len(w) - sum(keep), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def test_against_brute_force(spark):
    rng = random.Random(7)
    vocabulary = [f"w{i}" for i in range(12)] + ["é", "naïve"]
    passage = " ".join(rng.choice(vocabulary) for _ in range(60))
    rows = [(None, passage), (1, None), (2, ""), (3, "a b c"), (4, passage), (4, passage), (5, "x " + passage + " y"), (6, " ".join(["same"] * 50)), (7, " ".join(["same"] * 20)), (9, "one\x00two three " * 15)]
    for i in range(10, 60):
        w = [rng.choice(vocabulary) for _ in range(rng.randrange(0, 80))]
        if i % 3 == 0:
            w[5:5] = passage.split()[rng.randrange(0, 20) : rng.randrange(25, 60)]
        rows.append((i, rng.choice([" ", "\n", "\t "]).join(w)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((tuple(r) for r in substrings.substring_report(df).collect()), key=str)
    assert got == brute(rows)


def test_empty_table_and_clashing_columns(spark):
    df = spark.createDataFrame([], "doc_id long, text string, bucket int, starts string, row string, k int")
    assert substrings.substring_report(df).count() == 0


def test_one_pair_of_words_in_every_window(spark):
    rng = random.Random(1)
    rows = [(i, " ".join(f"hot pair {rng.choice('abc')}{rng.randrange(4)}" for _ in range(40))) for i in range(80)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    plan = substrings.survey(df, 13, 2, 2000)
    assert (plan.parts > 1).any() and plan.buckets > 10
    got = sorted((tuple(r) for r in substrings.drop_repeats(df, capacity=2000).drop("kept").collect()), key=str)
    assert got == brute(rows)


def test_buckets_hold_no_more_than_their_capacity():
    loads = np.random.default_rng(0).integers(0, 900, 500)
    loads[7] = 5000
    plan = substrings.Plan(loads, 1000)
    held = np.bincount(plan.base[plan.parts == 1], loads[plan.parts == 1], plan.buckets)
    assert held.max() <= 1000 and plan.parts[7] == 10 and (plan.base[8:] >= plan.base[7] + 10).all()


def test_very_long_texts(spark):
    long = " ".join(f"w{i}" for i in range(60_000))
    got = {r.doc_id: r for r in substrings.substring_report(spark.createDataFrame([(1, long), (2, "start " + long)], "doc_id long, text string")).collect()}
    assert (got[1].n_removed, got[2].n_removed, got[2].n_words) == (0, 60_000, 60_001)
