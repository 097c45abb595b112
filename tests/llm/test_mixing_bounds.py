import numpy as np
from pyspark.sql import functions as F

from tallyforge.llm import mixing
from tallyforge.llm.common import materialise


def test_full_cells_keep_the_marginals(spark):
    rows = [(f"s{i}", f"l{j}", k, 1000 if (i + j + k) % 4 == 0 else 100 + 10 * i) for i in range(4) for j in range(2) for k in range(2)]
    cells = spark.createDataFrame(rows, "source string, lang string, topic int, tokens long")
    want = {k: mixing.marginal(cells, k, 0.5) for k in mixing.KEYS}
    p = materialise(mixing.probabilities(mixing.rake(cells, want, share=0.55), 0.55), "p")
    assert p.where("p > 0.999999").count() >= 1 and p.where("p > 1").count() == 0
    assert all(abs(r.reached / r.target - 1) < 1e-3 for r in mixing.reached(p, want).collect())
    assert abs(p.agg(F.sum(F.col("p") * F.col("tokens")) / F.sum("tokens")).first()[0] - 0.55) < 1e-6


def test_a_value_with_too_few_tokens_is_taken_whole(spark):
    cells = spark.createDataFrame([("a", "x", 0, 900), ("b", "x", 0, 90), ("c", "x", 0, 10)], "source string, lang string, topic int, tokens long")
    want = {k: mixing.marginal(cells, k, 0.0) for k in mixing.KEYS}
    p = {r.source: r.p for r in mixing.probabilities(mixing.rake(cells, want, share=0.5), 0.5).collect()}
    assert abs(p["b"] - 1) < 1e-9 and abs(p["c"] - 1) < 1e-9 and abs(p["a"] - 400 / 900) < 1e-9


def test_the_operator_against_a_plain_raking(spark):
    """Whole rows of the report against loops over documents and cells, written without the operator's code."""
    import hashlib
    import random

    rng = random.Random(3)
    rows = [(i, " ".join(rng.choice("abcdefghijkl") * rng.randrange(1, 5) for _ in range(rng.randrange(1, 60))), rng.choice(["en", "en", "en", "fr", None]), rng.choice(["s1", "s1", "s1", "s2", "s3"])) for i in range(400)]
    got = {r.doc_id: (r.source, r.lang, r.topic, r.tokens, r.p) for r in mixing.mixing_report(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")).collect()}
    docs, cells = [], {}
    for i, text, lang, source in rows:
        words = text.split()
        votes = [sum(ord(w[0]) % 6 == k for w in words) for k in range(6)]
        key = (source, lang or "", votes.index(max(votes)))
        docs.append((i, key, len(words)))
        cells[key] = cells.get(key, 0) + len(words)
    total = sum(cells.values())
    cap = {c: n / (0.5 * total) for c, n in cells.items()}
    want = []
    for at in range(3):
        values = {v: sum(n for c, n in cells.items() if c[at] == v) for v in {c[at] for c in cells}}
        goal, free = {}, dict(values)
        while free:  # values that have too few tokens are taken whole, the others share the rest
            left = 1 - sum(goal.values())
            share = {v: left * values[v] ** 0.5 / sum(values[x] ** 0.5 for x in free) for v in free}
            full = [v for v in free if share[v] > values[v] / (0.5 * total)]
            if not full:
                goal |= share
                break
            goal |= {v: values[v] / (0.5 * total) for v in full}
            free = {v: n for v, n in free.items() if v not in full}
        assert abs(sum(goal.values()) - 1) < 1e-9
        want.append(goal)
    latent, before = {c: n / total for c, n in cells.items()}, {}
    weights = lambda: {c: min(cap[c], latent[c]) for c in cells}
    for _ in range(1000):
        for at in range(3):
            for v, goal in want[at].items():
                mine = [c for c in cells if c[at] == v]
                low, high = 0.0, max(cap[c] / latent[c] for c in mine)
                for _ in range(100):  # the factor under which the cells, cut at their bounds, reach the goal
                    f = (low + high) / 2
                    low, high = (f, high) if sum(min(cap[c], f * latent[c]) for c in mine) < goal else (low, f)
                for c in mine:
                    latent[c] *= high
        if before and sum(abs(x - before[c]) for c, x in weights().items()) < 1e-9:
            break
        before = weights()
    p = {c: min(1.0, x * 0.5 * total / cells[c]) for c, x in weights().items()}
    drawn = {i for i, key, _ in docs if int(hashlib.md5(str(i).encode()).hexdigest()[:8], 16) / 2**32 < p[key]}
    assert set(got) == drawn and len(drawn) > 100
    for i, key, n in docs:
        if i in drawn:
            assert got[i][:4] == (*key, n) and abs(got[i][4] - p[key]) < 1e-4, (i, key)


def test_weights_that_drift_apart_still_settle():
    """Targets that contradict each other: products of factors leave the range of a double here after some hundred rounds."""
    rng = np.random.default_rng(86)
    codes = [rng.integers(0, k, 60) for k in (8, 3, 3)]
    tokens = np.floor(np.exp(rng.normal(5, 2, 60))) + 1
    groups = []
    for code in codes:
        _, at = np.unique(code, return_inverse=True)
        a = np.bincount(at, tokens) ** 0.5
        groups.append((at, a / a.sum()))
    cap = tokens / tokens.sum() / 0.5
    w = mixing.settle(tokens / tokens.sum(), cap, groups, mixing.MOST_ROUNDS)
    assert (w <= cap * (1 + 1e-12)).all() and abs(w.sum() - 1) < 1e-9
