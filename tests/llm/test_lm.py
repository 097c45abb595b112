import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from tallyforge.llm import lm
from tallyforge.llm.common import Lookup, WordHasher, ascii_nonword_separators, one_thread


def test_gradients():
    rng = np.random.default_rng(0)
    side = 8
    flat = lm.new_network(side).astype(np.float64)
    context, y = rng.integers(0, side * side + 1, (60, 2 * lm.SIDE)), rng.integers(0, side * side, 60)
    loss = lambda f: -lm.log_probabilities(lm.parts_of(f, side), context, y, side).mean()
    shared, touched = lm.gradients(lm.parts_of(flat, side), context, y, side)
    whole = np.zeros(len(flat))
    w = lm.parts_of(whole, side)
    for part, grad in zip(w[:5], shared, strict=True):
        part[:] = grad
    for g, grad_m, grad_n in touched:
        w[5][g], w[6][g] = grad_m, grad_n
    for i in rng.choice(len(flat), 200, replace=False):
        e = np.zeros(len(flat))
        e[i] = 1e-5
        assert abs((loss(flat + e) - loss(flat - e)) / 2e-5 - whole[i]) < 1e-6
    assert loss(lm.train(flat, side, context, y)) < loss(flat)


def test_ordered_text_scores_above_shuffled(spark):
    rng = random.Random(5)
    cycle = "the cat sat on a mat and then it ran far away home".split()
    rows = []
    for i in range(400):
        at = rng.randrange(len(cycle))
        rows.append((i, " ".join(cycle[(at + j) % len(cycle)] for j in range(120))))
    for i in range(400, 440):
        rows.append((i, " ".join(rng.choice(cycle) for _ in range(120))))
    rows += [(1000, None), (1001, ""), (None, "the cat"), (1002, "zzz " * 5), (0, rows[0][1])]
    got = {}
    for r in lm.lm_report(spark.createDataFrame(rows, "doc_id long, text string")).collect():
        got.setdefault(r.doc_id, []).append(r)
    means = lambda ids: sorted(got[i][0].mean_log_likelihood for i in ids)
    assert means(range(400))[20] > means(range(400, 440))[-1]
    assert (got[1000][0].n_tokens, got[1000][0].log_likelihood, got[1001][0].mean_log_likelihood) == (0, 0.0, None)
    assert got[0][0] == got[0][1] and np.isfinite(got[1002][0].log_likelihood)
    assert lm.lm_report(spark.createDataFrame([], "doc_id long, text string, h string, n string")).count() == 0


def zipf(rng, n):
    return " ".join(f"w{int(rng.paretovariate(0.7))}" for _ in range(n))


def slow_scores(rows, flat, side, top):
    """Scores by the definition: softmax by softmax, word by word; ``top``: words with a code of their own, in order."""
    e, a, b, c, d, m, n = (x.astype(np.float64) for x in lm.parts_of(flat, side))
    hasher = WordHasher(ascii_nonword_separators())
    hash_of = lambda w: hasher.words(w.encode())[2][0]
    texts = [(i, re.findall("[a-z0-9]+", (t or "").lower())) for i, t in rows]
    counts = Counter(w for _, ws in texts for w in ws)
    own = lm.own_codes(side)
    code = {w: k for k, w in enumerate(top)} | {w: own + int(hash_of(w) >> np.uint64(33)) % (side * side - own) for w in counts if w not in top}
    mass = Counter()
    for w, k in counts.items():
        mass[code[w]] += k
    soft = lambda z: np.exp(z - z.max()) / np.exp(z - z.max()).sum()

    def words(ws, i):
        near = [code[ws[j]] if 0 <= j < len(ws) else side * side for j in (i - 2, i - 1, i + 1, i + 2)]
        h = np.tanh(np.concatenate([e[k] for k in near]) @ a + b)
        p = soft(h @ c + d)
        inner = {}
        return lambda w: p[code[w] // side] * inner.setdefault(code[w] // side, soft(h @ m[code[w] // side] + n[code[w] // side]))[code[w] % side] * counts[w] / mass[code[w]]

    out = [(i, len(ws), sum(math.log(words(ws, k)(w)) for k, w in enumerate(ws))) for i, ws in texts]
    some, one = words(texts[3][1], 5), {k: w for w, k in code.items()}
    return out, sum(some(w) for w in counts), sum(some(w) * mass[k] / counts[w] for k, w in one.items()), len(code) > len(one)


def test_scores_equal_the_definition_whatever_the_partitions(spark, monkeypatch):
    monkeypatch.setattr(lm, "KNOWN", 40)
    monkeypatch.setattr(lm, "SHARD", 2500)
    monkeypatch.setattr(lm, "SLICE", 64)
    rng = random.Random(4)
    rows = [(i, zipf(rng, rng.randrange(1, 120))) for i in range(120)] + [(200, None), (201, zipf(rng, 900))]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    encoded, counts, codes, flat = lm.fit(df.repartition(3))
    names = {int(WordHasher(ascii_nonword_separators()).words(w.encode())[2][0]): w for _, t in rows for w in (t or "").split()}
    top = [names[int(h)] for h in codes.hashes[: codes.own]]
    assert encoded.where("size(rare) > 0").count() > 0
    want, of_words, of_codes, shares = slow_scores(rows, flat, codes.side, top)
    assert shares and of_words == pytest.approx(of_codes) and of_words <= 1 + 1e-9
    sets = {i: set((t or "").split()) for i, t in rows}
    for parts in (1, 5):
        got = {r.doc_id: r for r in lm.lm_report(df.repartition(parts)).collect()}
        for i, n, s in want:
            assert got[i].n_tokens == n and got[i].log_likelihood == pytest.approx(s, rel=1e-4, abs=1e-4)
            assert got[i].n_unshared == sum(all(w not in other for j, other in sets.items() if j != i) for w in (dict(rows)[i] or "").split())


def test_probabilities_sum_to_one():
    rng = np.random.default_rng(2)
    side = 8
    flat = lm.new_network(side)
    context = np.repeat(rng.integers(0, side * side + 1, (1, 4)), side * side, axis=0)
    assert np.exp(lm.log_probabilities(lm.parts_of(flat, side), context, np.arange(side * side), side)).sum() == pytest.approx(1, abs=1e-5)
    hashes = (np.arange(1, 500, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)).astype(np.uint64)
    counts = np.arange(499, 0, -1).astype(float)
    own = lm.own_codes(side)
    shared = ((hashes >> np.uint64(33)) % np.uint64(side * side - own)).astype(np.int64)
    mass = np.bincount(shared[own:], counts[own:], side * side - own)
    code, inside, unknown = lm.Codes(side, hashes[:300], counts[:300], mass)(hashes)
    inside = inside + np.where(unknown, np.log(counts), 0)
    assert np.allclose(np.bincount(code, np.exp(inside))[np.unique(code)], 1) and unknown.sum() == 199


def test_lookup():
    rng = np.random.default_rng(1)
    h = np.unique(rng.integers(0, 1 << 63, 5000, dtype=np.uint64) << np.uint64(1))
    asked = np.concatenate([h[::3], h[:50] + np.uint64(1)])
    assert Lookup(h)(asked).tolist() == [*range(0, len(h), 3), *[-1] * 50] and Lookup(h[:0])(asked).tolist() == [-1] * len(asked)


def test_codes_grow_with_the_words():
    sides = [lm.side_of(10**k) for k in range(9)]
    assert sides == sorted(sides) and sides[0] == lm.LEAST_SIDE and sides[5] == 32 and sides[8] == lm.MOST_SIDE


def test_long_text(spark):
    rows = [(1, "one two three four " * 20_000), (2, "one two three four")]
    got = {r.doc_id: r for r in lm.lm_report(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[1].n_tokens == 80_000 and np.isfinite(got[1].log_likelihood)


def test_a_case_scores_alike_whatever_cases_are_beside_it():
    one_thread()  # as in a task
    rng = np.random.default_rng(6)
    side = 16
    w = lm.parts_of(lm.new_network(side), side)
    context, y = rng.integers(0, side * side + 1, (700, 2 * lm.SIDE)), rng.integers(0, side * side, 700)
    whole = lm.log_probabilities(w, context, y, side)
    for size in (1, 2, 5, 13, 50, 333):
        for at in (0, 7, 200, 350):
            some = rng.permutation(700)[at : at + size]
            assert np.array_equal(lm.log_probabilities(w, context[some], y[some], side), whole[some])


def test_repeated_texts_score_alike_wherever_they_stand(spark):
    rng = random.Random(9)
    texts = [zipf(rng, rng.randrange(1, 300)) for _ in range(60)]
    rows = [(i, rng.choice(texts)) for i in range(400)]
    got = lm.lm_report(spark.createDataFrame(rows, "doc_id long, text string").repartition(5)).collect()
    scores = {}
    for r in got:
        scores.setdefault(dict(rows)[r.doc_id], set()).add(r.log_likelihood)
    assert len(got) == 400 and {len(x) for x in scores.values()} == {1}


def test_powers_of_a_batch_are_taken_at_once(monkeypatch):
    """Training costs products by group alone: powers and errors, and the steps, take the whole batch, however many groups it has."""
    side, calls = 32, Counter()

    class Counted:
        def __getattr__(self, name):
            calls[name] += 1
            return getattr(np, name)

    rng = np.random.default_rng(3)
    context, y = rng.integers(0, side * side + 1, (2 * lm.MOST_BATCH, 2 * lm.SIDE)), rng.integers(0, side * side, 2 * lm.MOST_BATCH)
    monkeypatch.setattr(lm, "STEPS", 2)
    monkeypatch.setattr(lm, "np", Counted())
    lm.train(lm.new_network(side), side, context, y)
    assert (calls["exp"], calls["sqrt"]) == (4, 14)
