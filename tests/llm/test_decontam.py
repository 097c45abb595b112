import random

import numpy as np

from tallyforge.llm import decontam
from tallyforge.llm.common import WordHasher, ascii_nonword_separators


def test_common_subsequence_against_recursion():
    rng = random.Random(1)
    for _ in range(200):
        a, b = ([rng.choice("abcd") for _ in range(rng.randrange(0, 9))] for _ in range(2))
        table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                table[i + 1][j + 1] = table[i][j] + 1 if x == y else max(table[i][j + 1], table[i + 1][j])
        pairs = decontam.common_subsequence(a, b)
        assert len(pairs) == table[-1][-1] and all(a[i] == b[j] for i, j in pairs)
        assert pairs == sorted(pairs) and len({i for i, _ in pairs}) == len({j for _, j in pairs}) == len(pairs)


def test_vocabulary_lookup():
    rng = np.random.default_rng(0)
    words = np.unique(rng.integers(0, 1 << 63, 30_000, dtype=np.uint64))
    v = decontam.Vocabulary(words)
    assert (v(words) == (words % np.uint64(decontam.TERMS)).astype(np.int64)).all()
    assert (v(words + np.uint64(1))[~np.isin(words + np.uint64(1), words)] == -1).all()


def test_planted_passages(spark):
    rng = random.Random(4)
    vocabulary = ["".join(rng.choice("aeioulmnrst") for _ in range(rng.randrange(2, 8))) for _ in range(3000)]
    common = ["the", "of", "and", "is"]
    text = lambda n: " ".join(rng.choice(common) if rng.random() < 0.4 else rng.choice(vocabulary) for _ in range(n))
    items = [(i, text(rng.randrange(15, 60))) for i in range(30)]
    rows, want = [], {}
    for i in range(300):
        t = text(rng.randrange(1, 300))
        if i % 10 == 0:
            k, w = i // 10, items[i // 10][1].split()
            if i % 20 == 0:  # a paraphrase: some words changed, the answer kept
                for j in rng.sample(range(len(w) - decontam.ANSWER_WORDS), len(w) // 6):
                    w[j] = rng.choice(vocabulary)
            t = t + "\n" + " ".join(w).upper() + ". " + text(40)
            want[i] = [k]
        if i % 10 == 1:  # half of an item is no leak
            w = items[i // 10][1].split()
            t = t + " " + " ".join(w[: len(w) // 2])
        rows.append((i, t))
    rows += [(1000, None), (1001, ""), (None, items[3][1]), (0, rows[0][1])]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    bench = spark.createDataFrame([*items, (90, None), (91, "too short"), (92, items[5][1])], "item_id long, text string")
    got = {r.doc_id: r for r in decontam.decontamination_report(docs, bench).collect()}
    assert {i: r.item_ids for i, r in got.items() if r.contaminated} == want | {None: [3]}
    kept = decontam.drop_contaminated(docs, bench)
    assert kept.columns == docs.columns and kept.count() == 300 - len(want) + 2
    assert decontam.decontamination_report(docs.limit(0), bench).count() == 0
    assert decontam.decontamination_report(docs, bench.limit(0)).where("contaminated").count() == 0


def test_singular_values_equal_numpy(spark, monkeypatch):
    rng = random.Random(9)
    vocabulary = [f"v{i}" for i in range(60)]
    items = [(i, " ".join(rng.choice(vocabulary) for _ in range(20))) for i in range(8)]
    texts = [" ".join(rng.choice(vocabulary + ["outside"] * 30) for _ in range(rng.randrange(0, 150))) for _ in range(80)]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)] + [(99, None)], "doc_id long, text string")
    vocabulary_, weight, space, values = decontam.latent_space(df, items)
    hasher = WordHasher(ascii_nonword_separators())

    def rows(texts, size):
        for t in texts:
            w = t.split()
            for i in range(0, len(w), size):
                c = vocabulary_(decontam._terms(hasher, " ".join(w[i : i + size])))
                x = np.zeros(decontam.TERMS)
                for k, n in zip(*np.unique(c[c >= 0], return_counts=True), strict=True):
                    x[k] = (1 + np.log(n)) * weight[k]
                if x.any():
                    yield x / np.linalg.norm(x)

    a, b = np.array(list(rows(texts, decontam.PASSAGE))), np.array(list(rows([t for _, t in items], 1000)))
    passages = sum(-(-len(t.split()) // decontam.PASSAGE) for t in texts)
    frequency = (a > 0).sum(axis=0)
    known = frequency > 0
    assert np.allclose(weight[known], np.maximum(np.log((1 + passages) / (1 + frequency[known])), decontam.LEAST_IDF) ** decontam.POWER, rtol=1e-5)
    want = np.linalg.svd(np.concatenate([a, np.sqrt(len(a) / len(b)) * b]), compute_uv=False)
    assert np.allclose(values[:20], want[:20], rtol=0.03) and np.allclose(space.T @ space, np.eye(space.shape[1]), atol=1e-4)


def test_retrieval_finds_what_the_words_say(spark):
    rng = random.Random(6)
    vocabulary = ["".join(rng.choice("aeioulmnrst") for _ in range(rng.randrange(2, 8))) for _ in range(2000)]
    common = ["the", "of", "and", "is", "to", "in"]
    text = lambda n: [rng.choice(common) if rng.random() < 0.5 else rng.choice(vocabulary) for _ in range(n)]
    items = [(i, text(rng.randrange(10, 70))) for i in range(25)]
    rows, want = [], {}
    for i in range(200):
        w, k = text(rng.randrange(20, 250)), i % 25
        x = list(items[k][1])
        for j in rng.sample(range(len(x)), int(len(x) * rng.choice([0, 0.1, 0.2, 0.3]))):
            x[j] = rng.choice(vocabulary)
        if i % 2:
            at = rng.randrange(len(w))
            w[at:at] = x
            if decontam.verdict([y.encode() for y in items[k][1]], [y.encode() for y in x]) > 0:
                want[i] = k
        rows.append((i, w))
    docs = spark.createDataFrame([(i, " ".join(w)) for i, w in rows], "doc_id long, text string")
    bench = spark.createDataFrame([(i, " ".join(w)) for i, w in items], "item_id long, text string")
    got = {r.doc_id: r for r in decontam.decontamination_report(docs, bench).collect()}
    found = sum(k in got[i].item_ids for i, k in want.items())
    assert len(want) > 80 and found >= 0.98 * len(want), (found, len(want))
    assert sum(len(r.item_ids) for r in got.values()) - found <= 3
    for i, w in rows:  # whatever is found stands there by the words
        for k in got[i].item_ids:
            x, v = [y.encode() for y in items[k][1]], [y.encode() for y in w]
            assert any(decontam.verdict(x, v[max(0, a - len(x)) : a + decontam.PASSAGE + len(x)]) > 0 for a in range(len(v)))


def test_short_items_blocks_ties_and_clashing_columns(spark, monkeypatch):
    rng = random.Random(2)
    text = lambda n: " ".join(f"w{rng.randrange(500)}" for _ in range(n))
    items = [(i, text(20)) for i in range(12)] + [(50, "what is the answer"), (51, "What is the answer!"), (52, "seven words that stand whole in it"), (53, "?!")]
    rows = [(0, text(50)), (1, text(30) + " " + items[3][1] + " " + items[7][1] + " " + text(9)), (2, text(9) + " What, is: THE answer " + text(9)), (3, text(9) + " what is an answer " + text(9)), (4, "seven words that stand whole in it"), (5, "whole in it seven words that stand"), (6, text(30_000) + " " + items[5][1] + " " + text(30_000))]
    schema = "doc_id long, text string, tf_text string, tf_items int, `a.b` int"
    docs = spark.createDataFrame([(i, t, "x", 1, 2) for i, t in rows], schema)
    bench = spark.createDataFrame(items, "item_id long, text string")
    want = {0: [], 1: [3, 7], 2: [50, 51], 3: [], 4: [52], 5: [], 6: [5]}
    assert {r.doc_id: r.item_ids for r in decontam.decontamination_report(docs, bench).collect()} == want
    monkeypatch.setattr(decontam, "BLOCK_ITEMS", 4)
    assert {r.doc_id: r.item_ids for r in decontam.decontamination_report(docs, bench).collect()} == want
    kept = decontam.drop_contaminated(docs, bench)
    assert kept.columns == docs.columns and {r[0] for r in kept.collect()} == {0, 3, 5}


def test_every_accepted_place_has_a_passage_over_the_floor():
    rng, draw = random.Random(8), np.random.default_rng(8)
    accepted = 0
    for _ in range(400):
        size = rng.randrange(decontam.LEAST_WORDS, 90)
        item = [rng.randrange(60) for _ in range(size)]
        weight = draw.exponential(size=60) ** 3
        words = []
        for x in item:  # a stretched paraphrase: words left out, words of no weight put between
            words += ([x] if rng.random() < 0.85 else []) + [-1] * (rng.random() < 0.7)
        words = [-1] * rng.randrange(0, 60) + words + [-1] * rng.randrange(0, 60)
        if decontam.verdict(item, words) == 0:
            continue
        accepted += 1
        own = np.array([weight[x] if x >= 0 else 0.0 for x in words])
        _, start, end = decontam._windows(np.array([len(words)]))
        assert max(own[a:b].sum() for a, b in zip(start, end, strict=True)) >= decontam._floor(weight[item])
    assert accepted > 100


def test_stretched_short_and_common_items_against_all_pairs(spark):
    rng = random.Random(12)
    vocabulary = ["".join(rng.choice("aeioulmnrst") for _ in range(rng.randrange(2, 8))) for _ in range(2000)]
    common = ["the", "of", "and", "is", "to", "in", "a", "it"]
    plain = lambda: rng.choice(common) if rng.random() < 0.4 else rng.choice(vocabulary)
    items = [[plain() for _ in range(rng.choice([8, 9, 12, 20, 45, 70]))] for _ in range(20)] + [[rng.choice(common) for _ in range(24)]]
    docs = []
    for i in range(240):
        w, x = [plain() for _ in range(rng.randrange(0, 150))], list(items[i % len(items)])
        kind = i % 3
        if kind == 1:  # stretched to up to twice its length
            x = [y for z in x for y in ([z] if rng.random() < 0.6 else [z, rng.choice(vocabulary)])]
        if kind == 2:
            for j in rng.sample(range(len(x)), len(x) // 4):
                x[j] = rng.choice(vocabulary)
        at = rng.randrange(len(w) + 1)
        docs.append(w[:at] + x + w[at:])
    frame = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(docs)], "doc_id long, text string")
    bench = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(items)], "item_id long, text string")
    got = {(r.doc_id, i) for r in decontam.decontamination_report(frame, bench).collect() for i in r.item_ids}
    planted = {(d, d % len(items)) for d in range(len(docs))}

    def stands(d, n):
        x, v = [y.encode() for y in items[n]], [y.encode() for y in docs[d]]
        starts = decontam._windows(np.array([len(v)]))[1].tolist()
        return any(decontam.verdict(x, v[max(0, a - len(x)) : a + decontam.PASSAGE + len(x)]) > 0 for a in starts)

    want = {p for p in planted | got if stands(*p)}
    assert len(want & planted) > 150 and not got - want
    # a stated limit, without a bar: with a quarter of its words made rare ones, the item of nothing but common words is
    # outweighed by them; 4 of its 10 places are found
    hard = {p for p in want & planted if p[1] == len(items) - 1}
    rest = (want & planted) - hard
    print("found", len(got & rest), "of", len(rest), "and of common words", len(got & hard), "of", len(hard), sorted(rest - got))
    assert len(got & rest) >= 0.98 * len(rest)
