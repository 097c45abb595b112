import random
import re
from collections import Counter
from itertools import permutations

from tallyforge.llm import audit_filters


def brute(docs, labels):
    good, toxic = {i for i, q, _ in labels if q == 1}, {i for i, _, t in labels if t == 1}
    least, masks = {}, []
    for i, text, *_ in docs:
        if i is not None:
            least[text or ""] = min(i, least.get(text or "", i))
    for i, text, lang, *_ in docs:
        text = text or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", text)
        fails = {"A": len(w) < 200, "B": 100 * len(set(w)) < 50 * len(w), "C": 100 * len(re.findall("[A-Z]", text)) > 3 * len(text), "D": bool(re.search(r"[#$%&*|]", text)), "E": i is not None and least[text] < i}
        masks.append((lang or "", i, {f for f, x in fails.items() if x}))
    rows = []
    for part in {m[0] for m in masks}:
        removed_sum = Counter()
        here = [m for m in masks if m[0] == part]
        for order in permutations("ABCDE"):
            left = here
            for k, f in enumerate(order):
                removed = [m for m in left if f in m[2]]
                left = [m for m in left if f not in m[2]]
                removed_sum[f] += len(removed)
                redundant = sum(f in m[2] and bool(m[2] & set(order[:k])) for m in here)
                rows.append([part, "".join(order), k + 1, len(left), len(removed), redundant, sum(m[2] == {f} for m in here), sum(m[1] in good for m in removed), sum(m[1] in toxic for m in removed), f])
        for r in rows:
            if r[0] == part and isinstance(r[-1], str):
                r[-1] = removed_sum[r[-1]]
    return sorted(map(tuple, rows))


def corpus(seed):
    rng = random.Random(seed)
    words = [f"w{k}" for k in range(150)]
    rows = []
    for i in range(160):
        kind = rng.randrange(5)
        n = rng.choice([0, 1, 150, 199, 200, 201, 260])
        text = rng.choice([" ", "\n", "\t \x0b", "\x0c\r"]).join(rng.choice(words[: 150 if kind else 100]) for _ in range(n))
        text += rng.choice(["", "", " #", " | x", " ABCDEFGHIJ" * rng.randrange(1, 9), " ", " \U0001f600 É"])
        if kind == 4 and rows:
            text = rng.choice(rows)[1]
        rows.append((rng.randrange(120), text, rng.choice(["en", "de", "", None]), "x"))
    rows += [(None, None, None, "x"), (None, "", "en", "x"), (500, None, "en", "x"), (501, "", "fr", "x"), rows[3], rows[3], (None, rows[5][1], "en", "x"), (502, "longer " * 30000 + "Q", "en", "x")]
    return rows


def test_against_brute_force(spark):
    rows = corpus(1)
    labels = [(rng_id, q, t) for rng_id, q, t in [(k, k % 3 % 2, k % 5 == 0) for k in range(0, 130, 2)]] + [(4, 1, 1), (4, 0, None), (6, None, None), (None, 1, 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, th string")
    told = spark.createDataFrame([(i, q, None if t is None else int(t)) for i, q, t in labels], "doc_id long, quality int, toxic int")
    got = audit_filters.filter_report(docs, told)
    assert sorted(tuple(r[c] for c in ("part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")) for r in got.collect()) == brute(rows, [x for x in labels if x[0] is not None])


def test_nothing_to_audit(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, lang string")
    told = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert audit_filters.filter_report(docs, told).count() == 0
    one = audit_filters.filter_report(spark.createDataFrame([(1, None, None)], docs.schema), told)
    assert one.count() == 600 and {r.part for r in one.collect()} == {""}
