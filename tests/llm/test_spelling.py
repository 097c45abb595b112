import random
import re
import zlib
from collections import Counter

import pytest

from tallyforge.llm import spelling


def brute(rows):
    seen = Counter()
    for i, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % 97 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            seen[run] += 1
    n = {w: c for w, c in seen.items() if len(w) >= 5 and c >= 3}

    def near(a, b):
        if len(a) == len(b):
            return sum(x != y for x, y in zip(a, b, strict=True)) == 1
        a, b = sorted((a, b), key=len)
        return len(b) - len(a) == 1 and any(b[:k] + b[k + 1 :] == a for k in range(len(b)))

    forms, out = {}, []
    for w in n:
        partners = [x for x in n if near(w, x)]
        best = min(partners, key=lambda x: (-n[x], x), default=None)
        forms[w] = (len(partners), best if best is not None and n[best] >= 2 * n[w] else None)
    for w in n:
        root = w
        while forms[root][1] is not None:
            root = forms[root][1]
        out.append((w, forms[w][1], root, n[w], forms[w][0], n.get(forms[w][1])))
    return sorted(out)


def corpus(seed):
    rng = random.Random(seed)
    stems = ["".join(rng.choice("abcé") for _ in range(rng.randrange(4, 9))) for _ in range(60)] + ["aaaaa", "aaaaaa", "aaaaaaa", "×÷Études", "straße", "x" * 300]
    rows = []
    for i in range(300):
        words = []
        for _ in range(rng.randrange(0, 60)):
            w = rng.choice(stems[: 1 + int(len(stems) * rng.random() ** 2)])
            if rng.random() < 0.3:
                k = rng.randrange(len(w))
                w = w[:k] + rng.choice(["", "a", "b", w[k] + "c"]) + w[k + 1 :]
            words.append(w.upper() if rng.random() < 0.1 else w.capitalize() if rng.random() < 0.1 else w)
        rows.append((i, rng.choice([" ", ", ", "1", "İ", "K"]).join(words)))
    return rows + [(None, "null identity null identity null identitx"), (400, None), (401, ""), (402, "longtext " * 30000), rows[0], rows[0], rows[0]]


@pytest.mark.parametrize("block", [spelling.BLOCK, 7])
def test_against_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(spelling, "BLOCK", block)
    monkeypatch.setattr(spelling.partners, "__defaults__", (block,))
    rows = corpus(block)
    df = spark.createDataFrame([(*r, "w") for r in rows], "doc_id long, text string, word string")
    want = brute(rows)
    assert sorted(map(tuple, spelling.variants(df).collect())) == want
    assert len(want) > 200 and sum(w[1] is not None and w[2] != w[1] for w in want) > 5
    assert spelling.variants(df.limit(0)).count() == 0


def test_merge_skips_nothing():
    rng = random.Random(2)
    for _ in range(2000):
        lists = [sorted(rng.sample(range(40), rng.randrange(1, 25))) for _ in range(rng.randrange(1, 9))]
        starts, least = [rng.randrange(0, 3) for _ in lists], rng.randrange(1, 6)
        seen = Counter(x for l, s in zip(lists, starts, strict=True) for x in l[s:])
        assert spelling.merged(lists, starts, least) == sorted(x for x, c in seen.items() if c >= least)


def test_the_bound_holds_for_every_edit():
    """Words one edit apart always meet: every edit of random words is found, and nothing else."""
    rng = random.Random(3)
    for _ in range(400):
        w = "".join(rng.choice("ab") for _ in range(rng.randrange(6, 12)))
        k = rng.randrange(len(w))
        for other in {w[:k] + w[k + 1 :], w[:k] + ("b" if w[k] == "a" else "a") + w[k + 1 :]}:
            a, b = (w, other) if len(w) > len(other) or w < other else (other, w)
            found = 0
            for side in (0, 1):
                half = len(b) // 2
                part = lambda x: x[:half] if side == 0 else x[half + len(x) - len(b) :]  # noqa: B023, E731
                if part(a) == part(b):
                    shard = spelling.Shard(f"0:0:{len(b)}:{side}:{part(b)}")
                    shard.add(b, 1)
                    shard.look_up(a, 1)
                    found += len(shard.found) == 2
            assert found == 1, (a, b)
