import hashlib

import pytest
from pyspark.sql import functions as F

from tallyforge.llm import lines, mixing


def test_lines_by_hand(spark):
    body = "a line of its own that is long enough to matter, number"
    rows = [(i, f"{body} {i}\n  shared notice \nlast {i}", f"s{i % 6}", "x") for i in range(12)]
    rows += [(100 + i, "few sites", f"s{i % 4}", "x") for i in range(8)]
    rows += [(200, "shared notice", "s1", "x"), (201, None, "s1", "x"), (202, "", None, "x"), (None, f"{body} n\nshared notice", None, "x"), (0, rows[0][1], "s0", "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, pos string")
    got = {}
    for r in lines.clean(df).collect():
        got.setdefault(r.doc_id, []).append(r)
    assert all(got[i][0].tf_text == f"{body} {i}\nlast {i}" and got[i][0].tf_removed == 1 for i in range(12))
    assert len(got[0]) == 2 and got[0][0] == got[0][1]
    assert got[100][0].tf_text == "few sites" and got[100][0].tf_flagged == 0
    assert (got[200][0].tf_text, got[200][0].tf_flagged, got[200][0].tf_removed) == ("", 1, 1)
    assert got[201][0].tf_text is None and got[202][0].tf_text == "" and got[None][0].tf_text == f"{body} n"
    assert lines.clean(df).columns[:4] == df.columns
    r = {x.doc_id: x for x in lines.line_report(df).collect()}
    assert r[201].n_lines == 0 and r[5].kept_sha256 == hashlib.sha256(f"{body} 5\nlast 5".encode()).hexdigest()
    assert lines.line_report(df.limit(0)).count() == 0


def test_copies_have_no_exemption(spark):
    notices = [f"notice {k} that many sites print under every page" for k in range(4)]
    block = "\n".join(notices)
    rows = [(i, f"own sentence {i}\n{block}", f"s{i}") for i in range(6)]
    rows += [(10, f"short\n{block}", "s1"), (11, f"short\n{block}", "s2")]
    rows += [(20, f"{notices[1]}\n\n {notices[2]}", "s3"), (21, f"{notices[2]}\n{notices[0]}", "s4"), (22, block, "s5"), (None, block, None)]
    rows += [(30, f"{notices[0]}\n{notices[1]}\n{notices[3]}", "s6"), (40, f"{notices[0]}\nmiddle\n{notices[1]}", "s7")]
    got = {r.doc_id: r for r in lines.clean(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()}
    assert all(got[i].tf_text == f"own sentence {i}" and got[i].tf_removed == 4 for i in range(6))
    assert got[10].tf_text == got[11].tf_text == "short" and got[40].tf_text == "middle"
    assert [(got[i].tf_text, got[i].tf_removed, got[i].tf_flagged) for i in (20, 21, 22, 30, None)] == [("", 2, 2), ("", 2, 2), ("", 4, 4), ("", 3, 3), ("", 4, 4)]


def test_exact_counts_decide_near_the_threshold(spark):
    rows = [(i, f"line {i % 40}", f"s{i}") for i in range(200)] + [(1000 + i, f"line {i % 39}", f"t{i}") for i in range(39)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    table = lines.line_table(df)
    assert lines.boilerplate(table, 6).count() == 39 and lines.boilerplate(table, 5).count() == 40


def test_raking_meets_the_marginals(spark):
    cells = spark.createDataFrame([("a", "x", 0, 90), ("a", "y", 1, 10), ("b", "x", 1, 20), ("b", "y", 0, 5), ("b", "x", 0, 7), ("a", "x", 1, 3)], "source string, lang string, topic int, tokens long")
    share = lambda key, pairs: spark.createDataFrame(pairs, f"{key} {'int' if key == 'topic' else 'string'}, share double")
    want = {"source": share("source", [("a", 0.4), ("b", 0.6)]), "lang": share("lang", [("x", 0.5), ("y", 0.5)]), "topic": share("topic", [(0, 0.3), (1, 0.7)])}
    out = mixing.rake(cells, want)
    with pytest.raises(ArithmeticError, match="not settled"):
        mixing.rake(cells, want, 2)
    for key, table in want.items():
        got = {r[0]: r[1] for r in out.groupBy(key).agg(F.sum("w")).collect()}
        assert all(abs(got[r[0]] - r[1]) < 1e-3 for r in table.collect())


def test_mixing_cases(spark):
    rows = [(i, "alpha beta gamma " * (1 + i % 5), "en" if i % 3 else None, f"s{i % 4}", "x") for i in range(600)]
    rows += [(1000, None, "en", "s1", "x"), (1001, " \n ", "en", "s1", "x"), (None, "delta", None, None, "x"), (1, rows[1][1], "en", "s1", "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, topic string")
    out = mixing.mixing_report(df).collect()
    ids = [r.doc_id for r in out]
    assert 1000 not in ids and 1001 not in ids and all(0 < r.p <= 1 for r in out)
    tokens = sum(len((t or "").split()) for _, t, *_ in rows)
    assert abs(sum(r.tokens for r in out) / tokens - mixing.SHARE) < 0.12
    assert sorted(map(str, out)) == sorted(map(str, mixing.mixing_report(df).collect()))
    kept = mixing.sample(df)
    assert kept.columns[:5] == df.columns
    assert mixing.mixing_report(df.limit(0)).count() == 0
    given = mixing.mix(df, topic=F.col("doc_id") % 2)
    assert {r.topic for r in given.select("topic").distinct().collect()} == {0, 1}


def test_lines_against_loops(spark):
    """The report against plain loops over the sites of each line."""
    import random

    rng = random.Random(2)
    pool = [f"notice {k} of many" for k in range(6)] + [f"rare line {k}" for k in range(30)]
    rows = [(i, "\n".join(rng.choice(["", " ", "\t"]) + rng.choice(pool) + rng.choice(["", "  "]) if rng.random() < 0.9 else "" for _ in range(rng.randrange(0, 7))), rng.choice([None, *[f"s{k}" for k in range(8)]])) for i in range(160)]
    rows += [(200, None, "s1")]
    sites = {}
    for _, t, s in rows:
        for line in (t or "").split("\n"):
            if line.strip():
                sites.setdefault(line.strip(), set()).add(s or "")
    flagged = {line for line, s in sites.items() if len(s) >= lines.MIN_SITES}
    got = {r.doc_id: r for r in lines.line_report(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()}
    for i, t, _ in rows:
        raw = [] if t is None else t.split("\n")
        hits = [x for x in raw if x.strip() in flagged]
        left = "\n".join(x for x in raw if x.strip() not in flagged)
        want = (len(raw), len(hits), len(hits), hashlib.sha256(left.encode()).hexdigest())
        assert (got[i].n_lines, got[i].n_flagged, got[i].n_removed, got[i].kept_sha256) == want, i
    assert len(flagged) > 5


def test_clashing_columns_and_long_texts(spark):
    long = "\n".join(f"own line {i}" for i in range(25_000))
    rows = [(i, f"own {i}\nshared by all", f"s{i}", "en", 9, "x", 1, 2) for i in range(8)] + [(9, long + "\nshared by all", "s9", "en", 9, "x", 1, 2)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string, n_chars long, tf_text string, tf_tokens int, `a.b` int")
    out = lines.remove(df)
    got = {r.doc_id: r for r in out.collect()}
    assert out.columns == df.columns and got[3].text == "own 3" and got[3].n_chars == 5 and got[9].text == long
    assert lines.clean(df).columns == [*df.columns, "tf_text", "tf_flagged", "tf_removed"]
    drawn = mixing.sample(df)
    assert drawn.columns == [*df.columns, "tf_topic", "tf_tokens", "tf_p", "tf_weight"] and all(0 < r[-2] <= 1 for r in drawn.collect())
