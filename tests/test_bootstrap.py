import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyforge.operators import audit, bootstrap

TASK = "task_id string, question string, subquestion string, category string, answers array<string>"
COVER = "task_id string, eligible boolean, rare_labels array<int>"


def systems(seed, clusters=9, rows=400):
    rng = random.Random(seed)
    out = []
    for i in range(rows):
        task = rng.choice(["a", "a", "b", "c", "d"])
        top = {"a": 4, "b": 2, "c": 3, "d": 2}[task]
        cluster = "only" if task == "d" else f"k{rng.randrange(clusters)}"  # task d is drawn with one cluster alone
        label = rng.randrange(top)
        for s in ("left", "right"):
            out.append((s, i, cluster, task, label, rng.choice([label, label, label, rng.randrange(-1, top)])))
    return out


def relations(spark, rows):
    frame = spark.createDataFrame(rows, "system string, example_id long, agreement_id string, task_id string, label int, prediction int")
    tasks = spark.createDataFrame([(t, t, t, t, list("wxyz")[:n]) for t, n in (("a", 4), ("b", 2), ("c", 3), ("d", 2))], TASK)
    cover = spark.createDataFrame([("a", True, [1]), ("b", True, [0, 1]), ("c", False, [2]), ("d", True, [])], COVER)
    return frame, tasks, cover


def plain(rows, weights, size):
    """Macro F1 of both systems, and what else is drawn, by loops over replicates."""
    out = {}
    for rep in range(size):
        pair, missing = [], False
        for s in ("left", "right"):
            fs = []
            for task, n in (("a", 4), ("b", 2), ("d", 2)):
                cm = np.zeros((n, n + 1))
                for system, _, cluster, t, label, prediction in rows:
                    if system == s and t == task:
                        cm[label, prediction] += weights.get((rep, cluster), 0)
                if cm.sum() == 0:
                    missing = True
                    continue
                f = [2 * cm[k, k] / d if (d := cm[k].sum() + cm[:, k].sum()) else 0.0 for k in range(n)]
                fs.append(np.mean(f))
            pair.append(np.mean(fs))
        out[rep] = (*pair, missing)
    return out


def test_vectors_against_loops(spark, monkeypatch):
    rows = systems(4)
    frame, tasks, cover = relations(spark, rows)
    drawn = bootstrap.hashed_weights(frame, 40, "s")
    weights = {(r.rep, r.agreement_id): r.w for r in drawn.collect()}
    want = plain(rows, weights, 40)
    assert any(m for *_, m in want.values()) and not all(m for *_, m in want.values())
    for held in (bootstrap.HELD, 2000):  # sums that are sent on early
        monkeypatch.setattr(bootstrap, "HELD", held)
        got = {r.rep: r for r in bootstrap.replicates(frame, drawn, tasks, cover).collect()}
        assert len(got) == 40 and all(abs(got[k].left - a) < 1e-12 and abs(got[k].right - b) < 1e-12 and got[k].tasks == (2 if m else 3) for k, (a, b, m) in want.items())
    left = frame.where("system = 'left'")
    assert tuple(bootstrap.missing_tasks(left, drawn, cover).first()) == (40, sum(m for *_, m in want.values()))
    for name, rare in (("accuracy", False), ("rare", True)):
        got = {r.rep: r for r in (bootstrap.rare_recall_replicates(frame, drawn, cover) if rare else bootstrap.accuracy_replicates(frame, drawn)).collect()}
        for rep in range(40):
            for s in ("left", "right"):
                mine = [(weights.get((rep, c), 0), p == y) for x, _, c, t, y, p in rows if x == s and (not rare or y in {"a": [1], "b": [0, 1], "c": [2], "d": []}[t])]
                assert abs(got[rep][s] - sum(w * ok for w, ok in mine) / sum(w for w, _ in mine)) < 1e-12, (name, rep, s)


def test_numpy_draws_give_the_published_interval(spark):
    rows = systems(5, rows=200)
    frame, tasks, cover = relations(spark, rows)
    drawn = bootstrap.numpy_weights(spark, [r[2] for r in rows if r[0] == "left"] and sorted({r[2] for r in rows}), 60, 42)
    want = plain(rows, {(r.rep, r.agreement_id): r.w for r in drawn.collect()}, 60)
    got = {r.statistic: r for r in audit.paired_bootstrap(frame, drawn, tasks, cover).collect()}
    diff = [b - a for a, b, _ in want.values()]
    assert [got["difference"].low, got["difference"].high] == pytest.approx(np.percentile(diff, [2.5, 97.5]).tolist()) and got["left"].replicates == 60


def test_a_comparison_stops_where_branches_do_not_fit(spark):
    rows = systems(6, rows=120)
    frame, tasks, cover = relations(spark, rows)
    drawn = bootstrap.hashed_weights(frame, 20, "s")
    said = frame.withColumns({"prompt_tokens_sha256": F.lit("p"), "valid_answers": F.array(F.lit("w")), "text_sha256": F.col("task_id")})
    control, other = (said.where(F.col("system") == s).drop("system") for s in ("left", "right"))
    pin = lambda h: spark.createDataFrame([("f", h)], "freeze_sha256 string, config_sha256 string")
    row = audit.gated_comparison(control, other, tasks, cover, drawn, (pin("c"), pin("c"))).first()
    reps = bootstrap.replicates(frame, drawn, tasks, cover)
    edges = {r.statistic: r for r in bootstrap.interval(reps).collect()}
    assert row.replicates == 20 and row.difference_low == pytest.approx(edges["difference"].low) and row.control_high == pytest.approx(edges["left"].high)
    rare = {"a": [1], "b": [0, 1], "c": [2], "d": []}
    chosen = [(p, y) for s, _, _, t, y, p in rows if s == "right" and p in rare[t]]
    assert row.other_rare_predictions == len(chosen) and row.other_incorrect_rare_predictions == sum(p != y for p, y in chosen)
    k = F.col("example_id")
    stops = {
        "not run on the same things": (control, other, (pin("c"), pin("d"))),
        "do not pair up": (control, other.where("example_id <> 7"), None),
        "not asked the same": (control, other.withColumn("text_sha256", F.when(k == 3, "x").otherwise(F.col("text_sha256"))), None),
        "nothing to draw from": (control.where("task_id = 'c'"), other.where("task_id = 'c'"), None),
    }
    for message, (a, b, pins) in stops.items():
        with pytest.raises(ValueError, match=message):
            audit.gated_comparison(a, b, tasks, cover, drawn, pins)


def test_sequences_count_places(spark):
    schema = "pos long, example_id long, prompt_tokens_sha256 string"
    left = spark.createDataFrame([(0, 1, "a"), (1, 2, "b"), (2, 3, None), (3, 4, "d")], schema)
    right = spark.createDataFrame([(0, 1, "a"), (1, 3, None), (2, 2, "b"), (4, 4, "d")], schema)
    got = {tuple(r) for r in audit.sequence_mismatches(left, right, "pos").collect()}
    assert got == {(1, 2, 3, "example_id"), (1, 2, 3, "prompt_tokens_sha256"), (2, 3, 2, "example_id"), (2, 3, 2, "prompt_tokens_sha256"), (3, 4, None, "position"), (4, None, 4, "position")}
    assert audit.sequence_mismatches(left, left, "pos").count() == 0 and audit.prompt_mismatches(left, right).count() == 0
