"""Scores of classification systems over fixed label sets: confusion base, label and task statistics, strata.

One aggregate, ``confusion``, feeds every score; later steps read counts, whose number does not grow with the rows.
Prediction -1 is invalid: wrong, and a miss of the true label, but never a label of its own.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyforge.operators.prepare import label_spine


def violations(gold: DataFrame, predictions: DataFrame, tasks: DataFrame) -> DataFrame:
    """(rule, example_id) of everything that keeps predictions from being scored against gold."""
    compared = ["agreement_id", "task_id", "label", "split"]
    g = gold.groupBy("example_id").agg(F.count("*").alias("g_n"), *[F.first(c).alias(f"g_{c}") for c in compared])
    p = predictions.groupBy("example_id").agg(F.count("*").alias("p_n"), *[F.first(c).alias(f"p_{c}") for c in compared], F.min("prediction").alias("low"), F.max("prediction").alias("high"))
    both = g.join(p, "example_id", "full_outer").join(F.broadcast(tasks.select(F.col("task_id").alias("g_task_id"), F.size("answers").alias("choices"))), "g_task_id", "left")
    here = F.col("g_n").isNotNull() & F.col("p_n").isNotNull()
    rules = [
        ("gold_repeated", F.col("g_n") > 1), ("prediction_repeated", F.col("p_n") > 1), ("missing", F.col("p_n").isNull()), ("foreign", F.col("g_n").isNull()),
        *[(f"{c}_differs", here & ~F.col(f"g_{c}").eqNullSafe(F.col(f"p_{c}"))) for c in compared],
        ("prediction_out_of_range", here & ((F.col("low") < -1) | (F.col("high") >= F.col("choices")) | F.col("low").isNull())),
    ]
    names = F.filter(F.array(*[F.when(c, F.lit(n)) for n, c in rules]), lambda r: r.isNotNull())
    return both.select(F.explode(names).alias("rule"), "example_id")


def confusion(predictions: DataFrame, keys: list[str] = []) -> DataFrame:  # noqa: B006
    """Counts by keys, task, label and prediction; a row without a key's value belongs to the stratum 'unknown'."""
    text = {n for n, t in predictions.dtypes if t == "string"}
    named = [F.coalesce(k, F.lit("unknown")).alias(k) if k in text else F.col(k) for k in keys]
    return predictions.groupBy(*named, "task_id", "label", "prediction").agg(F.count("*").alias("n"))


def label_stats(counts: DataFrame, tasks: DataFrame, keys: list[str] = []) -> DataFrame:  # noqa: B006
    """Precision, recall and F1 of every valid label, zeros where a denominator is zero.

    Each count goes to its label's row and to its prediction's row, so no join of labels with predictions is needed. A
    task's labels, few, meet as a map, from which every valid label takes its counts.
    """
    n, zero = F.col("n"), F.lit(0).cast("long")
    hit = F.col("label") == F.col("prediction")
    parts = F.array(
        F.struct(F.col("label").alias("label"), F.when(hit, n).otherwise(zero).alias("tp"), zero.alias("fp"), F.when(hit, zero).otherwise(n).alias("fn"), F.when(F.col("prediction") == -1, n).otherwise(zero).alias("invalid")),
        F.struct(F.when(hit, F.lit(None)).otherwise(F.col("prediction")).alias("label"), zero.alias("tp"), n.alias("fp"), zero.alias("fn"), zero.alias("invalid")),
    )
    names = ["tp", "fp", "fn", "invalid"]
    sums = counts.select(*keys, "task_id", F.inline(parts)).where("label >= 0").groupBy(*keys, "task_id", "label").agg(*[F.sum(c).alias(c) for c in names])
    held = sums.groupBy(*keys, "task_id").agg(F.map_from_entries(F.collect_list(F.struct("label", F.struct(*names)))).alias("m"))
    every = F.inline(F.transform("answers", lambda a, i: F.struct(i.alias("label"), *[F.coalesce(F.col("m")[i][c], zero).alias(c) for c in names])))
    s = held.join(tasks.select("task_id", "question", "category", "answers"), "task_id").select(*keys, "task_id", "question", "category", every)

    def ratio(a, b):
        return F.when(b == 0, F.lit(0.0)).otherwise(a / b)

    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    return s.select(*keys, "task_id", "question", "category", "label", *names, (tp + fn).alias("support"), ratio(tp, tp + fp).alias("precision"), ratio(tp, tp + fn).alias("recall"), ratio(2 * tp, 2 * tp + fp + fn).alias("f1"))


def _by_task(stats: DataFrame, keys: list[str], *more: Column) -> DataFrame:
    sums = [F.sum("support").alias("n"), F.sum("tp").alias("correct"), F.sum("invalid").alias("invalid"), F.avg("f1").alias("macro_f1")]
    return stats.groupBy(*keys, "task_id", "question", "category").agg(*sums, *more)


def task_metrics(counts: DataFrame, tasks: DataFrame, keys: list[str] = []) -> DataFrame:  # noqa: B006
    """Per task: rows, accuracy, share of invalid predictions, macro F1 over all valid labels."""
    rows = _by_task(label_stats(counts, tasks, keys), keys)
    return rows.withColumns({"accuracy": F.col("correct") / F.col("n"), "invalid_rate": F.col("invalid") / F.col("n")})


def score(counts: DataFrame, tasks: DataFrame, cover: DataFrame, keys: list[str] = []) -> DataFrame:  # noqa: B006
    """The report, one row per key: primary and parent macro F1 over eligible tasks, pooled accuracy, rare labels.

    The counts are read once; labels become tasks, tasks become questions, questions the report. Without keys and
    without rows the report is one row with n = 0.
    """
    stats = label_stats(counts, tasks, keys).join(cover.select("task_id", "eligible", "rare_labels"), "task_id")
    rare = F.array_contains("rare_labels", F.col("label"))
    recall = F.when(rare & (F.col("support") > 0), F.col("recall"))
    m = _by_task(stats, keys, F.first("eligible").alias("eligible"), F.sum(F.when(rare, F.col("support"))).alias("rare_n"), F.sum(F.when(rare, F.col("tp"))).alias("rare_correct"), F.sum(recall).alias("recalls"), F.count(recall).alias("recalled"))
    total = ["n", "correct", "invalid", "rare_n", "rare_correct", "recalls", "recalled"]
    f1 = F.when(F.col("eligible"), F.col("macro_f1"))
    q = m.groupBy(*keys, "question").agg(F.sum(f1).alias("f1"), F.count(f1).alias("eligible_tasks"), F.avg(f1).alias("parent"), *[F.sum(c).alias(c) for c in total])
    r = q.groupBy(*keys).agg(F.sum("f1").alias("f1"), F.coalesce(F.sum("eligible_tasks"), F.lit(0)).alias("eligible_tasks"), F.avg("parent").alias("parent_macro_f1"), *[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in total])
    return r.select(
        *keys, F.try_divide("f1", "eligible_tasks").alias("question_macro_f1"), F.try_divide("correct", "n").alias("accuracy"), F.try_divide("invalid", "n").alias("invalid_rate"), "n", "eligible_tasks", "parent_macro_f1",
        "rare_n", F.try_divide("rare_correct", "rare_n").alias("rare_accuracy"), F.try_divide("recalls", "recalled").alias("rare_macro_recall"),
    )


def without_overlap(predictions: DataFrame, flag: str = "train_overlap") -> DataFrame:
    """Rows that training has not seen; none at all where some row does not say whether it has."""
    silent = predictions.agg(F.count(F.when(F.col(flag).isNull(), 1)).alias("tf_silent"))  # one row
    return predictions.join(F.broadcast(silent), F.col("tf_silent") == 0).where(~F.col(flag)).drop("tf_silent")


def missing_tasks(predictions: DataFrame, cover: DataFrame) -> DataFrame:
    """Eligible tasks without a row."""
    return cover.where("eligible").select("task_id").join(predictions.select("task_id").distinct(), "task_id", "left_anti")


def category_metrics(counts: DataFrame, tasks: DataFrame, cover: DataFrame) -> DataFrame:
    """Every category of the schema: macro F1 over its eligible tasks, accuracy over all its rows."""
    m = task_metrics(counts, tasks).drop("category", "question")
    s = tasks.select("task_id", "category").join(cover.select("task_id", "eligible"), "task_id", "left").join(m, "task_id", "left")
    return s.groupBy("category").agg(F.avg(F.when(F.col("eligible"), F.col("macro_f1"))).alias("macro_f1"), F.try_divide(F.sum("correct"), F.sum("n")).alias("accuracy"), F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.count(F.when(F.col("eligible") & F.col("n").isNotNull(), 1)).alias("eligible_tasks"))


def majority(rows: DataFrame, tasks: DataFrame) -> DataFrame:
    """Per task the most frequent training label; the lowest on a tie, also where no label has support."""
    counts = rows.where("split = 'train'").groupBy("task_id", "label").agg(F.count("*").alias("n"))
    spine = label_spine(tasks).select("task_id", "label").join(counts, ["task_id", "label"], "left").fillna(0, ["n"])
    return spine.groupBy("task_id").agg(F.min(F.struct((-F.col("n")).alias("m"), "label")).alias("best")).select("task_id", F.col("best.label").alias("majority"))


def error_rows(predictions: DataFrame, cover: DataFrame, flagged: DataFrame | None = None, long_tokens: int = 2048) -> DataFrame:
    """Wrong rows with their tags, in a fixed order."""
    p = predictions.where("prediction <> label").join(cover.select("task_id", "rare_labels", "unsupported_labels"), "task_id")
    seen = F.lit(False)
    if flagged is not None:
        p = p.join(flagged.select("example_id", F.lit(True).alias("seen")), "example_id", "left")
        seen = F.coalesce("seen", F.lit(False))
    tags = [("invalid_format", F.col("prediction") == -1), ("rare_label", F.array_contains("rare_labels", F.col("label"))), ("unsupported_training_label", F.array_contains("unsupported_labels", F.col("label"))), ("long_passage", F.col("prompt_tokens") > long_tokens), ("train_lexical_overlap", seen)]
    return p.select("example_id", "task_id", "label", "prediction", F.filter(F.array(*[F.when(c, F.lit(n)) for n, c in tags]), lambda t: t.isNotNull()).alias("tags"))


def _rare(label: str) -> Column:
    return F.array_contains("rare_labels", F.col(label))


def rare_stats(counts: DataFrame, cover: DataFrame, keys: list[str] = []) -> DataFrame:  # noqa: B006
    """Rare rows, right ones, rows where a rare label was chosen, recall and precision (null without denominator)."""
    c = counts.join(cover.select("task_id", "rare_labels"), "task_id")
    hit = F.col("label") == F.col("prediction")
    total = lambda cond: F.coalesce(F.sum(F.when(cond, F.col("n"))), F.lit(0))
    a = c.groupBy(*keys).agg(total(_rare("label")).alias("rare_n"), total(_rare("label") & hit).alias("rare_correct"), total(_rare("prediction")).alias("rare_chosen"))
    return a.withColumns({"rare_incorrect": F.col("rare_chosen") - F.col("rare_correct"), "recall": F.try_divide("rare_correct", "rare_n"), "precision": F.try_divide("rare_correct", "rare_chosen")})


def paired_outcomes(left: DataFrame, right: DataFrame, cover: DataFrame) -> DataFrame:
    """(stratum, outcome, n) of two systems' rows side by side."""
    both = left.select("example_id", "task_id", "label", F.col("prediction").alias("l")).join(right.select("example_id", F.col("prediction").alias("r")), "example_id").join(cover.select("task_id", "rare_labels"), "task_id")
    lt, rt = F.col("l") == F.col("label"), F.col("r") == F.col("label")
    outcome = F.when(lt & rt, "both_correct").when(~lt & ~rt, "both_wrong").when(rt, "correction").otherwise("regression")
    return both.groupBy(F.when(_rare("label"), "rare").otherwise("nonrare").alias("stratum"), outcome.alias("outcome")).agg(F.count("*").alias("n"))


def rare_support_strata(predictions: DataFrame, cells: DataFrame, cover: DataFrame) -> DataFrame:
    """Rare rows by the training groups that support their label: 0, 1-2, 3 and more."""
    train = cells.where("split = 'train'").select("task_id", "label", F.col("agreements").alias("g"))
    rows = predictions.join(cover.select("task_id", "rare_labels"), "task_id").where(_rare("label")).join(train, ["task_id", "label"])
    bucket = F.when(F.col("g") == 0, "0").when(F.col("g") <= 2, "1-2").otherwise("3+")
    return rows.groupBy(bucket.alias("support")).agg(F.count("*").alias("n"), F.count(F.when(F.col("label") == F.col("prediction"), 1)).alias("correct"))


def prefix_resume(done: DataFrame, wanted: DataFrame, key: str = "example_id", position: str = "pos") -> DataFrame:
    """Where to go on: rows done, whether they are exactly the first of the wanted ones, and the next position."""
    d = done.groupBy(key).agg(F.count("*").alias("times"))
    w = wanted.select(key, position).join(d, key, "full_outer")
    return w.agg(F.coalesce(F.sum("times"), F.lit(0)).alias("done"), F.count(F.when(F.col("times").isNotNull(), 1)).alias("distinct_done"), F.max(F.when(F.col("times").isNotNull(), F.col(position))).alias("last"), F.count(F.when(F.col(position).isNull(), 1)).alias("foreign")).select("done", ((F.col("foreign") == 0) & (F.col("done") == F.col("distinct_done")) & (F.coalesce("last", F.lit(-1)) == F.col("done") - 1)).alias("is_prefix"), F.col("done").alias("next_position"))
