"""Publication audit: prediction records, checks of published rows against what they claim, comparisons, gates, receipts.

Every check gives the rows that break it, so an empty result means that all is well; ``require_empty`` and
``require_equal`` turn that into an error where a flow must stop.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyforge.functions.text import parse_answer
from tallyforge.operators import bootstrap, prepare, scoring
from tallyforge.sources.io import materialise, same_identity

#: What two branches must have in common, row by row, to be compared.
SHARED = ["prompt_tokens_sha256", "valid_answers", "text_sha256"]


def prediction_records(rows: DataFrame, tasks: DataFrame, flagged: DataFrame, raw: Column, prediction: Column | None = None) -> DataFrame:
    """The record of each predicted row: identity, parsed answer, what was asked, hash of the text, overlap, length.

    ``rows`` has the gold columns and text; ``raw`` is the output as it came, parsed here unless ``prediction`` is given.
    ``flagged`` holds the example_id of rows that training has seen.
    """
    seen = flagged.select("example_id").distinct().withColumn("tf_seen", F.lit(True))
    # texts are hashed before anything moves, and the few tasks go to the rows: one task may have most of them
    hashed = rows.withColumns({"raw_output": raw, "text_sha256": F.sha2("text", 256)})
    joined = hashed.join(F.broadcast(tasks.select("task_id", F.col("answers").alias("valid_answers"))), "task_id")
    parsed = prediction if prediction is not None else parse_answer(F.col("raw_output"), F.size("valid_answers"))
    joined = joined.withColumn("prediction", parsed.cast("int")).drop("text").join(seen, "example_id", "left")
    tokens = F.col("prompt_tokens")
    return joined.select(
        "example_id", "agreement_id", "task_id", "label", "split", "data_type", "prediction", "raw_output", "valid_answers",
        "text_sha256", F.coalesce("tf_seen", F.lit(False)).alias("train_overlap"), prepare.length_bucket(tokens).alias("length_bucket"), "prompt_tokens",
    )


def published_violations(gold: DataFrame, records: DataFrame, tasks: DataFrame, flagged: DataFrame) -> DataFrame:
    """(rule, example_id) of published records that do not agree with the gold rows they are about, or with themselves."""
    basic = scoring.violations(gold, records, tasks)
    seen = flagged.select("example_id").distinct().withColumn("tf_seen", F.lit(True))
    want = gold.select("example_id", "task_id", F.sha2("text", 256).alias("w_text_sha256"), F.col("data_type").alias("w_data_type"))
    want = want.join(F.broadcast(tasks.select("task_id", F.col("answers").alias("w_valid_answers"))), "task_id", "left").join(seen, "example_id", "left").withColumn("w_train_overlap", F.coalesce("tf_seen", F.lit(False))).drop("task_id")
    both = records.join(want, "example_id")
    rules = [(f"{c}_differs", ~F.col(c).eqNullSafe(F.col(f"w_{c}"))) for c in ("valid_answers", "text_sha256", "data_type", "train_overlap")]
    rules.append(("raw_output_differs", ~parse_answer(F.col("raw_output"), F.size("w_valid_answers")).eqNullSafe(F.col("prediction"))))
    names = F.filter(F.array(*[F.when(c, F.lit(n)) for n, c in rules]), lambda r: r.isNotNull())
    return basic.unionByName(both.select(F.explode(names).alias("rule"), "example_id").distinct())


def majority_violations(records: DataFrame, rows: DataFrame, tasks: DataFrame) -> DataFrame:
    """(example_id, prediction, majority) where a majority baseline's prediction is not what training counts give."""
    return records.select("example_id", "task_id", "prediction").join(scoring.majority(rows, tasks), "task_id", "left").where(~F.col("prediction").eqNullSafe(F.col("majority"))).select("example_id", "prediction", "majority")


def prompt_mismatches(left: DataFrame, right: DataFrame, shared: list[str] = SHARED[:1]) -> DataFrame:
    """(field, example_id) where two systems were not asked the same: a field differs, or one has no such row."""
    side = lambda df, s: df.select("example_id", F.lit(True).alias(f"in_{s}"), *[F.col(c).alias(f"{c}_{s}") for c in shared])
    both = side(left, "l").join(side(right, "r"), "example_id", "full_outer")
    rules = [("example_id", F.col("in_l").isNull() | F.col("in_r").isNull()), *[(c, F.col("in_l") & F.col("in_r") & ~F.col(f"{c}_l").eqNullSafe(F.col(f"{c}_r"))) for c in shared]]
    return both.select(F.explode(F.filter(F.array(*[F.when(c, F.lit(n)) for n, c in rules]), lambda x: x.isNotNull())).alias("field"), "example_id")


def sequence_mismatches(left: DataFrame, right: DataFrame, position: str, shared: list[str] = SHARED[:1]) -> DataFrame:
    """(position, left_id, right_id, field) where two sequences of records differ: another row at a place, a field, or no row.

    ``prompt_mismatches`` pairs rows by id; here the place counts, so rows in another order are mismatches too.
    """
    named = lambda df, s: df.select(F.col(position).alias("position"), F.col("example_id").alias(f"{s}_id"), F.lit(True).alias(f"in_{s}"), *[F.col(c).alias(f"{c}_{s}") for c in shared])
    both = named(left, "left").join(named(right, "right"), "position", "full_outer")
    paired = F.col("in_left") & F.col("in_right")
    rules = [("position", ~F.coalesce(paired, F.lit(False))), ("example_id", paired & ~F.col("left_id").eqNullSafe(F.col("right_id"))), *[(c, paired & ~F.col(f"{c}_left").eqNullSafe(F.col(f"{c}_right"))) for c in shared]]
    return both.select("position", "left_id", "right_id", F.explode(F.filter(F.array(*[F.when(c, F.lit(n)) for n, c in rules]), lambda x: x.isNotNull())).alias("field"))


def receipt(systems: DataFrame, tasks: DataFrame, cover: DataFrame) -> DataFrame:
    """(system, rows, question_macro_f1, accuracy, rare_correct, rare_n): what an audit of all systems passed on."""
    counts = scoring.confusion(systems, ["system"])
    scores = scoring.score(counts, tasks, cover, ["system"]).select("system", F.col("n").alias("rows"), "question_macro_f1", "accuracy")
    return scores.join(scoring.rare_stats(counts, cover, ["system"]).select("system", "rare_correct", "rare_n"), "system", "left").fillna(0, ["rare_correct", "rare_n"])


def compare_branches(control: DataFrame, other: DataFrame, tasks: DataFrame, cover: DataFrame) -> DataFrame:
    """One row: scores and rare diagnostics of two branches, rows that are not comparable, and the registered rule.

    The other branch is promising where its rare recall is strictly greater and its primary score is not lower.
    """
    both = control.withColumn("system", F.lit("control")).unionByName(other.withColumn("system", F.lit("other")))
    counts = scoring.confusion(both, ["system"])
    report = scoring.score(counts, tasks, cover, ["system"]).select("system", "question_macro_f1", "accuracy", "rare_accuracy")
    report = report.join(scoring.rare_stats(counts, cover, ["system"]).select("system", F.col("recall").alias("rare_recall"), "rare_correct", F.col("rare_chosen").alias("rare_predictions"), F.col("precision").alias("rare_precision"), F.col("rare_incorrect").alias("incorrect_rare_predictions")), "system")
    names = [c for c in report.columns if c != "system"]
    wide = report.agg(*[F.max(F.when(F.col("system") == s, F.col(c))).alias(f"{s}_{c}") for s in ("control", "other") for c in names])
    apart = prompt_mismatches(control, other, SHARED).agg(F.count("*").alias("mismatches"))
    promising = (F.col("other_rare_accuracy") > F.col("control_rare_accuracy")) & (F.col("other_question_macro_f1") >= F.col("control_question_macro_f1"))
    return wide.join(F.broadcast(apart)).withColumn("promising", F.coalesce(promising, F.lit(False)))  # single rows


def gated_comparison(control: DataFrame, other: DataFrame, tasks: DataFrame, cover: DataFrame, weights: DataFrame, pins: tuple[DataFrame, DataFrame] | None = None) -> DataFrame:
    """One row that is only made where two branches can be compared: scores, rare diagnostics, bootstrap intervals, the rule.

    Errors stop it: the branches' identities (``pins``, single rows: hashes of data, contexts, configuration) differ, rows do not
    pair up, something they were asked differs, there is nothing to draw from. The rows are counted once, by cluster; scores,
    rare answers and every replicate follow from those counts.
    """
    if pins is not None:
        require_equal(pins[0], pins[1], pins[0].columns, "the branches were not run on the same things")
    require_empty(bootstrap.pairing_violations(control, other), "the branches do not pair up")
    require_empty(prompt_mismatches(control, other, SHARED), "the branches were not asked the same")
    both = control.withColumn("system", F.lit("left")).unionByName(other.withColumn("system", F.lit("right")))
    require_empty(degenerate(both, cover), "nothing to draw from")
    cells = materialise(bootstrap.cluster_cells(both), "cells")
    counts = cells.groupBy("system", "task_id", "label", "prediction").agg(F.sum("n").alias("n"))
    report = scoring.score(counts, tasks, cover, ["system"]).select("system", "question_macro_f1", "rare_accuracy")
    report = report.join(scoring.rare_stats(counts, cover, ["system"]).select("system", F.col("recall").alias("rare_recall"), "rare_correct", F.col("rare_chosen").alias("rare_predictions"), F.col("rare_incorrect").alias("incorrect_rare_predictions")), "system")
    names = [c for c in report.columns if c != "system"]
    sides = {"left": "control", "right": "other"}
    wide = report.agg(*[F.max(F.when(F.col("system") == s, F.col(c))).alias(f"{name}_{c}") for s, name in sides.items() for c in names])
    limits = bootstrap.interval(bootstrap.cell_replicates(cells, bootstrap.vectors(weights), tasks, cover))
    edges = limits.agg(F.max("replicates").alias("replicates"), *[F.max(F.when(F.col("statistic") == s, F.col(c))).alias(f"{name}_{c}") for s, name in (sides | {"difference": "difference"}).items() for c in ("low", "high")])
    promising = (F.col("other_rare_accuracy") > F.col("control_rare_accuracy")) & (F.col("other_question_macro_f1") >= F.col("control_question_macro_f1"))
    return wide.join(F.broadcast(edges)).withColumn("promising", F.coalesce(promising, F.lit(False))).drop("control_rare_accuracy", "other_rare_accuracy")  # single rows


def rescore(gold: DataFrame, records: DataFrame, tasks: DataFrame, cover: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(report, error rows) of stored records, after a check that they can be scored; an error else."""
    require_empty(scoring.violations(gold, records, tasks), "records cannot be scored")
    flagged = records.where("train_overlap").select("example_id")
    return scoring.score(scoring.confusion(records), tasks, cover), scoring.error_rows(records, cover, flagged)


def require_empty(violations: DataFrame, message: str, shown: int = 5) -> None:
    """An error that names the first violations, if there are any."""
    first = violations.limit(shown).collect()
    if first:
        raise ValueError(f"{message}: " + "; ".join(str(r.asDict()) for r in first))


def require_equal(recorded: DataFrame, current: DataFrame, fields: list[str], message: str) -> None:
    """An error unless two single-row descriptions agree in the fields."""
    require_empty(same_identity(recorded.select(*fields), current.select(*fields)), message)


def open_test(record: DataFrame | None, current: DataFrame, fields: list[str]) -> None:
    """The gate before held-out data: a selection record must exist and its identities must be the current ones."""
    if record is None or record.isEmpty():
        raise ValueError("the test split is sealed: there is no selection record")
    require_equal(record, current, fields, "the selection record does not fit what is here")


def register_parent(state: DataFrame, expected: dict, receipt_path: str) -> None:
    """Pins a branch's parent: its state must have the expected values, and a receipt is written, once."""
    spark = state.sparkSession
    want = spark.createDataFrame([tuple(expected.values())], state.select(*expected).schema)
    require_equal(state, want, list(expected), "the parent is not in the expected state")
    state.select(*expected).write.mode("errorifexists").json(receipt_path)


def degenerate(systems: DataFrame, cover: DataFrame) -> DataFrame:
    """(rule) where a paired bootstrap has nothing to draw from: no eligible task with rows, or no cluster."""
    eligible = systems.join(cover.where("eligible").select("task_id"), "task_id", "left_semi").agg(F.count("*").alias("eligible_rows"))
    a = systems.agg(F.count("agreement_id").alias("clustered")).join(F.broadcast(eligible))  # single rows
    rules = F.array(F.when(F.col("eligible_rows") == 0, F.lit("no_eligible_task")), F.when(F.col("clustered") == 0, F.lit("no_cluster")))
    return a.select(F.explode(F.filter(rules, lambda r: r.isNotNull())).alias("rule"))


def paired_bootstrap(systems: DataFrame, weights: DataFrame, tasks: DataFrame, cover: DataFrame) -> DataFrame:
    """Intervals of both systems and their difference, after the checks that make them mean something; an error else."""
    left, right = (systems.where(F.col("system") == s) for s in ("left", "right"))
    require_empty(degenerate(systems, cover), "nothing to draw from")
    require_empty(bootstrap.pairing_violations(left, right), "the systems do not pair up")
    return bootstrap.interval(bootstrap.replicates(systems, weights, tasks, cover))
