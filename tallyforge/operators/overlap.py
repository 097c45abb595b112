"""Duplicates and near duplicates across groups and splits: exact texts, and what near pairs mean for rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _hash(rows: DataFrame, text: str) -> Column:
    """What stands for a row's text: its column h where the rows have one, so that texts need not be read again."""
    return F.col("h") if "h" in rows.columns else F.sha2(F.col(text), 256)


def exact_groups(rows: DataFrame, text: str = "norm") -> DataFrame:
    """Groups of equal text within a task that span more than one agreement."""
    h = _hash(rows, text)
    g = rows.groupBy("task_id", h.alias("text_sha256")).agg(
        F.array_sort(F.collect_set("agreement_id")).alias("agreement_ids"), F.array_sort(F.collect_set("split")).alias("splits"),
        F.array_sort(F.collect_list("example_id")).alias("example_ids"), F.array_sort(F.collect_set("label")).alias("labels"),
    )
    return g.where(F.size("agreement_ids") > 1)


def conflicting(groups: DataFrame) -> DataFrame:
    return groups.where(F.size("labels") > 1)


def seen_exact(rows: DataFrame, text: str = "norm") -> DataFrame:
    """Rows outside training whose text group, across agreements, also has a training row."""
    h = _hash(rows, text)
    keyed = rows.select("example_id", "task_id", "split", "agreement_id", h.alias("h"))
    hot = keyed.groupBy("task_id", "h").agg(F.count_distinct("agreement_id").alias("a"), F.max((F.col("split") == "train").cast("int")).alias("t")).where("a > 1 and t = 1")
    return keyed.where("split <> 'train'").join(hot, ["task_id", "h"], "left_semi").select("example_id")


def near_tasks(pairs: DataFrame, rows: DataFrame, text: str = "norm") -> DataFrame:
    """Pairs expanded to the tasks both texts occur under, where two rows have different agreements."""
    keyed = rows.select("example_id", "task_id", "text_type", "agreement_id", "split", _hash(rows, text).alias("h"))
    side = keyed.groupBy("text_type", "task_id", "h").agg(F.array_sort(F.collect_list("example_id")).alias("ids"), F.collect_set("agreement_id").alias("a"), F.collect_set("split").alias("s"))
    take = lambda s: side.select("text_type", "task_id", F.col("h").alias(s), *[F.col(c).alias(f"{c}_{s}") for c in ("ids", "a", "s")])
    both = pairs.join(take("left"), ["text_type", "left"]).join(take("right"), ["text_type", "right", "task_id"])
    different = (F.size("a_left") > 1) | (F.size("a_right") > 1) | (F.col("a_left") != F.col("a_right"))
    return both.where(different).select("text_type", "task_id", "left", "right", "jaccard", F.col("ids_left").alias("left_example_ids"), F.col("ids_right").alias("right_example_ids"), F.array_sort(F.array_union("s_left", "s_right")).alias("splits"), "s_left", "s_right")


def seen_near(expanded: DataFrame, rows: DataFrame) -> DataFrame:
    """Rows outside training on one side of a pair whose other side has a training row."""
    l = expanded.where(F.array_contains("s_right", "train")).select(F.explode("left_example_ids").alias("example_id"))
    r = expanded.where(F.array_contains("s_left", "train")).select(F.explode("right_example_ids").alias("example_id"))
    return l.union(r).distinct().join(rows.where("split <> 'train'").select("example_id"), "example_id", "left_semi")


def summary(groups: DataFrame, expanded: DataFrame, exact: DataFrame, near: DataFrame) -> DataFrame:
    """(name, value) of the overlap counts."""
    wide = lambda df, name, cond: df.agg(F.count(F.when(cond, 1)).alias("value")).select(F.lit(name).alias("name"), "value")
    always, crossed = F.lit(True), F.size("splits") > 1
    parts = [wide(groups, "exact_groups", always), wide(groups, "exact_cross_split", crossed), wide(groups, "exact_conflicts", F.size("labels") > 1), wide(expanded, "near_pairs", always), wide(expanded, "near_cross_split", crossed), wide(exact, "flagged_exact", always), wide(near, "flagged_near", always)]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
