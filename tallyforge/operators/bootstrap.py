"""Paired cluster bootstrap: counts per cluster once, then one vector of all replicates for every cell.

A cluster is one row: its counts, and how often each replicate draws it. A task adds the outer products of both up, cell by
cell, in numpy, and sends on a vector per cell. So there are as many rows as tasks and cells, not cells times replicates, and
a vector bounds what a cell holds. Tasks of the evaluation become rows of replicates at the very end, after their F1.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallyforge.operators.prepare import label_spine
from tallyforge.sources.io import materialise

#: Bytes of sums that a task holds before it sends them on.
HELD = 64 << 20


def pairing_violations(left: DataFrame, right: DataFrame) -> DataFrame:
    """(example_id, rule) where two systems' rows do not pair up."""
    on = ["agreement_id", "task_id", "label"]
    agg = lambda df, s: df.groupBy("example_id").agg(F.count("*").alias(f"n_{s}"), *[F.first(c).alias(f"{c}_{s}") for c in on])
    both = agg(left, "l").join(agg(right, "r"), "example_id", "full_outer")
    rule = F.when(F.col("n_l").isNull(), "left_missing").when(F.col("n_r").isNull(), "right_missing").when((F.col("n_l") > 1) | (F.col("n_r") > 1), "repeated")
    for c in on:
        rule = rule.when(~F.col(f"{c}_l").eqNullSafe(F.col(f"{c}_r")), f"{c}_differs")
    return both.select("example_id", rule.alias("rule")).where("rule is not null")


def hashed_weights(clusters: DataFrame, replicates: int, seed: str, key: str = "agreement_id") -> DataFrame:
    """(rep, key, w): how often each cluster is drawn in each replicate, from hashes of seed, replicate and draw."""
    numbered = clusters.select(key).distinct().withColumn("c", F.row_number().over(Window.orderBy(key)) - 1)
    size = numbered.agg(F.count("*").alias("a"))
    draws = clusters.sparkSession.range(replicates).withColumnRenamed("id", "rep").crossJoin(F.broadcast(size)).withColumn("j", F.explode(F.sequence(F.lit(0).cast("long"), F.col("a") - 1)))
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.col("rep").cast("string"), F.lit(":"), F.col("j").cast("string")), 256), 1, 8), 16, 10).cast("long")
    return draws.select("rep", (h % F.col("a")).alias("c")).groupBy("rep", "c").agg(F.count("*").alias("w")).join(numbered, "c").select("rep", key, "w")


def numpy_weights(spark: SparkSession, clusters: list[str], replicates: int, seed: int) -> DataFrame:
    """The same from NumPy's generator, over clusters in sorted order; as many rows as replicates times clusters."""
    rng, names = np.random.default_rng(seed), sorted(clusters)
    rows = [(r, names[i], int(w)) for r in range(replicates) for i, w in enumerate(np.bincount(rng.integers(0, len(names), len(names)), minlength=len(names))) if w]
    return spark.createDataFrame(rows, "rep long, agreement_id string, w long")


def vectors(weights: DataFrame) -> tuple[DataFrame, int]:
    """(agreement_id, draws) with the weights of each cluster in all replicates, and how many replicates there are."""
    rows = materialise(weights.groupBy("agreement_id").agg(F.collect_list(F.struct(F.col("rep").cast("int").alias("rep"), F.col("w").cast("int").alias("w"))).alias("draws")), "vectors")
    top = rows.agg(F.max(F.array_max(F.transform("draws", lambda x: x["rep"])))).first()[0]
    return rows, 0 if top is None else top + 1


def weighted_sums(cells: DataFrame, keys: list[str], drawn: tuple[DataFrame, int]) -> DataFrame:
    """(keys, v): sums of n over the clusters of ``cells`` (agreement_id, keys, n) in every replicate, in parts to be added."""
    rows, size = drawn
    names = [f"k{i}" for i in range(len(keys))]
    held = cells.groupBy("agreement_id").agg(F.collect_list(F.struct(*[F.col(k).alias(n) for k, n in zip(keys, names, strict=True)], "n")).alias("cells"))
    kinds = [dict(cells.dtypes)[k] for k in keys]
    types = [{"string": pa.string(), "int": pa.int32(), "bigint": pa.int64()}[k] for k in kinds]
    most = max(1, HELD // max(1, 8 * size))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place: dict[tuple, int] = {}
        total = np.zeros((256, size))

        def parts() -> Iterator[pa.RecordBatch]:
            columns = [pa.array([k[i] for k in place], kind) for i, kind in enumerate(types)]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(list(total[: len(place)]), pa.list_(pa.float64()))], [*names, "v"])

        for batch in batches:
            for counts, draws in zip(batch.column("cells").to_pylist(), batch.column("draws").to_pylist(), strict=True):
                vector = np.zeros(size)
                vector[[d["rep"] for d in draws]] = [d["w"] for d in draws]
                at = [place.setdefault(tuple(c[n] for n in names), len(place)) for c in counts]
                if len(place) > len(total):
                    total = np.concatenate([total, np.zeros((max(len(total), len(place) - len(total)), size))])
                np.add.at(total, at, np.outer([c["n"] for c in counts], vector))
                if len(place) > most:
                    yield from parts()
                    place, total = {}, np.zeros((256, size))
        if place:
            yield from parts()

    return held.join(rows, "agreement_id").select("cells", "draws").mapInArrow(run, ", ".join([*map(" ".join, zip(names, kinds, strict=True)), "v array<double>"])).toDF(*keys, "v")


def cluster_cells(systems: DataFrame) -> DataFrame:
    """(system, task_id, agreement_id, label, prediction, n): the counts that scores and bootstrap are worked out from."""
    return systems.groupBy("system", "task_id", "agreement_id", "label", "prediction").agg(F.count("*").alias("n"))


def replicates(systems: DataFrame, weights: DataFrame, tasks: DataFrame, cover: DataFrame) -> DataFrame:
    """(rep, left, right, difference, tasks): macro F1 of both systems in every replicate.

    ``systems`` has a column system, 'left' or 'right'. Tasks without weight in a replicate are left out there.
    """
    return cell_replicates(cluster_cells(systems), vectors(weights), tasks, cover)


def cell_replicates(cells: DataFrame, drawn: tuple[DataFrame, int], tasks: DataFrame, cover: DataFrame) -> DataFrame:
    """``replicates`` from ``cluster_cells`` and ``vectors``."""
    wanted = cells.join(cover.where("eligible").select("task_id"), "task_id", "left_semi")
    sums = weighted_sums(wanted, ["system", "task_id", "label", "prediction"], drawn)
    choices = label_spine(tasks).groupBy("task_id").agg(F.count("*").alias("choices"))

    def f1(group: pd.DataFrame) -> pd.DataFrame:
        twice, either, size = {}, {}, len(group["v"].iloc[0])
        for label, prediction, v in zip(group["label"], group["prediction"], group["v"], strict=True):
            v = np.asarray(v)
            for k in (label, prediction):
                if k >= 0:
                    either[k] = either.get(k, np.zeros(size)) + v
            if label == prediction:
                twice[label] = twice.get(label, np.zeros(size)) + 2 * v
        # labels without any count add nothing to the sum of F1, so dividing by the number of choices is enough
        f, any_ = np.zeros(size), np.zeros(size, bool)
        for k, m in either.items():
            f += np.divide(twice.get(k, np.zeros(size)), m, out=np.zeros(size), where=m > 0)
            any_ |= m > 0
        f = np.where(any_, f / group["choices"].iloc[0], np.nan)
        return pd.DataFrame({"system": group["system"].iloc[:1].to_list(), "task_id": group["task_id"].iloc[:1].to_list(), "f": [f]})

    each = sums.join(choices, "task_id").groupBy("system", "task_id").applyInPandas(f1, "system string, task_id string, f array<double>")
    rows = each.select("system", "task_id", F.posexplode("f").alias("rep", "f1")).where("f1 is not null and not isnan(f1)")
    mean = rows.groupBy(F.col("rep").cast("long").alias("rep")).agg(*[F.avg(F.when(F.col("system") == s, F.col("f1"))).alias(s) for s in ("left", "right")], F.count_distinct("task_id").alias("tasks"))
    return mean.where("left is not null and right is not null").withColumn("difference", F.col("right") - F.col("left"))


def _ratios(counts: DataFrame, weights: DataFrame) -> DataFrame:
    """(rep, left, right) of k over n from (system, agreement_id, n, k), null without n."""
    drawn = vectors(weights)
    cells = counts.select("agreement_id", "system", F.inline(F.array(F.struct(F.lit("n").alias("what"), F.col("n").alias("n")), F.struct(F.lit("k").alias("what"), F.col("k").alias("n")))))
    sums = weighted_sums(cells, ["system", "what"], drawn).select("system", "what", F.posexplode("v").alias("rep", "x"))
    total = lambda s, c: F.sum(F.when((F.col("system") == s) & (F.col("what") == c), F.col("x")))
    found = sums.groupBy(F.col("rep").cast("long").alias("rep")).agg(*[F.when(total(s, "n") > 0, total(s, "k") / total(s, "n")).alias(s) for s in ("left", "right")])
    return weights.sparkSession.range(drawn[1]).withColumnRenamed("id", "rep").join(found, "rep", "left")


def accuracy_replicates(systems: DataFrame, weights: DataFrame) -> DataFrame:
    """(rep, left, right, difference) for accuracy."""
    n = systems.groupBy("system", "agreement_id").agg(F.count("*").alias("n"), F.count(F.when(F.col("label") == F.col("prediction"), 1)).alias("k"))
    return _ratios(n, weights).where("left is not null or right is not null").withColumn("difference", F.col("right") - F.col("left"))


def missing_tasks(systems: DataFrame, weights: DataFrame, cover: DataFrame) -> DataFrame:
    """(replicates, replicates_missing_tasks): how many there are, and in how many some eligible task with rows had no weight."""
    clusters = systems.join(cover.where("eligible").select("task_id"), "task_id", "left_semi").select("task_id", "agreement_id", F.lit(1).cast("long").alias("n")).distinct()
    drawn = vectors(weights)
    whole = clusters.agg(F.count_distinct("task_id").alias("whole"))
    hit = weighted_sums(clusters, ["task_id"], drawn).select("task_id", F.posexplode("v").alias("rep", "x")).where("x > 0")
    every = weights.sparkSession.range(drawn[1]).withColumnRenamed("id", "rep").join(hit.groupBy(F.col("rep").cast("long").alias("rep")).agg(F.count_distinct("task_id").alias("tasks")), "rep", "left").join(F.broadcast(whole))  # one row
    return every.agg(F.count("*").alias("replicates"), F.count(F.when(F.coalesce("tasks", F.lit(0)) < F.col("whole"), 1)).alias("replicates_missing_tasks"))


def rare_recall_replicates(systems: DataFrame, weights: DataFrame, cover: DataFrame) -> DataFrame:
    """(rep, left, right, difference) for the recall of rare labels; a replicate without a rare row has nulls."""
    rare = systems.join(cover.select("task_id", "rare_labels"), "task_id").where(F.array_contains("rare_labels", F.col("label")))
    n = rare.groupBy("system", "agreement_id").agg(F.count("*").alias("n"), F.count(F.when(F.col("label") == F.col("prediction"), 1)).alias("k"))
    return _ratios(n, weights).withColumn("difference", F.col("right") - F.col("left"))


def interval(reps: DataFrame, low: float = 0.025, high: float = 0.975) -> DataFrame:
    """(statistic, low, high): percentiles over replicates."""
    long = reps.unpivot(["rep"], ["left", "right", "difference"], "statistic", "x")
    return long.groupBy("statistic").agg(F.percentile("x", F.lit(low)).alias("low"), F.percentile("x", F.lit(high)).alias("high"), F.count("*").alias("replicates"))
