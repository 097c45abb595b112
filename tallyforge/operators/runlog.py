"""Training-run analytics over step logs: batches, schedules, weights, early stopping, selection, latency, drift."""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallyforge.operators.ranks import exact_percentiles
from tallyforge.sources.io import materialise


#: Ids in a block of a sequence that is hashed.
BLOCK = 8192


def seeded_order(rows: DataFrame, seed: str, epoch: int, key: str = "example_id") -> DataFrame:
    """Rows with pos, their place in a seeded order of the epoch."""
    h = F.sha2(F.concat(F.lit(f"{seed}:{epoch}:"), F.col(key).cast("string")), 256)
    return positions(rows.withColumn("tf_h", h), ["tf_h"]).drop("tf_h")


def positions(rows: DataFrame, order: list[str], parts: int | None = None) -> DataFrame:
    """Rows with pos, their place in the order of the columns, without sorting all of them in one task.

    Rows are dealt by ranges of the order, sorted inside, and written with their place in the range; places begin after the
    rows of all ranges before, of which there are few. Equal rows have places in no certain order.
    """
    n = parts or 4 * int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = rows.repartitionByRange(n, *order).sortWithinPartitions(*order).withColumn("tf_row", F.monotonically_increasing_id())
    held = materialise(ranged, "positions")
    part, place = F.shiftright("tf_row", 33), F.col("tf_row").bitwiseAND(F.lit((1 << 33) - 1))
    counts = held.groupBy(part.alias("tf_part")).agg(F.count("*").alias("tf_n"))
    before = F.coalesce(F.sum("tf_n").over(Window.orderBy("tf_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = F.broadcast(counts.select("tf_part", before.alias("tf_before")))  # one row for each of the ranges
    placed = held.withColumn("tf_part", part).join(starts, "tf_part")
    return placed.withColumn("pos", (place + F.col("tf_before")).cast("long")).drop("tf_part", "tf_before", "tf_row")


def numpy_order(spark: SparkSession, n: int, seed: int, epoch: int) -> DataFrame:
    """(pos, row): NumPy's permutation for seed + epoch."""
    return spark.createDataFrame(list(enumerate(np.random.default_rng(seed + epoch).permutation(n).tolist())), "pos long, row long")


def batches(rows: DataFrame, size: int = 16) -> DataFrame:
    """(batch, ids, n): consecutive rows, the last batch short."""
    return rows.groupBy(F.floor(F.col("pos") / size).alias("batch")).agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "example_id"))), lambda s: s["example_id"]).alias("ids"), F.count("*").alias("n"))


def steps(rows: int, size: int, epochs: int, warm_share: float) -> dict[str, int]:
    """Steps per epoch, steps in all, warm-up steps."""
    per = math.ceil(rows / size)
    return {"per_epoch": per, "total": per * epochs, "warm_up": math.ceil(per * epochs * warm_share)}


def cosine_schedule(step: Column, warm_up: int, total: int, peak: float) -> Column:
    """Learning rate at a step: linear warm-up, then half a cosine down to zero."""
    share = (step - warm_up) / F.lit(max(1, total - warm_up))
    return F.when(step < warm_up, peak * step / max(1, warm_up)).otherwise(F.greatest(F.lit(0.0), peak * 0.5 * (1 + F.cos(math.pi * share))))


def rare_weight(label: Column, rare_labels: Column, weight: float = 3.0) -> Column:
    return F.when(F.array_contains(rare_labels, label), weight).otherwise(1.0)


def weighted_loss(log: DataFrame) -> DataFrame:
    """Per batch the weighted mean loss, the weights' sum and the number of heavier examples."""
    return log.groupBy("batch").agg((F.sum(F.col("weight") * F.col("loss")) / F.sum("weight")).alias("weighted_loss"), F.sum("weight").alias("weight_sum"), F.count(F.when(F.col("weight") > 1, 1)).alias("upweighted"))


def weight_violations(rows: DataFrame, key: str = "example_id") -> DataFrame:
    """Examples without exactly one finite positive weight."""
    good = F.col("weight").isNotNull() & ~F.isnan("weight") & (F.col("weight") > 0) & (F.col("weight") < float("inf"))
    return rows.groupBy(key).agg(F.count("*").alias("n"), F.min(F.coalesce(good, F.lit(False))).alias("good")).where("n <> 1 or not good").select(key)


def throughput(log: DataFrame, per_epoch: int) -> DataFrame:
    """Examples and tokens per second and the fractional epoch of each step."""
    return log.withColumns({"examples_per_second": F.try_divide("examples", "seconds"), "tokens_per_second": F.try_divide("tokens", "seconds"), "epoch": F.col("global_step") / per_epoch})


def steady_state(log: DataFrame, skip: int = 2, value: str = "loss") -> DataFrame:
    """Mean, exact median and maximum after the first ``skip`` steps."""
    first = log.select("global_step").orderBy("global_step").limit(skip)
    kept = log.join(first, "global_step", "left_anti")
    return kept.agg(F.count("*").alias("n"), F.avg(value).alias("mean"), F.percentile(value, F.lit(0.5)).alias("median"), F.max(value).alias("longest"))


def checkpoint_due(step: Column, last: int, every: int = 100, first: int = 10, stop: Column | None = None) -> Column:
    return (step == first) | (step % every == 0) | (step == last) | (stop if stop is not None else F.lit(False))


def early_stopping(scores: DataFrame, patience: int = 2, least_gain: float = 0.0) -> DataFrame:
    """(epoch, score, best, bad, stop) of epochs in order, by a fold that carries the best score and the bad run.

    Epochs of one run are few, so one ordered array is folded. Rows after the stop are left out.
    """
    runs = scores.agg(F.array_sort(F.collect_list(F.struct("epoch", "score"))).alias("s"))
    start = F.expr("named_struct('best', cast(null as double), 'bad', 0, 'done', false, 'out', cast(array() as array<struct<epoch:bigint,score:double,best:double,bad:int,stop:boolean>>))")

    def step(a, x):
        better = a["best"].isNull() | (x["score"] > a["best"] + least_gain)
        best, bad = F.when(better, x["score"]).otherwise(a["best"]), F.when(better, 0).otherwise(a["bad"] + 1)
        row = F.struct(x["epoch"].cast("long").alias("epoch"), x["score"].alias("score"), best.alias("best"), bad.alias("bad"), (bad >= patience).alias("stop"))
        return F.struct(F.when(a["done"], a["best"]).otherwise(best).alias("best"), F.when(a["done"], a["bad"]).otherwise(bad).alias("bad"), (a["done"] | (bad >= patience)).alias("done"), F.when(a["done"], a["out"]).otherwise(F.concat(a["out"], F.array(row))).alias("out"))

    return runs.select(F.inline(F.aggregate("s", start, step, lambda a: a["out"])))


def select_best(scores: DataFrame) -> DataFrame:
    """The epoch with the highest score, the earliest on a tie."""
    return scores.agg(F.max(F.struct("score", (-F.col("epoch")).alias("e"))).alias("b")).select((-F.col("b.e")).alias("epoch"), F.col("b.score").alias("score"))


def runtime_estimate(steps_: int, seconds: float, epochs: int, inference_seconds: float) -> float:
    """Hours for the steps and one inference per epoch."""
    return steps_ * seconds / 3600 + epochs * inference_seconds / 3600


def latency_summary(log: DataFrame, seconds: str) -> DataFrame:
    """Total, rate, exact median and 95th percentile."""
    s = F.sum(seconds)
    p = exact_percentiles(log, [], seconds, [0.5, 0.95])
    whole = log.agg(F.count("*").alias("n"), s.alias("total"), F.try_divide(F.count("*").cast("double"), s).alias("per_second"))
    return whole.join(F.broadcast(p), how="left").select("n", "total", "per_second", F.col("p")[0].alias("p50"), F.col("p")[1].alias("p95"))  # single rows


def run_difference(a: DataFrame, b: DataFrame, metrics: list[str], limit: float = 1e-6) -> DataFrame:
    """Per metric the largest absolute difference of two runs by step, steps on one side only, and whether they agree."""
    take = lambda df, s: df.select("global_step", *[F.col(m).alias(f"{m}_{s}") for m in metrics], F.lit(1).alias(f"in_{s}"))
    both = take(a, "a").join(take(b, "b"), "global_step", "full_outer")
    rows = both.agg(F.count(F.when(F.col("in_a").isNull() | F.col("in_b").isNull(), 1)).alias("unpaired"), *[F.max(F.abs(F.col(f"{m}_a") - F.col(f"{m}_b"))).alias(m) for m in metrics])
    return rows.unpivot(["unpaired"], metrics, "metric", "largest").withColumn("agree", (F.col("unpaired") == 0) & (F.col("largest") <= limit))


def longest_row(rows: DataFrame, tokens: str = "prompt_tokens", key: str = "example_id") -> DataFrame:
    """The training row with the most tokens, the first on a tie."""
    return rows.where("split = 'train'").agg(F.min_by(F.struct(key, tokens), F.struct((-F.col(tokens)).alias("t"), key)).alias("r")).select("r.*")


def sequence_hash(rows: DataFrame, key: str, position: str, groups: list[str]) -> DataFrame:
    """Per group the hash of its ids in order, one per line.

    Rows are sorted by ranges and packed there into blocks of ids. A hash of a sequence is taken in one go, so a group is one
    task's work, but that task only sorts and hashes blocks: as many bytes as the ids have, and a row for thousands of them.
    """
    types = {c: rows.schema[c].dataType.simpleString() for c in (*groups, position)}
    named, k = ", ".join(f"`{c}` {types[c]}" for c in groups), len(groups)
    ids = rows.select(*groups, position, F.col(key).cast("string").alias("tf_id"))
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = ids.repartitionByRange(parts, *groups, position).sortWithinPartitions(*groups, position)

    def pack(batches):
        now, held, seq = None, [], 0
        for batch in batches:
            kinds = [f.type for f in batch.schema][: k + 1]

            def block():
                return pa.RecordBatch.from_arrays([*[pa.array([v], t) for v, t in zip(now, kinds, strict=True)], pa.array([seq], pa.int64()), pa.array([len(held)], pa.int64()), pa.array(["\n".join(held).encode()], pa.binary())], names)  # noqa: B023

            for *row, id_ in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                if now is not None and (row[:k] != now[:k] or len(held) == BLOCK):
                    yield block()
                    now, held, seq = None, [], seq + 1
                now = row if now is None else now
                held.append(id_)
        if now is not None:
            yield block()

    names = [*groups, position, "tf_seq", "tf_n", "tf_ids"]
    blocks = ranged.mapInArrow(pack, f"{named + ', ' if named else ''}`{position}` {types[position]}, tf_seq long, tf_n long, tf_ids binary")
    dealt = blocks.repartition(*([parts, *groups] if groups else [1])).sortWithinPartitions(*groups, position, "tf_seq")

    def walk(batches):
        now, digest, n = None, None, 0

        def done():
            return pa.RecordBatch.from_arrays([*[pa.array([v], t) for v, t in zip(now, kinds, strict=True)], pa.array([digest.hexdigest()]), pa.array([n], pa.int64())], [*groups, "sequence_sha256", "n"])

        for batch in batches:
            kinds = [f.type for f in batch.schema][:k]
            for *group, _, _, some, block in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                if group != now:
                    if now is not None:
                        yield done()
                    now, digest, n = group, hashlib.sha256(), 0
                digest.update((b"\n" if n else b"") + block)
                n += some
        if now is not None:
            yield done()

    return dealt.mapInArrow(walk, f"{named + ', ' if named else ''}sequence_sha256 string, n long")


def pad(rows: DataFrame, tokens: str, batch: str, value: int) -> DataFrame:
    """Token arrays padded on the right to their batch's longest, with a mask."""
    longest = F.max(F.size(tokens)).over(Window.partitionBy(batch))
    missing = longest - F.size(tokens)
    return rows.withColumns({"padded": F.concat(tokens, F.array_repeat(F.lit(value), missing)), "mask": F.concat(F.array_repeat(F.lit(1), F.size(tokens)), F.array_repeat(F.lit(0), missing))})


def supervision(prompt: Column, answer: Column, context: int) -> Column:
    """Labels that ignore the prompt; an error where prompt and answer exceed the context."""
    labels = F.concat(F.array_repeat(F.lit(-100), F.size(prompt)), answer)
    return F.when(F.size(labels) <= context, labels).otherwise(F.raise_error(F.lit("the example exceeds the context")))
