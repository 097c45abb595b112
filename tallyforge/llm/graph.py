"""Connected components by alternating large-star and small-star steps, all as joins and aggregates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyforge.llm.common import materialise


#: A vertex's edges are dealt to so many tasks.
SALTS = 8


def _with_least(edges: DataFrame, least: DataFrame) -> DataFrame:
    """``edges`` joined with ``least`` (u, m) on u, a vertex with very many edges in ``SALTS`` parts."""
    dealt = edges.withColumn("salt", F.pmod(F.xxhash64("v", F.lit(23)), F.lit(SALTS)).cast("int"))
    copies = least.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return dealt.join(copies, ["u", "salt"])


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """One step. A vertex's least neighbour comes from an aggregate, so a vertex with very many neighbours is no list."""
    if large:
        both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        out = _with_least(both, least).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u > v")
        least = down.groupBy("u").agg(F.min("v").alias("m"))
        out = _with_least(down, least).select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v")))
    return out.where("u <> v").distinct()


def components(edges: DataFrame, rounds: int = 40) -> DataFrame:
    """(node, label) for each node of ``edges`` (u, v: long); the label is the smallest node it is joined with.

    The number of rounds grows with the logarithm of the nodes; ``rounds`` without rest is an error, never a wrong class.
    """
    now = materialise(edges.select("u", "v").where("u <> v").distinct(), "edges")
    mark = None
    for _ in range(rounds):
        now = materialise(_star(_star(now, True), False), "edges")
        seen = now.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("s"), F.sum((F.col("u") < F.col("v")).cast("int")).alias("up")).first()
        if (seen["n"], seen["s"]) == mark:
            break
        mark = (seen["n"], seen["s"])
    else:
        raise RuntimeError(f"components: not settled after {rounds} rounds")
    stars = now.select(F.greatest("u", "v").alias("node"), F.least("u", "v").alias("label"))
    return stars.groupBy("node").agg(F.min("label").alias("label")).union(stars.select(F.col("label").alias("node"), "label").distinct())


def blocked(rows: DataFrame, key: list[str], item: str, size: int) -> DataFrame:
    """``rows`` with bi and bj: groups of ``key`` in blocks of about ``size`` items, dealt to every pair of blocks.

    A group of one block gives each row once. A larger one gives a row once per block it must meet, so no task holds
    more than two blocks however large the group.
    """
    counts = rows.groupBy(*key).agg(F.count("*").alias("tf_n")).where("tf_n > 1").withColumn("tf_blocks", F.ceil(F.col("tf_n") / size).cast("int"))
    sized = rows.join(counts, key)
    block = F.pmod(F.xxhash64(F.col(item), F.lit(5)), F.col("tf_blocks")).cast("int")
    other = sized.withColumn("tf_b", block).withColumn("tf_o", F.explode(F.sequence(F.lit(0), F.col("tf_blocks") - 1)))
    return other.withColumn("bi", F.least("tf_b", "tf_o")).withColumn("bj", F.greatest("tf_b", "tf_o")).withColumn("side", (F.col("tf_b") != F.col("bi")).cast("int")).drop("tf_n", "tf_blocks", "tf_b", "tf_o")
