"""Exact percentiles of groups of any size: cells are counted, and only those that hold a wanted rank are looked into.

Each round cuts the cells that hold wanted ranks into ``CELLS`` parts, even in the values or in their logarithms by turns, counts the rows of every part with the smallest and
largest value in it (map-side, so a group is a few thousand counts from each task), and keeps the parts where the ranks lie.
A cell whose values are all equal is done; one with at most ``FEW`` rows is numbered. So no task ever holds a group.

Defined cases. Nulls do not count. A group without values has null percentiles. Values must be finite: others are an error.
Ties and repeated rows count as often as they stand. An empty table gives no rows.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallyforge.sources.io import materialise

CELLS = 4096
FEW = 10_000
MOST_ROUNDS = 100


def exact_percentiles(rows: DataFrame, keys: list[str], value: str, shares: list[float]) -> DataFrame:
    """(keys, p): an array with the percentile of each share, linear between ranks, for every group of ``keys``."""
    names = [f"k{i}" for i in range(len(keys))]
    x = F.col(value).cast("double")
    finite = F.when(F.isnan(x) | (F.abs(x) == float("inf")), F.raise_error(F.lit("a value is not finite")).cast("double")).otherwise(x)
    values = rows.select(*[F.col(k).alias(n) for k, n in zip(keys, names, strict=True)], finite.alias("x"))
    base = materialise(values.groupBy(*names).agg(F.min("x").alias("lo"), F.max("x").alias("hi"), F.count("x").alias("n")), "groups")
    values = values.where("x is not null")
    wanted = F.array(*[F.struct(F.lit(i).alias("i"), (F.lit(s) * (F.col("n") - 1)).alias("at")) for i, s in enumerate(shares)])
    ends = base.where("n > 0").select(*names, "lo", "hi", "n", F.inline(wanted)).select("*", F.explode(F.array(F.struct(F.lit(0).alias("end"), F.floor("at").alias("rank")), F.struct(F.lit(1).alias("end"), F.ceil("at").alias("rank")))).alias("e"))
    live = materialise(ends.select(*names, "lo", "hi", "n", "i", "at", "e.end", F.col("e.rank").alias("rank")), "ranks")
    done = []
    for turn in range(MOST_ROUNDS):
        done.append(live.where("lo = hi").select(*names, "i", "at", "end", F.col("lo").alias("v")))
        done.append(_numbered(values, live.where(f"lo < hi and n <= {FEW}"), names))
        live = live.where(f"lo < hi and n > {FEW}")
        if live.limit(1).count() == 0:
            break
        hits = _within(values, live, names)
        f = _stretched if turn % 2 else (lambda c: F.col(c) / 2)  # halves, since hi - lo may be too large for a double
        inside = F.when(f("hi") > f("lo"), (f("x") - f("lo")) / (f("hi") - f("lo"))).otherwise((F.col("x") - F.col("lo")) / (F.col("hi") - F.col("lo")))
        cell = F.least(F.lit(CELLS - 1), F.floor(inside * CELLS))
        counts = hits.groupBy(*names, "lo", "hi", cell.alias("cell")).agg(F.count("*").alias("c"), F.min("x").alias("new_lo"), F.max("x").alias("new_hi"))
        place = Window.partitionBy(*names, "lo", "hi").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
        counts = counts.withColumn("before", F.coalesce(F.sum("c").over(place), F.lit(0)))
        met = live.alias("l").join(counts.alias("c"), _same(names, "l", "c") & (F.col("l.lo") == F.col("c.lo")) & (F.col("l.hi") == F.col("c.hi")) & (F.col("l.rank") >= F.col("before")) & (F.col("l.rank") < F.col("before") + F.col("c")))
        live = materialise(met.select(*[F.col(f"l.{n}").alias(n) for n in names], F.col("new_lo").alias("lo"), F.col("new_hi").alias("hi"), F.col("c.c").alias("n"), "i", "at", "end", (F.col("rank") - F.col("before")).alias("rank")), "ranks")
    else:
        raise RuntimeError(f"percentiles: not settled after {MOST_ROUNDS} rounds")
    found = reduce(DataFrame.union, done).groupBy(*names, "i", "at").agg(F.max(F.when(F.col("end") == 0, F.col("v"))).alias("low"), F.max(F.when(F.col("end") == 1, F.col("v"))).alias("high"))
    part = F.col("at") - F.floor("at")
    each = found.select(*names, F.struct("i", ((1 - part) * F.col("low") + part * F.col("high")).alias("v")).alias("s"))
    whole = each.groupBy(*names).agg(F.transform(F.array_sort(F.collect_list("s")), lambda s: s["v"]).alias("p"))
    joined = base.alias("b").join(whole.alias("w"), _same(names, "b", "w"), "left")
    nothing = F.array(*[F.lit(None).cast("double") for _ in shares])
    return joined.select(*[F.col(f"b.{n}").alias(k) for n, k in zip(names, keys, strict=True)], F.coalesce("w.p", nothing).alias("p"))


def _stretched(name: str):
    """A number that grows with the logarithm of a value's size; like the value it never falls where values rise."""
    x = F.col(name)
    return F.when(x == 0, 0.0).otherwise(F.signum(x) * (F.log2(F.abs(x)) + 1075))


def _same(names: list[str], a: str, b: str):
    return reduce(lambda x, y: x & y, [F.col(f"{a}.{n}").eqNullSafe(F.col(f"{b}.{n}")) for n in names], F.lit(True))


def _within(values: DataFrame, live: DataFrame, names: list[str]) -> DataFrame:
    """The values that lie in a cell of ``live``, with the cell."""
    cells = live.select(*names, "lo", "hi").distinct()
    return values.alias("v").join(cells.alias("c"), _same(names, "v", "c") & F.col("v.x").between(F.col("c.lo"), F.col("c.hi"))).select(*[F.col(f"v.{n}").alias(n) for n in names], "x", "lo", "hi")


def _numbered(values: DataFrame, live: DataFrame, names: list[str]) -> DataFrame:
    """(names, i, at, end, v) of cells with few rows, each row numbered in its cell."""
    numbered = _within(values, live, names).withColumn("r", F.row_number().over(Window.partitionBy(*names, "lo", "hi").orderBy("x")) - 1)
    met = live.alias("l").join(numbered.alias("v"), _same(names, "l", "v") & (F.col("l.lo") == F.col("v.lo")) & (F.col("l.hi") == F.col("v.hi")) & (F.col("l.rank") == F.col("v.r")))
    return met.select(*[F.col(f"l.{n}").alias(n) for n in names], "i", "at", "end", F.col("x").alias("v"))
