import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyforge.operators import prepare, ranks, runlog
from tallyforge.sources import io as files


@pytest.mark.parametrize(("cells", "few"), [(4096, 10_000), (16, 3)])
def test_percentiles_against_numpy(spark, monkeypatch, cells, few):
    monkeypatch.setattr(ranks, "CELLS", cells)
    monkeypatch.setattr(ranks, "FEW", few)
    rng = random.Random(cells)
    shapes = {"one": [3.5], "same": [2.0] * 50, "ties": [float(rng.randrange(4)) for _ in range(200)], "wide": [rng.choice([-1, 1]) * 10 ** rng.uniform(-300, 300) for _ in range(120)], None: [rng.gauss(0, 1) for _ in range(300)], "close": [1.0 + k * 2**-52 for k in range(40)]}
    rows = [(k, x, "v") for k, xs in shapes.items() for x in xs] + [("ties", None, "v"), ("none", None, "v")]
    df = spark.createDataFrame(rows, "g string, v double, k0 string")
    shares = [0.0, 0.025, 0.5, 0.9, 0.975, 1.0]
    got = {r.g: r.p for r in ranks.exact_percentiles(df, ["g"], "v", shares).collect()}
    assert got.pop("none") == [None] * len(shares)
    assert set(got) == set(shapes)
    for g, xs in shapes.items():
        assert got[g] == pytest.approx(np.percentile(np.array(xs), [100 * s for s in shares]).tolist(), rel=1e-12), g
    whole = ranks.exact_percentiles(df, [], "v", [0.5]).first().p
    assert whole == pytest.approx([float(np.percentile(np.concatenate(list(shapes.values())), 50))])


def test_percentiles_of_nothing_and_of_what_is_not_finite(spark):
    df = spark.createDataFrame([("a", float("nan"))], "g string, v double")
    assert ranks.exact_percentiles(df.limit(0), ["g"], "v", [0.5]).count() == 0
    with pytest.raises(Exception, match="not finite"):
        ranks.exact_percentiles(df, ["g"], "v", [0.5]).collect()


def test_differences_look_into_parts_that_differ(spark):
    rows = [(i % 50 if i % 7 else None, f"t{i % 31}" if i % 11 else None, "x") for i in range(2000)]
    schema = "id int, `a.b` string, part string"
    a = spark.createDataFrame(rows, schema)
    b = spark.createDataFrame(list(reversed(rows)), schema).select("part", "`a.b`", "id")
    assert prepare.differences(a, b).count() == 0
    changed = [*rows[1:], rows[5], ("new" and 77, None, "x"), (None, "t77", "x")]
    got = sorted(map(str, prepare.differences(a, spark.createDataFrame(changed, schema), 16).collect()))
    c = spark.createDataFrame(changed, schema)
    want = a.exceptAll(c).withColumn("side", F.lit("left")).unionByName(c.exceptAll(a).withColumn("side", F.lit("right")))
    assert got == sorted(map(str, want.collect())) and len(got) == 4
    # a null in one column is not a null in the next, and a repeated row is not one row
    one = spark.createDataFrame([(None, "t", "x"), (1, None, "x")], schema)
    assert prepare.differences(one, one.union(one.limit(1))).count() == 1
    assert prepare.differences(one.limit(0), one).count() == 2 and prepare.differences(one.limit(0), one.limit(0)).count() == 0


def test_positions_by_ranges(spark):
    rng = random.Random(3)
    rows = [(rng.choice([None, rng.randrange(30), 7]), f"s{i:04d}") for i in range(700)]
    df = spark.createDataFrame(rows, "a int, b string").repartition(5)
    got = sorted(runlog.positions(df, ["a", "b"], 6).collect(), key=lambda r: r.pos)
    assert [r.pos for r in got] == list(range(700))
    assert [(r.a, r.b) for r in got] == sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
    assert runlog.positions(df.limit(0), ["a"]).count() == 0
    assert files.drop_tables(spark) >= 2 and files.drop_tables(spark) == 0
