import os
import random

from tallyforge.operators import near
from tallyforge.sources import io


def size(path):
    return sum(os.path.getsize(os.path.join(d, f)) for d, _, names in os.walk(path) for f in names if f.endswith(".parquet"))


def test_shingles_are_written_once(spark):
    """Tables between the steps hold the shingles of a text once, and of the rest far less than that."""
    rng = random.Random(4)
    rows = []
    for _ in range(120):
        w = [f"w{rng.randrange(5000)}" for _ in range(3000)]
        rows += [("a", " ".join(w)), ("a", " ".join(w[1:]))]
    first = len(io._written)
    assert near.near_pairs(near.text_sets(spark.createDataFrame(rows, "text_type string, norm string"))).count() == 120
    written = [size(p.removeprefix("file:")) for p in io._written[first:]]
    assert max(written) >= 240 * 2900 * 8 and sum(written) < 1.5 * max(written)
