import random

import pytest

import __spark_entry__
from tallyforge.operators import near, overlap


def sets_of(spark, texts):
    return near.text_sets(spark.createDataFrame([("a", " ".join(t)) for t in texts], "text_type string, norm string"))


def test_a_pair_goes_on_once_however_many_shingles_it_shares(spark):
    rng = random.Random(1)
    long = [f"w{rng.randrange(9000)}" for _ in range(6000)]
    sets = sets_of(spark, [long, long[1:]])
    assert near.links(near.ordered(sets, 0.9), 0.9).count() == 1
    assert near.near_pairs(sets).count() == 1


def test_a_crowd_goes_on_once_however_many_shingles_it_shares(spark):
    rng = random.Random(2)
    base = [f"w{rng.randrange(9000)}" for _ in range(2000)]
    sets = sets_of(spark, [[f"u{i}", *base] for i in range(40)])
    assert near.links(near.ordered(sets, 0.9), 0.9).count() < 200
    assert {(r.links, r.class_h) for r in near.near_classes(sets).collect()} == {(39, min(r.h for r in sets.collect()))}


def test_hashed_rows_need_no_texts(spark):
    rows = spark.createDataFrame([(1, "t", "x", "train", 0, "h"), (2, "t", "y", "test", 1, "h"), (3, "t", "y", "test", 1, "g")], "example_id long, task_id string, agreement_id string, split string, label int, h string")
    assert [r.example_ids for r in overlap.exact_groups(rows).collect()] == [[1, 2]]
    assert [r.example_id for r in overlap.seen_exact(rows).collect()] == [2]


@pytest.mark.parametrize("name", ["near_overlap_tasks", "overlap_summary", "train_seen", "train_seen_near"])
def test_documents_are_read_before_the_pairs_only(spark, name):
    """What is left to do when the pairs are found reads tables of hashes, never the documents again."""
    files = __spark_entry__.queries()[name](spark, "/root/testdata/sf0.001").inputFiles()
    assert files and not [f for f in files if "documents" in f]
