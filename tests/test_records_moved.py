import hashlib
import unicodedata

import pyarrow as pa
from pyspark.sql import functions as F

from tallyforge.functions import text as tx
from tallyforge.operators import audit, runlog, scoring


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_rows_are_not_dealt_by_task(spark):
    """Few tasks have most rows, so tasks go to the rows; a text is hashed before its row moves."""
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        rows = spark.range(40).selectExpr("id example_id", "'a' agreement_id", "concat('t', id % 2) task_id", "cast(id % 2 as int) label", "'test' split", "'main' data_type", "repeat('x', 5) text", "5 prompt_tokens")
        tasks = spark.createDataFrame([("t0", ["no", "yes"]), ("t1", ["no", "yes"])], "task_id string, answers array<string>")
        flagged = spark.range(3).selectExpr("id example_id")
        records = audit.prediction_records(rows, tasks, flagged, F.char(65 + F.col("label")))
        assert "hashpartitioning(task_id" not in plan(records)
        assert "task_id" not in "".join(x for x in plan(scoring.violations(rows, records, tasks)).split("\n") if "hashpartitioning(g_task_id" in x)
        assert "hashpartitioning(task_id" not in plan(audit.published_violations(rows, records, tasks, flagged))
        assert audit.published_violations(rows, records, tasks, flagged).count() == 0 and records.where("train_overlap").count() == 3
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_a_sequence_is_hashed_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(runlog, "BLOCK", 7)
    rows = [(i % 3 if i % 11 else None, i * 37 % 1009, f"id-{i}") for i in range(200)]
    got = {r.g: (r.sequence_sha256, r.n) for r in runlog.sequence_hash(spark.createDataFrame(rows, "g int, p long, id string"), "id", "p", ["g"]).collect()}
    for g in (0, 1, 2, None):
        ids = [i for _, i in sorted((p, i) for x, p, i in rows if x == g)]
        assert got[g] == (hashlib.sha256("\n".join(ids).encode()).hexdigest(), len(ids))
    whole = runlog.sequence_hash(spark.createDataFrame(rows, "g int, p long, id string"), "id", "p", []).first()
    assert whole.sequence_sha256 == hashlib.sha256("\n".join(i for _, i in sorted((p, i) for _, p, i in rows)).encode()).hexdigest()


def test_only_texts_beyond_ascii_are_folded_in_python(spark):
    texts = [None, "", " A\t b\x0b\x1cC\x1f ", "Straße  İK", "ﬁ  x", "plain"] * 50
    fold = lambda t: None if t is None else " ".join(unicodedata.normalize("NFKC", t).casefold().split())
    df = spark.createDataFrame(list(enumerate(texts)), "i long, t string")
    assert [r.n for r in df.select("i", tx.normalise_exact(F.col("t")).alias("n")).orderBy("i").collect()] == [fold(t) for t in texts]
    assert tx._folded.func(pa.array(texts)).to_pylist() == [fold(t) for t in texts]
