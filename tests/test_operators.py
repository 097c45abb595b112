"""Guard machine, archives, files, run logs, overlap and streams on small inputs."""

import base64
import gzip
import hashlib
import io
import json
import zipfile

import pytest
from pyspark.sql import functions as F

from tallyforge.operators import guard, near, runlog, scan
from tallyforge.sources import io as files
from tallyforge.streaming.guard_stream import stream_machine

BASE = dict(cpu_c=70, gpu_c=68, gpu_limit_w=200, cpu_max_khz=3000000, slowdown=False)


@pytest.mark.parametrize(("change", "want"), [({}, "cool"), ({"cpu_c": 85}, "hot"), ({"gpu_c": 80}, "hot"), ({"cpu_c": 76}, "hold"), ({"gpu_c": 73}, "hold"), ({"slowdown": True}, "hot"), ({"gpu_limit_w": 350}, "limits_changed"), ({"cpu_max_khz": 5486441}, "limits_changed")])
def test_decisions(spark, change, want):
    assert spark.createDataFrame([BASE | change]).select(guard.decision().alias("d")).first().d == want


def test_machine_needs_cool_readings_and_time():
    m, limits = guard.Machine(), guard.Limits()
    assert m.feed("hot", 0.0, limits) == "pause" and m.feed("hot", 1.0, limits) == "none"
    for i in range(14):
        assert m.feed("cool", 10.0 + 5 * i, limits) == "none"
    assert m.feed("hold", 90.0, limits) == "none" and m.cool == 0
    actions = [m.feed("cool", 100.0 + i, limits) for i in range(15)]
    assert actions[-1] == "resume" and set(actions[:-1]) == {"none"}
    assert m.feed("sensor_failure", 200.0, limits) == "pause"


def test_stream_equals_batch(spark, tmp_path):
    rows = [(h, i, float(i * 5), 90 if i % 40 == 3 else 70, 60, 200, 3000000, False) for h in (1, 2) for i in range(80)]
    df = spark.createDataFrame(rows, "host long, event_id long, s double, cpu_c int, gpu_c int, gpu_limit_w int, cpu_max_khz int, slowdown boolean").withColumn("ts", F.timestamp_seconds("s")).drop("s")
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = stream_machine(spark.readStream.schema(df.schema).parquet(str(tmp_path / "in")))
    q = stream.writeStream.format("memory").queryName("guard_out").option("checkpointLocation", str(tmp_path / "c")).start()
    q.processAllAvailable()
    q.stop()
    got = {tuple(r) for r in spark.sql("select * from guard_out").collect()}
    assert got == {tuple(r) for r in guard.run_machine(df).collect()} and any(r[3] == "resume" for r in got)


def test_archives():
    inner = gzip.compress(b'{"p": "/home/someone/x"}')
    z = io.BytesIO()
    with zipfile.ZipFile(z, "w") as f:
        f.writestr("a.json.gz", inner)
        f.writestr("../outside.txt", "x")
    page = b"<img src='data:application/zip;base64," + base64.b64encode(z.getvalue()) + b"'>"
    found = list(scan.expand("page", page))
    assert any(c and b"/home/someone" in c for _, c, _ in found if c) and any(p == "unsafe_member" for *_, p in found)
    assert files.unsafe_members(z.getvalue()) == ["../outside.txt"]


def test_undecodable_is_a_problem(spark):
    df = spark.createDataFrame([("a", bytearray(b"\xff\xfe\xfd")), ("b", bytearray(b"x\x00y")), ("c", bytearray(b"fine"))], "path string, content binary")
    assert {r.name: r.problem for r in scan.expand_archives(df).collect()} == {"a": "undecodable", "b": "nul", "c": None}


def test_verified_gzip(spark, tmp_path):
    raw = b'{"a": 1}\n\n{"a": 2}\n'
    (tmp_path / "x.gz").write_bytes(gzip.compress(raw))
    path = f"file:{tmp_path}/x.gz"
    good = (path, hashlib.sha256((tmp_path / "x.gz").read_bytes()).hexdigest(), hashlib.sha256(raw).hexdigest(), 2)
    schema = "path string, gzip_sha256 string, sha256 string, rows int"
    assert files.verified_gzip(spark, spark.createDataFrame([good], schema), str(tmp_path)).count() == 2
    with pytest.raises(Exception, match="content hash differs"):
        files.verified_gzip(spark, spark.createDataFrame([(path, good[1], "0" * 64, 2)], schema), str(tmp_path)).count()


def test_files(spark, tmp_path):
    (tmp_path / "t.csv").write_text('id,text\n1,"two\nlines ""quoted"""\n')
    assert files.read_csv(spark, str(tmp_path / "t.csv"), "id int, text string").first().text == 'two\nlines "quoted"'
    df = spark.createDataFrame([(1, 0.5), (2, float("nan"))], "id int, x double")
    files.write_jsonl(df.where("id = 1"), str(tmp_path / "out"))
    assert files.read_jsonl(spark, str(tmp_path / "out"), "id int, x double").count() == 1
    with pytest.raises(Exception, match="not finite"):
        files.write_jsonl(df, str(tmp_path / "bad"))
    (tmp_path / "m.txt").write_text("x")
    h = files.file_hashes(spark, str(tmp_path / "m.txt"))
    wrong = h.select("path", F.lit("0").alias("sha256"))
    assert files.unequal(h.select("path", "sha256"), h).count() == 0 and files.unequal(wrong, h).count() == 1
    assert files.same_identity(spark.createDataFrame([(1, "a")], "n int, s string"), spark.createDataFrame([(1, "b")], "n int, s string")).first().field == "s"


def test_selection_and_stopping(spark):
    s = spark.createDataFrame([(1, 0.5), (2, 0.7), (3, 0.7), (4, 0.6), (5, 0.9)], "epoch long, score double")
    assert runlog.select_best(s.where("epoch <= 3")).first().epoch == 2
    rows = runlog.early_stopping(s).orderBy("epoch").collect()
    assert [r.bad for r in rows] == [0, 0, 1, 2] and rows[-1].stop


def test_padding_and_supervision(spark):
    df = spark.createDataFrame([(7, [3, 1, 4, 1]), (7, [9]), (8, [2, 7])], "b int, t array<int>")
    out = {tuple(r.padded): r.mask for r in runlog.pad(df, "t", "b", -1).collect()}
    assert out == {(3, 1, 4, 1): [1, 1, 1, 1], (9, -1, -1, -1): [1, 0, 0, 0], (2, 7): [1, 1]}
    row = df.where("b = 8").select(runlog.supervision(F.col("t"), F.array(F.lit(5), F.lit(6), F.lit(0)), 5).alias("l")).first()
    assert row.l == [-100, -100, 5, 6, 0]
    with pytest.raises(Exception, match="exceeds"):
        df.where("b = 8").select(runlog.supervision(F.col("t"), F.array(F.lit(5), F.lit(6), F.lit(0)), 4).alias("l")).collect()


def test_weighted_loss(spark):
    df = spark.createDataFrame([(3, 1.5, 2.0), (3, 0.5, 6.0), (4, 0.25, 1.0), (4, 0.75, 1.0)], "batch int, loss double, weight double")
    got = {r.batch: (r.weighted_loss, r.weight_sum, r.upweighted) for r in runlog.weighted_loss(df).collect()}
    assert got == {3: (0.75, 8.0, 2), 4: (0.5, 2.0, 0)}


def test_near_pairs_against_brute_force(spark):
    import random

    rng = random.Random(0)
    base = [f"w{rng.randrange(40)}" for _ in range(60)]
    rows = []
    for i in range(40):
        w = list(base)
        for _ in range(rng.randrange(0, 3)):
            w[rng.randrange(60)] = f"x{rng.randrange(5)}"
        rows.append((i, "en", " ".join(w)))
    df = spark.createDataFrame(rows, "example_id int, text_type string, norm string")
    got = {(r.left, r.right) for r in near.near_pairs(near.text_sets(df)).collect()}
    sets = {hashlib.sha256(t.encode()).hexdigest(): {tuple(t.split()[j : j + 5]) for j in range(56)} for _, _, t in rows}
    want = {(a, b) for a in sets for b in sets if a < b and len(sets[a] & sets[b]) >= 0.9 * len(sets[a] | sets[b])}
    assert got == want and want


def test_entry_runs(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() == 1
    assert json.dumps(sorted(__spark_entry__.oracle_sql())) and set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
