import random

import pytest
from pyspark.sql import functions as F

from tallyforge.operators import guard, watch
from tallyforge.sources import io as files
from tallyforge.streaming import watch_stream

SCHEMA = "host long, event_id long, s double, cpu_c int, gpu_c int, gpu_limit_w int, cpu_max_khz int, slowdown boolean"
SMALL = watch.Watch(guard.Limits(cool_readings=3, least_pause_seconds=60), 30)


def frame(spark, rows):
    return spark.createDataFrame([(h, i, s, c, 60, 200, 3000000, False) for h, i, s, c in rows], SCHEMA).withColumn("ts", F.timestamp_micros((F.col("s") * 1000000).cast("long"))).drop("s")


def told(df):
    return sorted((r.host if r.host is not None else -1, r.us / 1e6, r.kind, r.decision, r.action, r.paused, r.cool, r.event_id) for r in df.collect())


def test_clocks_by_hand(spark):
    # hot at 0, cool at 5, 10, 15: the pause is too short, the clock ends it at 60 if readings go on; silence pauses again
    rows = [(1, 0, 0.0, 90), *[(1, i, 5.0 * i, 70) for i in range(1, 4)]]
    got = told(watch.run(frame(spark, [*rows, (2, 9, 100.0, 80)]), SMALL))
    assert [(r[1], r[2], r[4], r[5]) for r in got if r[0] == 1] == [(0.0, "reading", "pause", True), (5.0, "reading", "none", True), (10.0, "reading", "none", True), (15.0, "reading", "none", True), (45.0, "silence", "none", True)]
    rows += [(1, 4, 40.0, 80), *[(1, 5 + i, 42.0 + i, 70) for i in range(3)], (1, 8, 65.0, 90)]
    got = [r for r in told(watch.run(frame(spark, rows), SMALL)) if r[2] == "timer"]
    assert [(r[1], r[4], r[5], r[6], r[7]) for r in got] == [(60.0, "resume", False, 0, 7)]
    # the reading at the very end of the pause comes first, and pauses on
    rows[-1] = (1, 8, 60.0, 90)
    assert all(r[2] != "timer" for r in told(watch.run(frame(spark, rows), SMALL)))
    # silence before anything hot pauses by itself, two devices at once are a failure
    got = told(watch.run(frame(spark, [(1, 0, 0.0, 70), (1, 1, 31.0, 70), (1, 2, 31.0, 70), (None, 3, 0.0, 70), (2, 4, 61.0, 70)]), SMALL))
    assert [(r[0], r[1], r[2], r[4]) for r in got] == [(-1, 0.0, "reading", "none"), (-1, 30.0, "silence", "pause"), (1, 0.0, "reading", "none"), (1, 30.0, "silence", "pause"), (1, 31.0, "reading", "none"), (1, 61.0, "silence", "none"), (2, 61.0, "reading", "none")]
    assert watch.run(frame(spark, []), SMALL).count() == 0
    assert {(r.host, r.us) for r in watch.silences(frame(spark, rows[:4]), SMALL).collect()} == set()


def story(seed):
    rng = random.Random(seed)
    rows, i = [], 0
    for host in range(6):
        s = 0.0
        for _ in range(60):
            s += rng.choice([0.5, 2.0, 7.25, 31.0, 90.0]) if rng.random() < 0.2 else 2.0
            rows.append((host, i, s, rng.choice([70, 70, 70, 70, 70, 80, 90, 130])))
            i += 1
            if rng.random() < 0.03:
                rows.append((host, i, s, 70))
                i += 1
    return sorted(rows, key=lambda r: r[2])


def test_stream_equals_batch_over_restarts(spark, tmp_path):
    """Readings out of order within the delay, hosts that fall silent, restarts, one of them in the middle of a commit."""
    rng = random.Random(1)
    rows = story(1)
    end = max(r[2] for r in rows)
    jitter = sorted(rows, key=lambda r: r[2] + rng.random() * 5)  # late by five seconds at most
    parts = [jitter[k : k + 190] for k in range(0, len(jitter), 190)]
    flush = [[(99, 100000, end + 1000.0, 70)], [(99, 100001, end + 1001.0, 70)], [(99, 100002, end + 1002.0, 70)]]
    path, place = str(tmp_path / "in"), str(tmp_path / "out")
    schema = frame(spark, []).schema
    for n, part in enumerate([*parts, *flush]):
        frame(spark, part).coalesce(1).write.mode("append").parquet(path)
        source = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(path)
        if n == 1:  # a commit that dies after the log was written: the batch runs again
            dies = watch_stream.replace_text
            watch_stream.replace_text = lambda *_: (_ for _ in ()).throw(OSError("killed"))
            q = watch_stream.start(watch_stream.stream(source, SMALL), place, str(tmp_path / "check"), availableNow=True)
            with pytest.raises(Exception, match="killed"):
                q.awaitTermination()
            watch_stream.replace_text = dies
        q = watch_stream.start(watch_stream.stream(source, SMALL), place, str(tmp_path / "check"), availableNow=True)
        q.awaitTermination()
    log, newest = watch_stream.committed(spark, place)
    mark = (end + 1000.0 - 10.0) * 1e6
    batch = watch.run(frame(spark, rows + flush[0]), SMALL)
    want = [r for r in told(batch) if r[1] * 1e6 <= mark]
    got = [r for r in told(log) if r[0] != 99 and r[1] * 1e6 <= mark]
    assert got == want and {r[2] for r in got} == {"reading", "silence", "timer"} and any(r[4] == "resume" and r[2] == "reading" for r in got)
    last = {r[0]: r for r in want}
    assert {r.host: r.us / 1e6 for r in newest.collect() if r.host != 99} == {h: r[1] for h, r in last.items()}
    # a batch that ran to its end and is given again changes nothing
    before = told(log)
    watch_stream.keep(place)(log.limit(1), 0)
    assert told(watch_stream.committed(spark, place)[0]) == before


def test_documents_are_replaced_in_one_step(spark, tmp_path):
    path = f"{tmp_path}/a.json"
    assert files.read_text(spark, path) is None
    for k in (1, 2):
        files.write_json(spark, {"k": k, "é": "ü"}, path)
        assert files.read_text(spark, path) == '{\n  "k": %d,\n  "é": "ü"\n}\n' % k
    files.replace_text(spark, f"file://{path}", "plain")
    assert files.read_text(spark, path) == "plain" and [p.name for p in tmp_path.iterdir() if p.suffix == ".tmp"] == []
