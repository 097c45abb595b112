"""Publication audit, gates, receipts, bootstrap edges, files and streams on small inputs."""

import base64
import hashlib
import io
import json
import tarfile
import zipfile

import pytest
from pyspark.sql import functions as F

from tallyforge.operators import audit, bootstrap, guard, overlap, prepare, report, runlog, scan, scoring
from tallyforge.sources import io as files
from tallyforge.streaming.guard_stream import append_log, stream_machine

TASKS = "task_id string, answers array<string>, category string, question string"


@pytest.fixture(scope="module")
def published(spark):
    gold = spark.createDataFrame([(i, "k", f"g{i % 3}", i % 2, "test", "main", f"text {i}", 10 * i) for i in range(12)], "example_id int, task_id string, agreement_id string, label int, split string, data_type string, text string, prompt_tokens int")
    tasks = spark.createDataFrame([("k", ["off", "on"], "c", "q")], TASKS)
    flagged = spark.createDataFrame([(3,), (3,), (5,)], "example_id int")
    raw = F.when(F.col("example_id") == 4, "no idea").otherwise(F.concat(F.lit(" "), F.char(65 + F.col("label")), F.lit("\n")))
    return gold, tasks, flagged, audit.prediction_records(gold, tasks, flagged, raw)


def test_records_and_their_checks(published):
    gold, tasks, flagged, records = published
    r = {x.example_id: x for x in records.collect()}
    assert r[4].prediction == -1 and r[7].prediction == 1 and r[3].train_overlap and not r[4].train_overlap
    assert r[2].text_sha256 == hashlib.sha256(b"text 2").hexdigest() and r[0].length_bucket == "unknown" and r[1].length_bucket == "0-1024"
    broken = lambda p: {(x.rule, x.example_id) for x in audit.published_violations(gold, p, tasks, flagged).collect()}
    change = lambda column, value: records.withColumn(column, F.when(F.col("example_id") == 7, value).otherwise(F.col(column)))
    assert broken(records) == set()
    assert broken(change("text_sha256", F.lit("x"))) == {("text_sha256_differs", 7)}
    assert broken(change("data_type", F.lit(None))) == {("data_type_differs", 7)}
    assert broken(change("train_overlap", F.lit(True))) == {("train_overlap_differs", 7)}
    assert broken(change("valid_answers", F.array(F.lit("on"), F.lit("off")))) == {("valid_answers_differs", 7)}
    assert broken(change("raw_output", F.lit("A"))) == {("raw_output_differs", 7)}
    assert broken(records.where("example_id <> 7")) == {("missing", 7)}


def test_majority_prompts_and_comparison(spark, published):
    gold, tasks, _, records = published
    train = gold.withColumn("split", F.lit("train")).where("label = 1 or example_id < 4")
    right = records.withColumn("prediction", F.lit(1))
    assert audit.majority_violations(right, train, tasks).count() == 0
    assert [r.example_id for r in audit.majority_violations(right.withColumn("prediction", F.when(F.col("example_id") == 2, 0).otherwise(1)), train, tasks).collect()] == [2]
    asked = records.withColumn("prompt_tokens_sha256", F.sha2(F.col("example_id").cast("string"), 256))
    other = asked.where("example_id <> 9").withColumn("prompt_tokens_sha256", F.when(F.col("example_id") == 8, "x").otherwise(F.col("prompt_tokens_sha256")))
    assert {(r.field, r.example_id) for r in audit.prompt_mismatches(asked, other).collect()} == {("prompt_tokens_sha256", 8), ("example_id", 9)}
    cover = spark.createDataFrame([("k", True, [1], [])], "task_id string, eligible boolean, rare_labels array<int>, unsupported_labels array<int>")
    better = audit.compare_branches(asked.withColumn("prediction", F.lit(0)), asked, tasks, cover).first()
    assert better.promising and better.mismatches == 0 and better.control_rare_correct == 0 and better.other_rare_precision == 1
    worse = audit.compare_branches(asked, other, tasks, cover).first()
    assert not worse.promising and worse.mismatches == 2
    scores, errors = audit.rescore(gold, records, tasks, cover)
    assert scores.first().n == 12 and [r.example_id for r in errors.collect()] == [4]
    with pytest.raises(ValueError, match="missing"):
        audit.rescore(gold, records.where("example_id > 0"), tasks, cover)
    got = audit.receipt(records.withColumn("system", F.lit("s")), tasks, cover).first()
    assert (got.rows, got.rare_n, got.rare_correct) == (12, 6, 6) and got.accuracy == pytest.approx(11 / 12)


def test_gates(spark, tmp_path):
    record = spark.createDataFrame([("f", "c", 3)], "freeze_sha256 string, config_sha256 string, epoch int")
    audit.open_test(record, record, ["freeze_sha256", "config_sha256"])
    with pytest.raises(ValueError, match="sealed"):
        audit.open_test(None, record, ["freeze_sha256"])
    with pytest.raises(ValueError, match="does not fit"):
        audit.open_test(record, record.withColumn("config_sha256", F.lit("other")), ["freeze_sha256", "config_sha256"])
    audit.register_parent(record, {"epoch": 3, "freeze_sha256": "f"}, str(tmp_path / "receipt"))
    assert spark.read.json(str(tmp_path / "receipt")).first().epoch == 3
    with pytest.raises(Exception, match="exists"):
        audit.register_parent(record, {"epoch": 3}, str(tmp_path / "receipt"))
    with pytest.raises(ValueError, match="expected state"):
        audit.register_parent(record, {"epoch": 2}, str(tmp_path / "other"))


def test_bootstrap_edges(spark):
    rows = spark.createDataFrame([(0, "k", 0, 0, "a"), (1, "k", 1, 0, "b"), (2, "j", 1, 1, "b")], "example_id int, task_id string, label int, prediction int, agreement_id string")
    tasks = spark.createDataFrame([("k", ["x", "y"], "c", "q"), ("j", ["x", "y"], "c", "q")], TASKS)
    cover = spark.createDataFrame([("k", True, [1]), ("j", True, [1])], "task_id string, eligible boolean, rare_labels array<int>")
    both = rows.withColumn("system", F.lit("left")).unionByName(rows.withColumn("system", F.lit("right")).withColumn("prediction", F.col("label")))
    weights = spark.createDataFrame([(0, "a", 2), (1, "a", 1), (1, "b", 1), (2, "b", 2)], "rep long, agreement_id string, w long")
    m = bootstrap.missing_tasks(rows, weights, cover).first()
    assert (m.replicates, m.replicates_missing_tasks) == (3, 1)
    rare = {r.rep: (r.left, r.right) for r in bootstrap.rare_recall_replicates(both, weights, cover).collect()}
    assert rare == {0: (None, None), 1: (0.5, 1.0), 2: (0.5, 1.0)}
    assert audit.paired_bootstrap(both, weights, tasks, cover).count() == 3
    with pytest.raises(ValueError, match="no_eligible_task"):
        audit.paired_bootstrap(both, weights, tasks, cover.withColumn("eligible", F.lit(False)))
    with pytest.raises(ValueError, match="left_missing"):
        audit.paired_bootstrap(both.where("system = 'right' or example_id > 0"), weights, tasks, cover)


def test_schema_has_four_attributes(spark):
    rows = spark.createDataFrame([("k", "q", "s", "c", "t1", 0, "x"), ("k", "q", "s", "c", None, 1, "y")], "task_id string, question string, subquestion string, category string, text_type string, label int, target string")
    assert {r.rule for r in prepare.schema_violations(rows).collect()} == {"attributes"}
    assert prepare.schema_violations(rows.withColumn("text_type", F.lit("t"))).count() == 0


def test_positions_and_sequences(spark):
    df = spark.range(1000).select((F.col("id") * 7919 % 1000).alias("example_id"))
    assert [r.pos for r in runlog.positions(df.repartition(7), ["example_id"]).orderBy("example_id").collect()] == list(range(1000))
    assert sorted(r.pos for r in runlog.seeded_order(df, "s", 1).collect()) == list(range(1000)) and runlog.seeded_order(df.limit(0), "s", 1).count() == 0
    h = runlog.sequence_hash(df.withColumns({"g": F.col("example_id") % 2, "p": F.col("example_id")}), "example_id", "p", ["g"]).collect()
    assert {(r.g, r.n, r.sequence_sha256) for r in h} == {(g, 500, hashlib.sha256("\n".join(str(i) for i in range(g, 1000, 2)).encode()).hexdigest()) for g in (0, 1)}
    assert runlog.steps(33, 16, 2, 0.03) == {"per_epoch": 3, "total": 6, "warm_up": 1} and runlog.runtime_estimate(7200, 0.5, 3, 1200) == 2.0
    assert sorted(r.row for r in runlog.numpy_order(spark, 9, 5, 1).collect()) == list(range(9))


def test_guard_fails_safe(spark):
    good = (70, 60, 200, 3000000, False)
    rows = [(1, i, float(i), *good) for i in range(3)] + [(1, 3, 3.0, None, *good[1:]), (1, 4, 4.0, 70, 60, 200, 3000000, None), (2, 5, 1.0, 140, *good[1:])]
    schema = "host long, event_id long, s double, cpu_c int, gpu_c int, gpu_limit_w int, cpu_max_khz int, slowdown boolean"
    df = spark.createDataFrame(rows, schema).withColumn("ts", F.timestamp_seconds("s")).drop("s")
    log = {r.event_id: (r.decision, r.action, r.paused) for r in guard.run_machine(df).collect()}
    assert log[2] == ("cool", "none", False) and log[3] == ("sensor_failure", "pause", True) and log[4] == ("sensor_failure", "none", True) and log[5][1] == "pause"
    assert {r.event_id for r in guard.invalid(df).collect()} == {3, 4, 5}
    assert guard.several_devices(df.union(df.limit(1))).first().devices == 2
    assert {(r.host, r.action) for r in guard.stopping(guard.run_machine(df.where("event_id < 3 or host = 2"))).collect()} == {(1, "pause"), (2, "none")}


def test_guard_stream_goes_on_after_a_restart(spark, tmp_path):
    rows = [(1, i, float(i * 5), 90 if i in (2, 30) else 70, 60, 200, 3000000, False) for i in range(60)]
    df = spark.createDataFrame(rows, "host long, event_id long, s double, cpu_c int, gpu_c int, gpu_limit_w int, cpu_max_khz int, slowdown boolean").withColumn("ts", F.timestamp_seconds("s")).drop("s")
    for lo, hi in ((0, 10), (10, 60)):
        df.where(f"event_id >= {lo} and event_id < {hi}").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = stream_machine(spark.readStream.schema(df.schema).parquet(str(tmp_path / "in")))
        q = append_log(stream, str(tmp_path / "log"), str(tmp_path / "check"))
        q.processAllAvailable()
        q.stop()
    got = {tuple(r) for r in spark.read.parquet(str(tmp_path / "log")).collect()}
    assert got == {tuple(r) for r in guard.run_machine(df).collect()} and sum(r[3] == "resume" for r in got) == 2


def test_paths_and_rules(spark):
    paths = {"a/b.txt": None, "/a": "absolute_or_backslash", "a\\b": "absolute_or_backslash", "a/../b": "parent", "a/.aws/x": "component", "x/secrets/y": "component", "K.PEM": "suffix", "m.safetensors": "suffix", ".pem": None, "a.tar.key": "suffix", ".env": "name", ".ENV.x": "name", "Credentials.json": "name", "my-cookies-1": "name", "a.token/b": None, "": None}
    df = spark.createDataFrame([(p,) for p in paths], "p string")
    assert {r.p: r.rule for r in df.select("p", scan.unsafe_path(F.col("p")).alias("rule")).collect()} == paths
    assert all(scan._unsafe(p) == (rule is not None) for p, rule in paths.items())
    texts = spark.createDataFrame([("n", "one\nsee /home/me/x and /Users/you\nhost.internal, not.internal-x 10.0.0.1.5 10.0.0.9 10.0.0.0/8\nhttps://u:p@h \u2060 Term term"), ("m", None)], "name string, text string")
    assert {(r.rule, r.line, r.n) for r in scan.line_findings(texts).collect()} == {("personal_path", 2, 2), ("private_dns", 3, 1), ("url_credential", 4, 1), ("hidden_control", 4, 1)}
    assert [(r.line, r.address) for r in scan.private_ipv4(texts).collect()] == [(3, "10.0.0.9")]
    assert [(r.line, r.n) for r in scan.term_search(texts, ["TERM", " "]).collect()] == [(4, 2)]
    field = 'prompt_tokens_sha256": "' + "a" * 64 + '"'
    m, n = scan.mask_digests(F.lit(f'"{field}, "x_{field}, "other_sha256": "' + "b" * 64 + '"'))
    row = spark.range(1).select(m.alias("m"), n.alias("n")).first()
    assert row.n == 1 and row.m.count("SHA256_DIGEST") == 1 and "b" * 64 in row.m
    named = spark.createDataFrame([("a/id_rsa", "same /home/x"), ("b/id_rsa", "same /home/x")], "name string, text string")
    found = scan.findings(named, [], "name")
    assert {(r.rule, r.name) for r in found.collect()} == {("unsafe_name", "a/id_rsa"), ("unsafe_name", "b/id_rsa"), ("personal_path", "a/id_rsa")}
    assert not scan.scan_summary(named, found).first().passed and scan.scan_summary(named, found.limit(0)).first().passed
    assert scan.allowed_link("AGENTS.md", b"CLAUDE.md", True, b"") and not scan.allowed_link("AGENTS.md", b"CLAUDE.md", True, b"x")


def test_what_archives_say_of_themselves():
    z = io.BytesIO()
    with zipfile.ZipFile(z, "w") as f:
        f.comment = b"made at /home/me"
        info = zipfile.ZipInfo("a.txt")
        info.comment = b"note"
        f.writestr(info, "text")
        f.writestr("x/.ssh/key", "k")
    names = {n: (c, p) for n, c, p in scan.expand("z", z.getvalue())}
    assert names["z!comment"][0] == b"made at /home/me" and names["z!a.txt!comment"][0] == b"note" and names["z!x/.ssh/key"] == (None, "unsafe_member")
    locked = bytearray(z.getvalue())
    for mark, at in ((b"PK\x01\x02", 8), (b"PK\x03\x04", 6)):
        locked[locked.index(mark) + at] |= 1
    assert ("l!a.txt", None, "encrypted") in list(scan.expand("l", bytes(locked)))
    t = io.BytesIO()
    with tarfile.open(fileobj=t, mode="w", format=tarfile.PAX_FORMAT) as f:
        info = tarfile.TarInfo("b.txt")
        info.size, info.uname, info.pax_headers = 1, "someone", {"comment": "hidden"}
        f.addfile(info, io.BytesIO(b"x"))
    found = list(scan.expand("t", t.getvalue()))
    assert ("t!b.txt", None, "owner_identity") in found and any(n == "t!b.txt!pax" and b"hidden" in c for n, c, _ in found if c)
    bad = b"data:text/plain;base64,QUJ=D " + b"data:text/plain;base64," + base64.b64encode(b"fine")
    assert any(c == b"fine" for _, c, _ in scan.expand("d", bad))


def test_reports(spark):
    pages = spark.createDataFrame([(1, '<html><body>two words <img src=x alt="three more here"><script>no</script></body>'), (2, "<body>" + "w " * 3001)], "page_id int, html string")
    counted = report.html_words(pages)
    assert {r.page_id: (r.words, r.allowed) for r in counted.collect()} == {1: (5, True), 2: (3001, False)}
    with pytest.raises(ValueError, match="3001"):
        report.require_short(counted)
    values = spark.createDataFrame([("n", 5), ("m", 6)], "name string, value int")
    prose = spark.createDataFrame([("n", 5), ("m", 7), ("o", 1)], "name string, expected int")
    assert {r.name for r in report.golden(values, prose).where("not holds").collect()} == {"m", "o"}
    t = spark.createDataFrame([("{{A}} and {{B_1}} {{low}}",)], "template string")
    assert t.select(report.fill(F.col("template"), {"A": F.lit(1), "B_1": F.lit(None)}).alias("x")).first().x == "1 and  {{low}}"
    assert [r.unresolved for r in report.unresolved(t, ["A"]).collect()] == ["B_1"]


def test_documents_metadata_and_splits(spark, tmp_path):
    path = str(tmp_path / "doc.json")
    files.write_json(spark, {"a": "é", "b": [1]}, path)
    files.write_json(spark, {"a": "é", "b": [2]}, path)
    assert json.loads((tmp_path / "doc.json").read_text()) == {"a": "é", "b": [2]} and "é" in (tmp_path / "doc.json").read_text()
    assert files.read_json(spark, path, "a string, b array<int>").first().b == [2]
    with pytest.raises(ValueError):
        files.write_json(spark, {"x": float("nan")}, path)
    m = files.run_metadata(spark, {"b": 1, "a": 2}, "c0ffee", False, {"freeze": path})
    assert m.first().config_sha256 == files.config_hash({"a": 2, "b": 1}) and m.first().freeze_sha256 == hashlib.sha256((tmp_path / "doc.json").read_bytes()).hexdigest()
    rows = spark.createDataFrame([(i, s) for i, s in enumerate(["train", "validation", "test"] * 4)], "example_id int, split string")
    out = str(tmp_path / "splits")
    files.write_splits(rows.where("split = 'train'"), out)
    assert files.write_missing(rows, out, ["train", "validation", "test"]) == ["validation", "test"] and files.write_missing(rows, out, ["train", "test"]) == []
    assert {r.split: r["count"] for r in spark.read.parquet(out).groupBy("split").count().collect()} == {"train": 4, "validation": 4, "test": 4}
    assert [r.row_number for r in files.with_line_numbers(rows, "example_id").orderBy("example_id").collect()] == list(range(2, 14))


def test_conflicts(spark):
    rows = spark.createDataFrame([(1, "k", "a", "train", 0, "same"), (2, "k", "b", "test", 1, "same"), (3, "k", "a", "test", 0, "other")], "example_id int, task_id string, agreement_id string, split string, label int, norm string")
    groups = overlap.exact_groups(rows)
    assert overlap.conflicting(groups).count() == 1 and [r.example_id for r in overlap.seen_exact(rows).collect()] == [2]
    cover = spark.createDataFrame([("k", [1], [])], "task_id string, rare_labels array<int>, unsupported_labels array<int>")
    wrong = rows.withColumns({"prediction": F.lit(-1), "prompt_tokens": F.lit(3000)})
    tags = {r.example_id: r.tags for r in scoring.error_rows(wrong, cover, overlap.seen_exact(rows)).collect()}
    assert tags[2] == ["invalid_format", "rare_label", "long_passage", "train_lexical_overlap"] and tags[3] == ["invalid_format", "long_passage"]
