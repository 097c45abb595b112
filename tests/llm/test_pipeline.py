import random

import corpus_pipeline


def test_stages_take_effect(spark, tmp_path):
    rng = random.Random(3)
    words = ["".join(rng.choice("aeioulmnrst") for _ in range(rng.randrange(3, 8))) for _ in range(600)]
    text = lambda n=80: " ".join(rng.choice(words) for _ in range(n))
    item = text(20)
    rows, labels = [], []
    for i in range(240):
        t = text()
        toxic = i % 6 == 0
        if toxic:
            t += " idiot moron scum idiot stupid"
        labels.append((i, 1, int(toxic)))
        if i % 5 == 1:
            t += "\nshared footer line of many sites"
        if i in (7, 8):
            t += " " + item + " " + text(10)
        rows.append((i, t, "en" if i % 2 else "fr", f"s{i % 8}", len(t)))
    rows.append((500, rows[13][1], "en", "s1", 9))
    rows.append((501, rows[14][1] + " more", "fr", "s2", 9))
    rows.append((None, None, None, None, None))
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").coalesce(1).write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([(0, item), (1, None)], "item_id long, text string").coalesce(1).write.parquet(str(tmp_path / "benchmark.parquet"))
    docs, kept = spark.read.parquet(str(tmp_path / "documents.parquet")), []
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, str(tmp_path)).write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        kept.append({r.doc_id: r for r in docs.collect()})
        if k < 4:
            assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    clean = {i for i in range(240) if i % 6}
    assert set(kept[0]) == clean | {500, 501, None}
    assert set(kept[1]) == set(kept[0]) and not any("footer" in (r.text or "") for r in kept[1].values())
    assert all(r.n_chars == len(r.text) for i, r in kept[1].items() if i is not None and i % 5 == 1 and i < 240)
    assert set(kept[2]) == clean | {None}
    assert set(kept[3]) == (clean | {None}) - {7, 8}
    assert set(kept[4]) < set(kept[3]) and None not in kept[4] and all(0 < r.p <= 1 for r in kept[4].values())


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def tables(spark, path, rows, schema=SCHEMA, labels=(), items=()):
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(list(labels), "doc_id long, quality int, toxic int").coalesce(1).write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame(list(items), "item_id long, text string").coalesce(1).write.parquet(f"{path}/benchmark.parquet")
    return str(path)


def test_empty_tables(spark, tmp_path):
    out = corpus_pipeline.run(spark, tables(spark, tmp_path, []))
    assert out.count() == 0 and out.columns[:5] == ["doc_id", "text", "lang", "source", "n_chars"]


def test_long_null_and_repeated_rows_and_other_columns(spark, tmp_path):
    rng = random.Random(1)
    long = " ".join(f"w{rng.randrange(5000)}" for _ in range(25_000))
    rows = [(1, long, "en", "s1", len(long), 1, "a"), (1, long, "en", "s1", len(long), 1, "a"), (2, None, None, None, None, 2, "b"), (3, "", "en", "s2", 0, 3, None), (None, "some words of its own", "fr", "s3", 21, 4, "c"), (4, long + " more", "en", "s4", len(long) + 5, 5, "d")]
    d = tables(spark, tmp_path, rows, SCHEMA + ", tf_row int, `a.b` string")
    docs = spark.read.parquet(f"{d}/documents.parquet")
    columns = docs.columns
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, d).write.parquet(f"{d}/{name}")
        docs = spark.read.parquet(f"{d}/{name}")
        if k < 4:
            assert docs.columns == columns
        if k == 2:
            assert sorted((r[0], r[5], r[6]) for r in docs.collect() if r[0] is not None) == [(1, 1, "a"), (2, 2, "b"), (3, 3, None)]
    assert {r[0] for r in docs.collect()} <= {1, None}


def test_tables_can_be_dropped(spark):
    from tallyforge.llm.common import drop_tables, materialise

    drop_tables(spark)
    out = materialise(spark.range(3).toDF("x"), "some")
    path = out.inputFiles()[0]
    assert out.count() == 3 and drop_tables(spark) == 1 and drop_tables(spark) == 0
    assert not spark._jvm.org.apache.hadoop.fs.Path(path).getFileSystem(spark._jsc.hadoopConfiguration()).exists(spark._jvm.org.apache.hadoop.fs.Path(path))
