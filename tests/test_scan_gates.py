from tallyforge.operators import scan
from tallyforge.plans import registry


def test_texts_without_anything_to_find_are_not_split(spark):
    hits = ["x\n/Users/me/a", "see /home/you", "C:\\Users\\me", "c:\\users\\me", "a.TS.NET", "host.Internal\nb.local", "HTTPS://a:b@c", "a\u200bb", "plain\ntext", "", "mail a@b", "http://x/y"]
    df = spark.createDataFrame([(f"n{i}", t) for i, t in enumerate(hits)], "name string, text string")
    got = scan.line_findings(df)
    assert '"/users/"' in got._jdf.queryExecution().optimizedPlan().toString() or "/users/" in got._jdf.queryExecution().optimizedPlan().toString()
    every = scan.line_findings(df, dict(scan.LINE_RULES)).collect()
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, every)) and len(every) >= 8


def test_no_file_is_held_whole(spark, tmp_path):
    spark.range(10).write.parquet(str(tmp_path / "a.parquet"))
    spark.range(5).coalesce(1).write.parquet(str(tmp_path / "b.parquet"))
    df = registry.QUERIES["freeze_check"](spark, str(tmp_path))
    assert "binaryFile" not in df._jdf.queryExecution().toString() and df.count() >= 2
