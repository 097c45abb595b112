import gzip
import hashlib
import io
import random
import tracemalloc
import zipfile

import pytest
from pyspark.sql import functions as F

from tallyforge.operators import scan, terms
from tallyforge.sources import blocks


def test_terms_against_one_after_the_other(spark):
    rng = random.Random(1)
    texts = [(f"n{i}", "\n".join("".join(rng.choice("abAB ") for _ in range(rng.randrange(0, 60))) for _ in range(4))) for i in range(40)] + [("null", None), ("empty", ""), ("long", "ab" * 100_000)]
    words = sorted({"".join(rng.choice("abAB") for _ in range(rng.randrange(1, 6))) for _ in range(60)} | {"aa", "aaa"})
    df = spark.createDataFrame(texts, "name string, text string")
    table = spark.createDataFrame([(w,) for w in [*words, " ", None, "a\nb"]], "term string")
    want = {}
    spelled = {}
    for w in words:
        spelled[w.lower()] = min(w, spelled.get(w.lower(), w))
    for name, text in texts:
        for number, line in enumerate((text or "").split("\n"), 1):
            for low, term in spelled.items():
                if n := line.lower().count(low):
                    want[name, term, number] = n
    for size in (terms.BLOCK_BYTES, 40):
        got = {(r.name, r.term, r.line): r.n for r in terms.search_terms(df, table, size).collect()}
        assert got == want
    assert terms.search_terms(df, table.limit(0)).count() == 0
    one = scan.term_search(df.where("text is not null"), ["ab", "aa"])
    assert {(r.name, r.line): r.n for r in one.where("term = 'aa'").collect()} == {(k[0], k[2]): n for k, n in want.items() if k[1] == spelled["aa"]}


def test_too_many_terms_are_an_error(spark, monkeypatch):
    monkeypatch.setattr(terms, "MOST_BYTES", 10)
    with pytest.raises(ValueError, match="bytes of terms"):
        terms.search_terms(spark.createDataFrame([("a", "b")], "name string, text string"), spark.createDataFrame([("long enough",)], "term string"))


def test_members_leave_one_at_a_time(spark):
    """A zip of many large members is never held unpacked, and bounds of depth are findings."""
    z = io.BytesIO()
    with zipfile.ZipFile(z, "w", zipfile.ZIP_DEFLATED) as f:
        for k in range(40):
            f.writestr(f"m{k}.txt", b"x" * (2 << 20))
    tracemalloc.start()
    n = sum(1 for _ in scan.Members().eval("big.zip", z.getvalue()))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert n == 41 and peak < 20 << 20
    deep = b"end"
    for _ in range(9):
        deep = gzip.compress(deep)
    df = spark.createDataFrame([("deep", deep), ("null", None), ("bad", b"\xff\xfe"), (None, b"see /home/me/x")], "path string, content binary")
    got = {(r.name, r.rule, r.line) for r in scan.archive_findings(df).collect()}
    assert {("deep" + "!gz" * 7, "too_large_or_deep", None), ("bad", "undecodable", None), ("", "personal_path", 1)} == got
    assert scan.archive_findings(df.limit(0)).count() == 0


def test_block_hashes(spark, tmp_path, monkeypatch):
    data = {"a.bin": b"", "b.bin": b"x" * (blocks.BLOCK + 5), "deep/c.bin": b"c", "_hidden": b"h", ".h/x": b"h"}
    for name, content in data.items():
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_bytes(content)
    root = str(tmp_path)
    got = {r.path.removeprefix(root + "/"): (r.size, r.blocks, r.sha256) for r in blocks.block_hashes(spark, f"file://{root}", 10).collect()}
    assert got == {n: (len(c), -(-len(c) // blocks.BLOCK), hashlib.sha256(c).hexdigest()) for n, c in data.items() if not n.startswith(("_", "."))}
    assert blocks.block_hashes(spark, f"{root}/b.bin").first().size == blocks.BLOCK + 5
    manifest = spark.createDataFrame([("a.bin", got["a.bin"][2]), ("b.bin", "0"), ("gone", "1")], "name string, sha256 string")
    assert {tuple(r) for r in blocks.freeze_check(spark, root, manifest).collect()} == {("b.bin", "changed"), ("gone", "missing"), ("deep/c.bin", "added")}


def test_a_file_that_no_cell_can_hold(spark, tmp_path):
    """Over 2 GB, sparse on disk: hashed by blocks of 1 MiB."""
    size = (2 << 30) + 4097
    with open(tmp_path / "large.bin", "wb") as f:
        f.truncate(size)
    h, zero = hashlib.sha256(), bytes(1 << 20)
    for _ in range(size >> 20):
        h.update(zero)
    h.update(bytes(size & ((1 << 20) - 1)))
    row = blocks.block_hashes(spark, str(tmp_path)).select("size", "sha256", F.lit(1)).first()
    assert (row[0], row[1]) == (size, h.hexdigest())
