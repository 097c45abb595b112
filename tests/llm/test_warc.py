import gzip
import hashlib
import io
import random

from pyspark.sql import functions as F

from tallyforge.llm import warc


def plain_records(data):
    """(headers, block) of each record, read by another path: whole, with gzip."""
    raw, out = gzip.decompress(data) if data[:2] == b"\x1f\x8b" else data, []
    f = io.BytesIO(raw)
    while line := f.readline():
        if line == b"\r\n":
            continue
        assert line == b"WARC/1.1\r\n"
        headers = {}
        while (line := f.readline()) != b"\r\n":
            k, _, v = line.decode().partition(":")
            headers[k.lower()] = v.strip()
        out.append((headers, f.read(int(headers["content-length"]))))
    return out


def rows():
    rng = random.Random(5)
    body = "<html>é" + "x" * 120 + "</html>"
    out = [(i, f"http://h/{i}", "".join(rng.choice("abc<>é \n") for _ in range(rng.randrange(0, 900))), "c") for i in range(40)]
    out += [(100 + i, f"http://c/{i}", body, "c") for i in range(60)] + [(50, None, body, "c"), (None, "http://n", body, "c"), (None, None, "n" * 200, "c"), (50, "http://twice", body, "c")]
    out += [(200, "short", "s" * 99, "c"), (201, "short", "s" * 99, "c"), (202, "just", "s" * 100, "c"), (203, "just\r\nWARC-Type: x", "s" * 100, "c")]
    out += [(300, "null", None, "c"), (301, "empty", "", "c"), (302, "long", "0123456789 WARC/1.1\r\n\r\n" * 200000, "c")]
    return out


def brute(rows):
    least, out = {}, []
    for i, _, html, _ in rows:
        if i is not None and len((html or "").encode()) >= 100:
            least[html] = min(i, least.get(html, i))
    for i, _, html, _ in rows:
        b, o = (html or "").encode(), least.get(html or "")
        again = o is not None and i != o
        out.append((i, len(b), hashlib.sha256(b).hexdigest(), "revisit" if again else "response", o if again else None))
    return sorted(out, key=str)


def test_against_brute_force(spark):
    df = spark.createDataFrame(rows(), "page_id long, url string, html string, digest string")
    assert sorted(map(tuple, warc.warc_report(df).collect()), key=str) == brute(rows())
    assert warc.warc_report(df.limit(0)).count() == 0


def test_the_archive_itself(spark, tmp_path):
    df = spark.createDataFrame(rows(), "page_id long, url string, html string, digest string").repartition(3)
    path = str(tmp_path / "a")
    warc.register(spark)
    warc.page_records(df).write.format("warc").mode("append").option("max_file_bytes", 2000).save(path)
    (tmp_path / "a" / "lost.warc.gz").write_bytes(b"an attempt that was lost")
    files = [f for f, _ in warc.archive_files(path)]
    assert len(files) > 3
    found = [r for f in files for r in plain_records(open(f, "rb").read())]
    texts = {(i, (h or "").encode()) for i, _, h, _ in rows()}
    assert len(found) == len(rows())
    for headers, block in found:
        if headers["warc-type"] == "response":
            payload = block.partition(b"\r\n\r\n")[2]
            assert "sha256:" + hashlib.sha256(payload).hexdigest() == headers["warc-payload-digest"]
            assert (int(headers["x-page-id"]) if "x-page-id" in headers else None, payload) in texts
        else:
            assert block == b"" and headers["warc-refers-to"] == "<urn:page:50>" or headers["warc-refers-to"] == "<urn:page:202>"
    # appended twice, read as both; overwritten, read as the new one
    warc.page_records(df.where("page_id = 1")).write.format("warc").mode("append").save(path)
    assert warc.read_archive(spark, path).count() == len(rows()) + 1
    warc.page_records(df.where("page_id = 1")).write.format("warc").mode("overwrite").save(path)
    assert [r.x_page_id for r in warc.read_archive(spark, path, "x_page_id long").collect()] == [1]


def test_filters_decide_on_headers(spark, tmp_path, monkeypatch):
    df = spark.createDataFrame(rows(), "page_id long, url string, html string, digest string")
    path = str(tmp_path / "b")
    warc.archive_pages(df, path)
    archive = warc.read_archive(spark, path, warc.SCHEMA + ", x_page_id long")
    everything = archive.collect()
    conditions = ["record_type = 'revisit'", "record_type != 'response'", "x_page_id >= 200 and record_type = 'response'", "x_page_id is null", "refers_to = 'urn:page:50' and target_uri like 'http://c/1%'", "target_uri in ('short', 'long')", "x_page_id <=> null", "content_length > 1000 and file is not null", "not (target_uri = 'short')", "headers['X-Page-Id'] = '7'", "x_page_id = 1 or x_page_id = 2"]
    for c in conditions:
        want = spark.createDataFrame(everything, archive.schema).where(c)
        got = archive.where(c)
        shown = lambda df: sorted(str(r.asDict() | {"headers": sorted(r.headers.items())}) for r in df.collect())
        assert shown(got) == shown(want), c
        assert want.count() > 0, c
    # what a pushed filter refuses is not inflated beyond its header, and a schema without payload takes none
    [name] = [f for f, _ in warc.archive_files(path)][:1]
    reader, (one, *_) = warc.WarcReader(path, archive.schema, 1 << 20), warc.archive_files(path)
    assert list(reader.pushFilters([warc.ds.EqualTo(("record_type",), "revisit"), warc.ds.EqualTo(("file",), name)])) == [warc.ds.EqualTo(("file",), name)]
    taken = []
    monkeypatch.setattr(warc.Member, "take", lambda self, n: taken.append(n) or b"")
    batches = list(reader.read(warc.Files([f for f, _ in warc.archive_files(path)])))
    assert sum(b.num_rows for b in batches) == sum(r.record_type == "revisit" for r in everything) and set(taken) == {0}
    taken.clear()
    slim = warc.WarcReader(path, archive.drop("payload").schema, 1 << 20)
    assert sum(b.num_rows for b in slim.read(warc.Files([f for f, _ in warc.archive_files(path)]))) == len(everything) and not taken


def test_foreign_archives(spark, tmp_path):
    """Plain files, gzip members that do not tell their length, folded headers, other record types."""
    big = b"y" * 3_000_000
    raw = [
        b"WARC/1.0\r\nWARC-Type: warcinfo\r\nContent-Length: 4\r\n\r\nsoft\r\n\r\n",
        b"WARC/1.0\r\nwarc-type: request\r\nWARC-Target-URI: <http://a>\r\nContent-Type: application/http\r\nContent-Length: 18\r\n\r\nGET / HTTP/1.1\r\n\r\n\r\n\r\n",
        b"WARC/1.0\r\nWARC-Type: response\r\nX-Long: one\r\n  two\r\nContent-Type: application/http; msgtype=response\r\nContent-Length: %d\r\n\r\nHTTP/1.1 200 OK\r\nA: b\r\n\r\n" % (25 + len(big)) + big + b"\r\n\r\n",
        b"WARC/1.0\r\nWARC-Type: resource\r\nContent-Type: text/plain\r\nContent-Length: 9\r\n\r\nlast\r\n\r\none\r\n\r\n"[:-1] + b"\n",
    ]
    raw[2] = raw[2].replace(b"%d" % (25 + len(big)), b"%d" % (len(b"HTTP/1.1 200 OK\r\nA: b\r\n\r\n") + len(big)))
    raw[3] = b"WARC/1.0\r\nWARC-Type: resource\r\nContent-Type: text/plain\r\nContent-Length: 8\r\n\r\nla\r\n\r\nst\r\n\r\n"
    (tmp_path / "x.warc").write_bytes(b"".join(raw))
    (tmp_path / "y.warc.gz").write_bytes(b"".join(map(gzip.compress, raw)))
    (tmp_path / "z.warc.gz").write_bytes(b"")
    for name in ("x.warc", "y.warc.gz"):
        got = warc.read_archive(spark, f"file://{tmp_path}/{name}", "record_type string, target_uri string, x_long string, content_length long, payload binary").collect()
        assert [(r.record_type, r.target_uri, r.x_long) for r in got] == [("warcinfo", None, None), ("request", "http://a", None), ("response", None, "one two"), ("resource", None, None)]
        assert [bytes(r.payload) for r in got] == [b"soft", b"", big, b"la\r\n\r\nst"]
        assert warc.read_archive(spark, str(tmp_path / name)).where("record_type = 'resource'").select("payload").first()[0] == b"la\r\n\r\nst"
    assert warc.read_archive(spark, str(tmp_path)).groupBy("file").agg(F.count("*").alias("n")).select("n").collect() == [(4,), (4,)]
    (tmp_path / "cut.warc").write_bytes(raw[0] + raw[2][:1000])
    try:
        warc.read_archive(spark, str(tmp_path / "cut.warc")).collect()
    except Exception as e:
        assert "cut off" in str(e)
    else:
        raise AssertionError
