"""Evaluation relations derived from the order, document and event tables, for the registered queries."""

from __future__ import annotations

import base64
import gzip
import io
import tarfile
import zipfile

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType

from tallyforge.operators import prepare

ANSWERS = ["no", "yes", "partial", "never"]
SEED = "exam-v1"


def read(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def exam(spark: SparkSession, d: str) -> DataFrame:
    """Gold examples with their split, one per order."""
    k = F.col("o_orderkey")
    rows = read(spark, d, "orders").join(read(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey")).select(
        k.alias("example_id"), F.concat(F.lit("contract_"), (F.col("o_custkey") % 152).cast("string")).alias("agreement_id"),
        F.col("c_mktsegment").alias("question"), F.col("o_orderstatus").alias("subquestion"), F.concat_ws("|", "c_mktsegment", "o_orderstatus").alias("task_id"),
        F.col("c_mktsegment").alias("category"), F.when(k % 25 == 0, 2).when(k % 4 == 0, 1).otherwise(0).alias("label"),
        F.when(k % 5 < 2, "abridged").otherwise("main").alias("data_type"), (F.floor("o_totalprice").cast("long") % 5000).alias("prompt_tokens"),
    )
    return prepare.propagate_split(rows, prepare.group_split(rows.select("agreement_id"), SEED))


def tasks(rows: DataFrame) -> DataFrame:
    """One row per task with its ordered answers."""
    return rows.groupBy("task_id").agg(F.min("question").alias("question"), F.min("subquestion").alias("subquestion"), F.min("category").alias("category")).withColumn("answers", F.array(*map(F.lit, ANSWERS)))


def left(rows: DataFrame) -> DataFrame:
    k = F.col("example_id")
    return rows.withColumn("prediction", F.when(k % 37 == 0, -1).when(k % 3 == 0, 0).otherwise(F.col("label")))


def right(rows: DataFrame) -> DataFrame:
    k = F.col("example_id")
    return rows.withColumn("prediction", F.when(k % 41 == 0, -1).when(k % 7 == 0, 0).when(k % 90 == 1, 2).otherwise(F.col("label")))


def docs_exam(spark: SparkSession, d: str, docs: DataFrame | None = None) -> DataFrame:
    """Documents as examples: the source is the agreement, the language the task and text type.

    ``docs`` may be the documents in another form, whose further columns are kept.
    """
    labels = read(spark, d, "labels").select(F.col("doc_id").alias("l_id"), "quality", "toxic")
    docs = read(spark, d, "documents") if docs is None else docs
    more = [c for c in docs.columns if c not in ("doc_id", "text", "lang", "source", "n_chars")]
    rows = docs.join(labels, docs.doc_id == labels.l_id, "left").select(
        F.col("doc_id").alias("example_id"), F.col("source").alias("agreement_id"), F.col("lang").alias("task_id"), F.col("lang").alias("text_type"),
        F.coalesce("quality", F.lit(0)).cast("int").alias("label"), "text", F.when(F.col("doc_id") % 5 < 2, "abridged").otherwise("main").alias("data_type"), F.length("text").alias("prompt_tokens"), *more,
    )
    return prepare.propagate_split(rows, prepare.group_split(rows.select("agreement_id"), SEED, 14, 3))


def docs_tasks(rows: DataFrame) -> DataFrame:
    """One task for each language, with two answers."""
    return rows.select("task_id").distinct().withColumns({"question": F.col("task_id"), "category": F.col("task_id"), "answers": F.array(*map(F.lit, ANSWERS[:2]))})


def runlog(spark: SparkSession, d: str) -> DataFrame:
    e = read(spark, d, "events")
    i = F.col("event_id")
    return e.select((i + 1).alias("global_step"), F.col("value").alias("loss"), F.floor(i / 100).alias("epoch_no"), F.floor(i / 16).alias("batch"), F.when(F.col("event_type") == "error", 3.0).otherwise(1.0).alias("weight"), i.alias("pos"))


def readings(spark: SparkSession, d: str) -> DataFrame:
    e = read(spark, d, "events")
    k = F.coalesce(F.get_json_object("props", "$.k").cast("int"), F.lit(0))
    i = F.col("event_id")
    return e.select(
        "event_id", F.col("user_id").alias("host"), "ts", (60 + i % 30).alias("cpu_c"), (60 + k % 25).alias("gpu_c"), F.when(i % 500 == 0, 350).otherwise(200).alias("gpu_limit_w"),
        ((F.col("event_type") == "error") & (k > 90)).alias("slowdown"), F.lit(3000000).alias("cpu_max_khz"),
    )


def _pack(page_id: int, url: str, html: str) -> bytes:
    """A page in one of six shapes, by its id."""
    raw, out = html.encode(), io.BytesIO()
    kind = page_id % 6
    if kind == 0:
        return gzip.compress(raw, mtime=0)
    if kind == 1:
        with zipfile.ZipFile(out, "w") as z:
            z.comment = b"made of a page"
            for name, content in (("index.html", raw), ("more/inner.gz", gzip.compress(url.encode(), mtime=0)), ("../outside.html", raw)):
                z.writestr(zipfile.ZipInfo(name), content)
        return out.getvalue()
    if kind == 2:
        with tarfile.open(fileobj=out, mode="w", format=tarfile.USTAR_FORMAT) as t:
            for name, content in (("index.html", raw), ("keys/page.pem", b"x")):
                info = tarfile.TarInfo(name)
                info.size = len(content)
                t.addfile(info, io.BytesIO(content))
        return out.getvalue()
    if kind == 3:
        return raw + b'\n<img src="data:text/plain;base64,' + base64.b64encode(url.encode()) + b'">'
    if kind == 4:
        whole = gzip.compress(raw, mtime=0)
        return whole[: min(len(raw) // 8 + 12, len(whole) - 8)]  # cut before its end, however well the page packs
    return gzip.compress(gzip.compress(raw + b"\x00", mtime=0), mtime=0)


def packed(spark: SparkSession, d: str) -> DataFrame:
    """(path, content): every page packed into an archive or a text."""
    pack = F.pandas_udf(lambda i, u, h: pd.Series([_pack(int(a), b or "", c or "") for a, b, c in zip(i, u, h, strict=True)]), BinaryType())
    return read(spark, d, "pages").select(F.concat(F.lit("page-"), F.col("page_id").cast("string")).alias("path"), pack("page_id", "url", "html").alias("content"))


# The same relations in SQL, as common table expressions.
#: What ``packed`` holds, member by member: a text, a problem, or neither for a payload that is packed itself.
MEMBERS = """
mp AS (SELECT 'page-' || page_id::VARCHAR AS path, page_id % 6 AS kind, coalesce(url, '') AS url, coalesce(html, '') AS html FROM pages),
me AS MATERIALIZED (SELECT path AS name, CASE WHEN kind = 3 THEN html || chr(10) || '<img src="data:text/plain;base64,' || base64(encode(url)) || '">' END AS text, NULL::VARCHAR AS problem FROM mp
UNION ALL SELECT path || '!gz', html, NULL FROM mp WHERE kind = 0
UNION ALL SELECT path || m.n, CASE m.n WHEN '!comment' THEN 'made of a page' WHEN '!index.html' THEN html WHEN '!more/inner.gz!gz' THEN url END, CASE m.n WHEN '!../outside.html' THEN 'unsafe_member' END FROM mp, (SELECT unnest(['!comment', '!index.html', '!more/inner.gz', '!more/inner.gz!gz', '!../outside.html']) AS n) m WHERE kind = 1
UNION ALL SELECT path || m.n, CASE m.n WHEN '!index.html' THEN html END, CASE m.n WHEN '!keys/page.pem' THEN 'unsafe_member' END FROM mp, (SELECT unnest(['!index.html', '!keys/page.pem']) AS n) m WHERE kind = 2
UNION ALL SELECT path || '!data0', url, NULL FROM mp WHERE kind = 3
UNION ALL SELECT path, NULL, 'unreadable' FROM mp WHERE kind = 4
UNION ALL SELECT path || '!gz', NULL, NULL FROM mp WHERE kind = 5 UNION ALL SELECT path || '!gz!gz', html || chr(0), 'nul' FROM mp WHERE kind = 5)
"""
#: What a relation exam gives: support, training counts, rare labels, eligible tasks.
SUPPORT = """
labels4 AS (SELECT unnest([0, 1, 2, 3]) AS label),
spine AS (SELECT task_id, category, question, label FROM (SELECT DISTINCT task_id, category, question FROM exam), labels4),
support AS (SELECT s.task_id, s.label, count(e.example_id) AS n, count(DISTINCT e.agreement_id) AS agreements
  FROM spine s LEFT JOIN exam e ON e.task_id = s.task_id AND e.label = s.label AND e.split = 'train' GROUP BY ALL),
train AS (SELECT t.task_id, count(e.example_id) AS examples, count(DISTINCT e.agreement_id) AS agreements FROM (SELECT DISTINCT task_id FROM exam) t LEFT JOIN exam e ON e.task_id = t.task_id AND e.split = 'train' GROUP BY ALL),
rare AS (SELECT s.task_id, s.label FROM support s JOIN train t USING (task_id) WHERE s.n * 1.0 / greatest(1, t.examples) <= 0.1),
eligible AS (SELECT t.task_id, t.agreements >= 10 AND sum(CASE WHEN s.agreements >= 3 THEN 1 ELSE 0 END) >= 2 AS eligible FROM train t JOIN support s USING (task_id) GROUP BY t.task_id, t.agreements)
"""
EXAM = f"""
x0 AS (SELECT o_orderkey AS example_id, 'contract_' || (o_custkey % 152)::VARCHAR AS agreement_id, c_mktsegment AS question, o_orderstatus AS subquestion,
  c_mktsegment || '|' || o_orderstatus AS task_id, c_mktsegment AS category,
  CASE WHEN o_orderkey % 25 = 0 THEN 2 WHEN o_orderkey % 4 = 0 THEN 1 ELSE 0 END AS label,
  CASE WHEN o_orderkey % 5 < 2 THEN 'abridged' ELSE 'main' END AS data_type, CAST(floor(o_totalprice) AS BIGINT) % 5000 AS prompt_tokens
  FROM orders JOIN customer ON o_custkey = c_custkey),
groups AS (SELECT agreement_id, CASE WHEN rn <= 106 THEN 'train' WHEN rn <= 129 THEN 'validation' ELSE 'test' END AS split FROM (
  SELECT agreement_id, row_number() OVER (ORDER BY sha256('exam-v1:' || agreement_id)) AS rn FROM (SELECT DISTINCT agreement_id FROM x0))),
exam AS MATERIALIZED (SELECT x0.*, split FROM x0 JOIN groups USING (agreement_id)),
{SUPPORT},
pred_left AS (SELECT *, CASE WHEN example_id % 37 = 0 THEN -1 WHEN example_id % 3 = 0 THEN 0 ELSE label END AS prediction FROM exam),
pred_right AS (SELECT *, CASE WHEN example_id % 41 = 0 THEN -1 WHEN example_id % 7 = 0 THEN 0 WHEN example_id % 90 = 1 THEN 2 ELSE label END AS prediction FROM exam)
"""


def scores_sql(source: str, keys: list[str]) -> str:
    """CTEs ls (label statistics) and ts (task statistics) of a prediction relation, by further keys."""
    k = "".join(f"{x}, " for x in keys)
    on = "".join(f" AND p.{x} = s.{x}" for x in keys)
    return f"""
pr AS MATERIALIZED (SELECT * FROM {source}),
keyed AS (SELECT DISTINCT {k}task_id FROM pr),
sp AS (SELECT {"".join(f"keyed.{x}, " for x in keys)}spine.* FROM keyed JOIN spine USING (task_id)),
ls AS MATERIALIZED (SELECT {"".join(f"s.{x}, " for x in keys)}s.task_id, s.category, s.question, s.label,
  count(*) FILTER (p.label = s.label AND p.prediction = s.label) AS tp, count(*) FILTER (p.label <> s.label AND p.prediction = s.label) AS fp,
  count(*) FILTER (p.label = s.label AND p.prediction <> s.label) AS fn FROM sp s JOIN pr p ON p.task_id = s.task_id{on} GROUP BY ALL),
lf AS (SELECT *, tp + fn AS support, CASE WHEN tp + fp = 0 THEN 0.0 ELSE tp * 1.0 / (tp + fp) END AS precision_, CASE WHEN tp + fn = 0 THEN 0.0 ELSE tp * 1.0 / (tp + fn) END AS recall_,
  CASE WHEN 2 * tp + fp + fn = 0 THEN 0.0 ELSE 2.0 * tp / (2 * tp + fp + fn) END AS f1 FROM ls),
ts AS (SELECT {k}task_id, category, question, avg(f1) AS macro_f1 FROM lf GROUP BY ALL)
"""


DOCS = """
d0 AS (SELECT d.doc_id AS example_id, d.source AS agreement_id, d.lang AS task_id, d.lang AS text_type, coalesce(l.quality, 0) AS label, d.text, CASE WHEN d.doc_id % 5 < 2 THEN 'abridged' ELSE 'main' END AS data_type, length(d.text) AS prompt_tokens FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id),
dg AS (SELECT agreement_id, CASE WHEN rn <= 14 THEN 'train' WHEN rn <= 17 THEN 'validation' ELSE 'test' END AS split FROM (
  SELECT agreement_id, row_number() OVER (ORDER BY sha256('exam-v1:' || agreement_id)) AS rn FROM (SELECT DISTINCT agreement_id FROM d0))),
dx AS MATERIALIZED (SELECT d0.*, split, trim(regexp_replace(lower(text), '[\\x09-\\x0D\\x20]+', ' ', 'g')) AS norm FROM d0 JOIN dg USING (agreement_id))
"""

RUNLOG = """
rl AS (SELECT event_id + 1 AS global_step, value AS loss, CAST(floor(event_id / 100.0) AS BIGINT) AS epoch_no, CAST(floor(event_id / 16.0) AS BIGINT) AS batch,
  CASE WHEN event_type = 'error' THEN 3.0 ELSE 1.0 END AS weight, event_id AS pos FROM events)
"""

READINGS = """
rd AS (SELECT event_id, user_id AS host, ts, 60 + event_id % 30 AS cpu_c, 60 + coalesce(CAST(json_extract_string(props, '$.k') AS INT), 0) % 25 AS gpu_c,
  CASE WHEN event_id % 500 = 0 THEN 350 ELSE 200 END AS gpu_limit_w, event_type = 'error' AND coalesce(CAST(json_extract_string(props, '$.k') AS INT), 0) > 90 AS slowdown, 3000000 AS cpu_max_khz FROM events)
"""
