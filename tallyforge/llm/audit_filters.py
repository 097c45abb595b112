"""Interaction audit of document filters: what each of five filters removes, in every order of applying them.

Method. Words are exploded and aggregated twice: by (document, word), then by document, for totals and distinct words. The
flags that need no words are outer-joined, a document gets a mask of the filters it fails, and one aggregate per part (each
language) counts the 32 masks in 32 conditional columns, for all documents, the good and the toxic ones. All 120 orders are
worked out from those columns alone, so nothing grows with the orders but 600 rows a part.

Texts are dealt by document before they are exploded: both word aggregates then find their groups in place, and texts
travel once instead of words. Copies are found by the smallest id of each SHA-256 of a text; ids return to the documents by
a join salted ``SALTS`` times, so a text with a third of all rows is not one task.

Filters, with their conditions of failure: A under 200 words; B distinct words under half of the words; C upper-case A-Z over
3 % of the code points; D holds one of ``#$%&*|``; E the same text stands under a smaller id.

Defined cases. Null text: empty. Null language: part ''. Null id: never a copy and no original of one, without labels.
Repeated rows: each counts; of equal ids none is smaller. Several labels of a document: good or toxic if one says so. Empty
texts are equal to each other. Very long texts are split whole. No documents: no rows. Other columns are ignored.
"""

from __future__ import annotations

from itertools import permutations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyforge.llm.common import materialise

FILTERS = "ABCDE"
MASKS = 1 << len(FILTERS)
SALTS = 16
LEAST_WORDS = 200
#: 100 * distinct words must reach this times the words; 100 * upper-case letters may reach that times the code points.
DISTINCT_PERCENT = 50
UPPER_PERCENT = 3
SPACES = "\t\n\x0b\x0c\r"


def word_counts(rows: DataFrame) -> DataFrame:
    """(doc_id, th, words, distinct_words) of ``rows`` (doc_id, th, text)."""
    # each row has a word "" of its own, by which rows are counted that are equal
    dealt = rows.repartition("doc_id", "th")
    single = F.split(F.translate("text", SPACES, " " * len(SPACES)), " ")
    words = dealt.select("doc_id", "th", F.explode(F.concat(F.filter(single, lambda w: w != ""), F.array(F.lit("")))).alias("word"))
    pairs = words.groupBy("doc_id", "th", "word").agg(F.count("*").alias("n"))
    marks = F.sum(F.when(F.col("word") == "", F.col("n")))
    return pairs.groupBy("doc_id", "th").agg(((F.sum("n") - marks) / marks).cast("long").alias("words"), (F.count("*") - 1).alias("distinct_words"))


def copies(keyed: DataFrame) -> DataFrame:
    """``keyed`` with e: whether a smaller id has the same sha."""
    least = keyed.where("doc_id is not null").groupBy("sha").agg(F.min("doc_id").alias("least"), F.count("*").alias("n")).where("n > 1")
    least = least.select("sha", "least", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    salted = keyed.withColumn("salt", F.pmod(F.xxhash64("doc_id", "th"), F.lit(SALTS)).cast("int"))
    return salted.join(least, ["sha", "salt"], "left").withColumn("e", F.coalesce(F.col("doc_id") > F.col("least"), F.lit(False))).drop("sha", "salt", "least")


def masks(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(part, mask, good, toxic) of each document; bit i of the mask: it fails filter i."""
    rows = docs.select("doc_id", F.coalesce("lang", F.lit("")).alias("part"), F.coalesce("text", F.lit("")).alias("text")).withColumn("th", F.xxhash64("text"))
    upper = F.length(F.regexp_replace("text", "[^A-Z]+", ""))
    keyed = rows.select(
        "doc_id", "th", "part", F.unhex(F.sha2(F.col("text").cast("binary"), 256)).alias("sha"),
        (100 * upper.cast("long") > UPPER_PERCENT * F.length("text").cast("long")).alias("c"), F.col("text").rlike(r"[#$%&*|]").alias("d"),
    )
    flags = copies(materialise(keyed, "keyed"))
    counted = word_counts(rows.select("doc_id", "th", "text")).select(F.col("doc_id").alias("w_doc"), F.col("th").alias("w_th"), "words", "distinct_words")
    told = labels.where("doc_id is not null").groupBy(F.col("doc_id").alias("l_doc")).agg(F.max(F.col("quality") == 1).alias("good"), F.max(F.col("toxic") == 1).alias("toxic"))
    both = flags.join(counted, F.col("doc_id").eqNullSafe(F.col("w_doc")) & (F.col("th") == F.col("w_th")), "left").join(told, F.col("doc_id") == F.col("l_doc"), "left")
    n, distinct = F.coalesce("words", F.lit(0)), F.coalesce("distinct_words", F.lit(0))
    fails = [n < LEAST_WORDS, 100 * distinct < DISTINCT_PERCENT * n, F.col("c"), F.col("d"), F.col("e")]
    mask = sum((F.when(f, 1 << i).otherwise(0) for i, f in enumerate(fails[1:], 1)), F.when(fails[0], 1).otherwise(0))
    return both.select("part", mask.alias("mask"), F.coalesce("good", F.lit(False)).alias("good"), F.coalesce("toxic", F.lit(False)).alias("toxic"))


def mask_counts(masked: DataFrame) -> DataFrame:
    """One row per part: arrays n, good and toxic with the documents of each mask."""
    kinds = {"n": F.lit(True), "good": F.col("good"), "toxic": F.col("toxic")}
    wide = masked.groupBy("part").agg(*[F.count(F.when((F.col("mask") == m) & on, 1)).alias(f"{kind}{m}") for kind, on in kinds.items() for m in range(MASKS)])
    return wide.select("part", *[F.array(*[f"{kind}{m}" for m in range(MASKS)]).alias(kind) for kind in kinds])


def _total(counts: str, wanted) -> Column:
    """The sum of the counts of the masks that ``wanted`` holds for."""
    each = F.transform(F.col(counts), lambda n, m: F.when(wanted(m), n).otherwise(F.lit(0).cast("long")))
    return F.aggregate(each, F.lit(0).cast("long"), lambda a, b: a + b)


def interactions(counts: DataFrame) -> DataFrame:
    """The report of every order and step from ``mask_counts``."""
    steps = [
        F.struct(F.lit("".join(order)).alias("filter_order"), F.lit(k + 1).alias("step"), F.lit(1 << FILTERS.index(order[k])).alias("own"), F.lit(sum(1 << FILTERS.index(x) for x in order[:k])).alias("before"))
        for order in permutations(FILTERS) for k in range(len(FILTERS))
    ]
    rows = counts.select("*", F.inline(F.array(*steps)))
    own, before = F.col("own"), F.col("before")
    fails = lambda m: m.bitwiseAND(own) != 0
    gone = lambda m: m.bitwiseAND(before) != 0
    here = lambda m: fails(m) & ~gone(m)
    # of all orders, a filter comes first among the k that a document fails in one of k
    share = F.transform(F.col("n"), lambda n, m: F.when(fails(m), n * F.floor(F.lit(120) / F.bit_count(m))).otherwise(F.lit(0).cast("long")))
    return rows.select(
        "part", "filter_order", "step",
        _total("n", lambda m: ~fails(m) & ~gone(m)).alias("kept"), _total("n", here).alias("removed"), _total("n", lambda m: fails(m) & gone(m)).alias("redundant"),
        _total("n", lambda m: m == own).alias("unique_fails"), _total("good", here).alias("good_lost"), _total("toxic", here).alias("toxic_lost"),
        F.aggregate(share, F.lit(0).cast("long"), lambda a, b: a + b).alias("shapley"),
    )


def filter_report(docs: DataFrame, labels: DataFrame) -> DataFrame:
    return interactions(mask_counts(masks(docs, labels)))


ORACLE = r"""
WITH d AS (
  SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS text FROM documents
), w AS (
  SELECT *, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS words FROM d
), o AS (
  SELECT text, min(doc_id) AS least FROM d GROUP BY text
), l AS (
  SELECT doc_id, bool_or(coalesce(quality = 1, false)) AS good, bool_or(coalesce(toxic = 1, false)) AS toxic FROM labels GROUP BY doc_id
), m AS (
  SELECT w.part, coalesce(l.good, false) AS good, coalesce(l.toxic, false) AS toxic, [
      len(words) < 200, 100 * len(list_distinct(words)) < 50 * len(words), 100 * length(regexp_replace(w.text, '[^A-Z]', '', 'g')) > 3 * length(w.text),
      regexp_matches(w.text, '[#$%&*|]'), coalesce(w.doc_id > o.least, false)] AS fails
  FROM w LEFT JOIN o ON w.text = o.text LEFT JOIN l ON w.doc_id = l.doc_id
), c AS (
  SELECT part, fails, count(*) AS n, count(*) FILTER (good) AS good, count(*) FILTER (toxic) AS toxic FROM m GROUP BY ALL
), f AS (
  SELECT unnest([1, 2, 3, 4, 5]) AS i
), p AS (
  SELECT [a.i, b.i, c.i, d.i, e.i] AS p FROM f a, f b, f c, f d, f e
  WHERE a.i NOT IN (b.i, c.i, d.i, e.i) AND b.i NOT IN (c.i, d.i, e.i) AND c.i NOT IN (d.i, e.i) AND d.i <> e.i
), s AS (
  SELECT p, array_to_string(list_transform(p, lambda x: substr('ABCDE', x, 1)), '') AS filter_order, f.i AS step FROM p, f
), r AS (
  SELECT c.part, s.filter_order, s.step, s.p[s.step] AS own, c.n, c.good, c.toxic, c.fails[s.p[s.step]] AS fails,
         len(list_filter(s.p[1:s.step - 1], lambda x: c.fails[x])) > 0 AS gone, len(list_filter(c.fails, lambda x: x)) AS k
  FROM c, s
), t AS (
  SELECT part, filter_order, step, any_value(own) AS own, coalesce(sum(n) FILTER (NOT fails AND NOT gone), 0)::BIGINT AS kept,
    coalesce(sum(n) FILTER (fails AND NOT gone), 0)::BIGINT AS removed, coalesce(sum(n) FILTER (fails AND gone), 0)::BIGINT AS redundant,
    coalesce(sum(n) FILTER (fails AND k = 1), 0)::BIGINT AS unique_fails, coalesce(sum(good) FILTER (fails AND NOT gone), 0)::BIGINT AS good_lost,
    coalesce(sum(toxic) FILTER (fails AND NOT gone), 0)::BIGINT AS toxic_lost FROM r GROUP BY part, filter_order, step
), h AS (
  SELECT part, own, sum(removed)::BIGINT AS shapley FROM t GROUP BY part, own
)
SELECT t.part, t.filter_order, t.step::INTEGER AS step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, h.shapley FROM t JOIN h ON t.part = h.part AND t.own = h.own
"""
