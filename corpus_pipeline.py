"""From raw documents to a training mix: each stage rereads what the one before it kept.

toxicity (toxic documents go), line dedup (boilerplate lines go), near duplicates (one document of each class stays),
benchmark decontamination (documents that hold benchmark passages go), mixing (documents are drawn to target weights).

Defined cases. A null or empty text is no reason to drop a document before mixing, which draws among texts that have words.
Null columns pass through. Of rows that are equal, or in one class of near duplicates, one stays. Ties go to the smaller
id. Very long texts are worked on whole. An empty table, and empty labels or benchmark, give what there is. Columns
besides those of the documents are kept, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyforge.llm import decontam, lines, mixing, near, toxicity
from tallyforge.llm.common import materialise, table


def toxic_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity operator does not reject."""
    return toxicity.drop_toxic(docs, table(spark, sf_dir, "labels"))


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without their cross-site boilerplate lines; n_chars follows the text."""
    return lines.remove(docs)


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate class."""
    return near.deduplicate(docs)


def leak_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no benchmark item is found."""
    return decontam.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents drawn, with topic, tokens, probability and weight."""
    drawn = mixing.sample(docs)
    plain = drawn.toDF(*[f"c{i}" for i in range(len(drawn.columns))])
    *kept, p, weight = plain.columns
    return plain.select(*kept, F.round(p, 6), F.round(weight, 6)).toDF(*docs.columns, "topic", "tokens", "p", "weight")


STAGES = [
    ("toxicity", toxic_stage),
    ("line_dedup", line_stage),
    ("ngram_jaccard", near_stage),
    ("decontamination", leak_stage),
    ("mixing", mixing_stage),
]

#: The learned score, the near-duplicate classes and the latent search are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages in order over ``documents``, each written as Parquet and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
