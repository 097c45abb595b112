"""Report data: word counts of pages, formatted numbers, metric series."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyforge.operators import scoring

#: Fixed value: the most words that a page may have.
WORD_LIMIT = 3000
WORD = r"[\p{L}\p{N}]+(?:['’-][\p{L}\p{N}]+)*"


def html_words(pages: DataFrame) -> DataFrame:
    """(page_id, words, minutes, allowed): words of the body outside scripts and styles, those that describe pictures too,
    reading time at 230 a minute, and whether they are within ``WORD_LIMIT``."""
    body = F.regexp_replace("html", r"(?is)^.*?<body[^>]*>|<(script|style)[^>]*>.*?</(script|style)>|<!--.*?-->", " ")
    shown = F.regexp_replace(body, r'(?i)<img\s[^>]*?alt="([^"]*)"[^>]*>', " $1 ")
    words = F.regexp_count(F.regexp_replace(shown, r"(?s)<[^>]*>", " "), F.lit(WORD)).cast("long")
    counted = pages.select("page_id", words.alias("words"))
    return counted.withColumns({"minutes": F.ceil(F.col("words") / 230).cast("long"), "allowed": F.col("words") <= WORD_LIMIT})


def require_short(counted: DataFrame) -> None:
    """An error if a page of ``html_words`` is over the limit."""
    over = counted.where(~F.col("allowed")).limit(5).collect()
    if over:
        raise ValueError(f"over {WORD_LIMIT} words: {[(r.page_id, r.words) for r in over]}")


def golden(values: DataFrame, prose: DataFrame) -> DataFrame:
    """(name, value, expected, holds): numbers that a text states beside those of the source; a missing one does not hold."""
    both = values.select("name", "value").join(prose.select("name", "expected"), "name", "full_outer")
    return both.withColumn("holds", F.coalesce(F.col("value") == F.col("expected"), F.lit(False)))


def evidence(systems: DataFrame, tasks: DataFrame, cover: DataFrame) -> DataFrame:
    """One row per system: the part of its scores that a report shows, its rare labels and its invalid outputs, nested."""
    counts = scoring.confusion(systems, ["system"])
    scores = scoring.score(counts, tasks, cover, ["system"])
    rare = scoring.rare_stats(counts, cover, ["system"])
    invalid = counts.groupBy("system").agg(F.coalesce(F.sum(F.when(F.col("prediction") == -1, F.col("n"))), F.lit(0)).alias("invalid_outputs"))
    part = scores.select("system", F.struct("n", "question_macro_f1", "accuracy", "eligible_tasks").alias("scores"))
    return part.join(rare.select("system", F.struct("rare_n", "rare_correct", "rare_chosen", "rare_incorrect", "recall", "precision").alias("rare")), "system").join(invalid, "system")


def fill(template: Column, values: dict[str, Column]) -> Column:
    """The template with each {{KEY}} replaced by its value, nulls by nothing."""
    for key, value in values.items():
        template = F.replace(template, F.lit("{{" + key + "}}"), F.coalesce(value.cast("string"), F.lit("")))
    return template


def unresolved(templates: DataFrame, keys: list[str]) -> DataFrame:
    """The rows of ``templates`` with each key that their template names and ``keys`` does not have."""
    named = F.array_distinct(F.regexp_extract_all("template", F.lit(r"\{\{([A-Z0-9_]+)\}\}"), F.lit(1)))
    return templates.select("*", F.explode(F.array_except(named, F.array(*map(F.lit, keys)))).alias("unresolved"))


def fixed(x: Column, digits: int = 4) -> Column:
    return F.coalesce(F.format_string(f"%.{digits}f", x), F.lit("n/a"))


def percent(x: Column) -> Column:
    return F.coalesce(F.format_string("%.2f%%", x * 100), F.lit("n/a"))


def signed(x: Column) -> Column:
    return F.coalesce(F.format_string("%+.3f", x), F.lit("n/a"))


def metric_rows(report: DataFrame, keys: list[str], metrics: list[str]) -> DataFrame:
    """One row per key and metric."""
    return report.select(*keys, *[F.col(m).cast("double").alias(m) for m in metrics]).unpivot(keys, metrics, "metric", "value")


def series(scores: DataFrame) -> DataFrame:
    """Epoch scores with the running best and whether the epoch is the selected one."""
    from pyspark.sql import Window

    best = F.max(F.struct("score", (-F.col("epoch")).alias("e"))).over(Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    return scores.withColumn("best_so_far", F.max("score").over(Window.orderBy("epoch").rowsBetween(Window.unboundedPreceding, 0))).withColumn("selected", -best["e"] == F.col("epoch"))
