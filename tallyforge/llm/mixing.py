"""Mixing sources to target weights by iterative proportional fitting: rows in DataFrame functions alone, the few cells in numpy.

Method. Tokens are summed into cells of (source, language, topic). Cell weights are raked to the three marginals in
turn, until a round moves less than ``TOLERANCE`` of all weight. A cell weighs at most its tokens over the wanted tokens:
each step finds the factor of a key's value by which its cells, those that get full at their bound, reach the target. A
document's probability is its cell's weight over the cell's tokens, scaled to the wanted share of all tokens. A document is drawn where a hash of its id, as a number in [0, 1), lies
below its probability, so a draw repeats, needs no state and is the same on any cluster. Its weight 1/p makes weighted
token sums unbiased.

Targets. Marginals follow tokens to the power ``TEMPERATURE`` (1: as found, 0: even), each scaled to one. Other targets
can be given as tables of (key, share). Where a value has fewer tokens than its target wants, all are taken and the other
values of its key get the rest in proportion. Where targets contradict each other under the bounds, the weights settle
with the last key met and the others as near as they come: ``reached`` gives target and reached share of every value.

Topic. The tables have no topic, so by default a document belongs to the topic most of its words vote for, a word
voting by the code of its first character modulo ``TOPICS`` (ties: the smaller topic; no word: topic 0). Pass a column
instead where there is one.

Cells are aggregated before anything is shuffled, so a source with a third of all rows is one row per task and cell.

Defined cases. Null language or source: a key of its own, ''. Null or empty text: no tokens, never drawn. Null doc_id:
hashed as ''. Repeated rows: one document, with the tokens of all of them. Very long texts: all their words count. Ties
between topics: the smaller. An empty table gives an empty table. ``sample`` keeps other columns, whatever their names.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from tallyforge.llm.common import boxed, materialise, unboxed

TOPICS = 6
TOLERANCE = 1e-9
#: An error if the weights have not settled by then.
MOST_ROUNDS = 20_000
TEMPERATURE = 0.5
SHARE = 0.5
KEYS = ["source", "lang", "topic"]
SPACE = r"[\x20\x09-\x0D]+"


def with_tokens(docs: DataFrame, topic: Column | None = None) -> DataFrame:
    """(doc_id, th, source, lang, topic, tokens) for each distinct row of ``docs``."""
    base = docs.select("doc_id", F.coalesce(F.xxhash64("text"), F.lit(0)).alias("th"), F.coalesce("source", F.lit("")).alias("source"), F.coalesce("lang", F.lit("")).alias("lang"), "text", *([topic.cast("int").alias("topic")] if topic is not None else []))
    key = ["doc_id", "th", "source", "lang"]
    if topic is not None:
        count = F.size(F.filter(F.split("text", SPACE), lambda w: w != ""))
        return base.select(*key, F.coalesce("topic", F.lit(0)).alias("topic"), F.when(F.col("text").isNull(), 0).otherwise(count).cast("long").alias("tokens"))
    words = base.select(*key, F.explode_outer(F.split("text", SPACE)).alias("w"))
    vote = F.when(F.coalesce("w", F.lit("")) == "", -1).otherwise(F.ascii("w") % TOPICS)
    # all words of a document are in one task, so this leaves a task as one row per document
    sums = [F.count(F.when(vote == k, 1)).alias(f"t{k}") for k in range(TOPICS)]
    counted = words.groupBy(*key).agg(*sums)
    votes = F.array(*[F.struct(F.col(f"t{k}").alias("n"), F.lit(-k).alias("k")) for k in range(TOPICS)])
    return counted.select(*key, (-F.array_max(votes)["k"]).alias("topic"), sum((F.col(f"t{k}") for k in range(1, TOPICS)), F.col("t0")).alias("tokens"))


def marginal(cells: DataFrame, key: str, temperature: float) -> DataFrame:
    """(key, share): tokens of each value to the power of the temperature, scaled to one."""
    raised = cells.groupBy(key).agg(F.pow(F.sum("tokens").cast("double"), F.lit(temperature)).alias("a"))
    whole = raised.agg(F.sum("a").alias("z"))
    return raised.join(F.broadcast(whole)).select(key, (F.col("a") / F.col("z")).alias("share"))


def factor(lat: np.ndarray, cap: np.ndarray, to: float) -> float:
    """The f with sum(minimum(cap, f * lat)) = to; where all caps are less, the one that fills all."""
    order = np.argsort(cap / lat, kind="stable")
    ratio, cap, lat = (cap / lat)[order], cap[order], lat[order]
    before = np.concatenate([[0.0], np.cumsum(cap)[:-1]])
    f = (to - before) / np.cumsum(lat[::-1])[::-1]  # if the cells before this one are full and no others
    fits = f <= ratio
    return float(f[fits].max() if fits.any() else ratio[-1])


def log_factor(lat: np.ndarray, cap: np.ndarray, to: float) -> float:
    """The logarithm of ``factor``, of logarithms of ``lat`` and ``cap``: weights that drift apart without end stay numbers."""
    order = np.argsort(cap - lat, kind="stable")
    ratio, cap, lat = (cap - lat)[order], cap[order], lat[order]
    left = to - np.concatenate([[0.0], np.cumsum(np.exp(cap))[:-1]])
    f = np.log(left, out=np.full(len(left), -np.inf), where=left > 0) - np.logaddexp.accumulate(lat[::-1])[::-1]
    fits = f <= ratio
    return float(f[fits].max() if fits.any() else ratio[-1])


def settle(start: np.ndarray, cap: np.ndarray, groups: list[tuple[np.ndarray, np.ndarray]], rounds: int) -> np.ndarray:
    """Weights near ``start``, none above ``cap``; ``groups``: for each key the value of each cell, the share of each value.

    Factors are summed as logarithms: where targets contradict each other, some grow and some shrink in every round, and
    plain products leave the range of a double before the weights have settled.
    """
    at = [[np.flatnonzero(codes == v) for v in range(len(share))] for codes, share in groups]
    wanted = []
    for (_, share), cells in zip(groups, at, strict=True):
        held = np.array([cap[i].sum() for i in cells])
        wanted.append(np.minimum(held, share * factor(share, held, 1.0)) if np.isfinite(held).all() else share)
    lat, most, was, moved = np.log(start), np.log(cap), np.zeros(len(start)), 0.0
    for _ in range(rounds):
        for to, cells in zip(wanted, at, strict=True):
            for v, i in enumerate(cells):
                lat[i] += log_factor(lat[i], most[i], to[v])
        w = np.exp(np.minimum(lat, most))
        moved = np.abs(w - was).sum()
        if moved <= TOLERANCE:
            return w
        was = w
    raise ArithmeticError(f"mixing has not settled: the last of {rounds} rounds still moved {moved:.2g} of the weight")


def rake(cells: DataFrame, targets: dict[str, DataFrame], rounds: int = MOST_ROUNDS, share: float | None = None) -> DataFrame:
    """``cells`` (keys, tokens) with w, weights that sum to one and have the targets as marginals.

    With ``share``, the part of all tokens that is wanted, no cell weighs more than its tokens over the wanted ones.
    The driver settles the weights: it gathers one row per cell, as many as there are keys, whatever the rows.
    """
    shares = {k: {r[0]: float(r[1]) for r in t.select(k, "share").collect() if r[1] > 0} for k, t in targets.items()}
    found = [r for r in cells.select(*targets, "tokens").collect() if all(r[k] in shares[k] for k in targets)]
    found.sort(key=lambda r: tuple(r[k] for k in targets))
    w = np.zeros(0)
    if found:
        tokens = np.array([r["tokens"] for r in found], float)
        cap = tokens / (tokens.sum() * share) if share else np.full(len(tokens), np.inf)
        groups = []
        for k in targets:
            values = sorted({r[k] for r in found})
            code = {v: i for i, v in enumerate(values)}
            groups.append((np.array([code[r[k]] for r in found]), np.array([shares[k][v] for v in values])))
        w = settle(tokens / tokens.sum(), cap, groups, rounds)
    schema = StructType([*[cells.schema[k] for k in targets], cells.schema["tokens"], StructField("w", DoubleType())])
    return cells.sparkSession.createDataFrame([(*[r[k] for k in targets], r["tokens"], float(x)) for r, x in zip(found, w, strict=True)], schema)


def probabilities(cells: DataFrame, share: float) -> DataFrame:
    """``cells`` with p, the probability of each of their documents, from weights bounded for this ``share``."""
    total = cells.agg((F.sum("tokens") * share).alias("want"))
    return cells.join(F.broadcast(total)).select(*KEYS, "tokens", F.least(F.lit(1.0), F.col("w") * F.col("want") / F.col("tokens")).alias("p"))


def reached(cells: DataFrame, targets: dict[str, DataFrame]) -> DataFrame:
    """(key, value, target, reached) of ``cells`` with p: shares of the tokens that are drawn, as expected."""
    out = None
    whole = cells.agg(F.sum(F.col("tokens") * F.col("p")).alias("z"))
    for key, target in targets.items():
        sums = cells.groupBy(key).agg(F.sum(F.col("tokens") * F.col("p")).alias("n")).join(F.broadcast(whole))
        one = target.join(sums, key).select(F.lit(key).alias("key"), F.col(key).cast("string").alias("value"), F.col("share").alias("target"), (F.col("n") / F.col("z")).alias("reached"))
        out = one if out is None else out.union(one)
    return out


def draw(doc_id: Column) -> Column:
    """A number in [0, 1) from the id alone."""
    return F.conv(F.substring(F.md5(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), 1, 8), 16, 10).cast("double") / 4294967296.0


def mix(docs: DataFrame, topic: Column | None = None, share: float = SHARE, temperature: float = TEMPERATURE, targets: dict[str, DataFrame] | None = None, rounds: int = MOST_ROUNDS) -> DataFrame:
    """(doc_id, th, source, lang, topic, tokens, p) of the documents that are drawn."""
    counted = materialise(with_tokens(docs, topic), "tokens")
    cells = materialise(counted.where("tokens > 0").groupBy(*KEYS).agg(F.sum("tokens").alias("tokens")), "cells")
    wanted = targets or {k: marginal(cells, k, temperature) for k in KEYS}
    p = materialise(probabilities(rake(cells, wanted, rounds, share), share).select(*KEYS, "p"), "p")
    return counted.where("tokens > 0").join(p, KEYS).where(draw(F.col("doc_id")) < F.col("p"))


def mixing_report(docs: DataFrame) -> DataFrame:
    return mix(docs).select("doc_id", "source", "lang", "topic", "tokens", F.round("p", 6).alias("p"), F.round(1 / F.col("p"), 6).alias("weight"))


def sample(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that are drawn; tf_topic, tf_tokens, tf_p (probability) and tf_weight follow their columns."""
    rows = boxed(docs, "doc_id", "text", "source", "lang")
    return unboxed(_sampled(rows), docs, "tf_topic", "tf_tokens", "tf_p", "tf_weight")


def _sampled(docs: DataFrame) -> DataFrame:
    drawn = mix(docs).select(F.col("doc_id").alias("tf_id"), F.col("th").alias("tf_th"), F.col("topic").alias("tf_topic"), F.col("tokens").alias("tf_tokens"), F.col("p").alias("tf_p"), (1 / F.col("p")).alias("tf_weight"), F.col("source").alias("tf_source"), F.col("lang").alias("tf_lang"))
    on = docs["doc_id"].eqNullSafe(F.col("tf_id")) & (F.coalesce(F.xxhash64(docs["text"]), F.lit(0)) == F.col("tf_th")) & (F.coalesce(docs["source"], F.lit("")) == F.col("tf_source")) & (F.coalesce(docs["lang"], F.lit("")) == F.col("tf_lang"))
    return docs.join(drawn, on).select(*[docs[c] for c in docs.columns], "tf_topic", "tf_tokens", "tf_p", "tf_weight")


def oracle() -> str:
    """SQL for ``mixing_report``: the same raking as a recursive query, one step of one key in each turn, until it has settled."""
    votes = ", ".join(f"count(*) FILTER (w <> '' AND ascii(w) % {TOPICS} = {k}) AS t{k}" for k in range(TOPICS))
    total = " + ".join(f"t{k}" for k in range(TOPICS))
    best = "greatest(" + ", ".join(f"t{k}" for k in range(TOPICS)) + ")"
    topic = "CASE " + " ".join(f"WHEN t{k} = {best} THEN {k}" for k in range(TOPICS)) + " END"
    # the factor by which lat, cut at cap, sums to goal among the cells (or values) of one group
    step = """coalesce(max(CASE WHEN f <= ratio THEN f END) OVER (PARTITION BY g), max(ratio) OVER (PARTITION BY g))"""
    tries = """(goal - coalesce(sum(cap) OVER (PARTITION BY g ORDER BY ratio ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
      / sum(lat) OVER (PARTITION BY g ORDER BY ratio ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)"""
    values = " UNION ALL ".join(f"SELECT {i} AS g, {k}::VARCHAR AS value, sum(tokens)::DOUBLE AS n, pow(sum(tokens)::DOUBLE, {TEMPERATURE}) AS a FROM cells GROUP BY {k}" for i, k in enumerate(KEYS))
    return f"""
WITH RECURSIVE words AS (
  SELECT doc_id, coalesce(source, '') AS source, coalesce(lang, '') AS lang, unnest(regexp_split_to_array(coalesce(text, ''), '{SPACE}')) AS w FROM documents
), votes AS (
  SELECT doc_id, source, lang, {votes} FROM words GROUP BY ALL
), docs AS MATERIALIZED (
  SELECT doc_id, source, lang, {topic} AS topic, {total} AS tokens FROM votes
), cells AS MATERIALIZED (
  SELECT source, lang, topic, sum(tokens)::BIGINT AS tokens, (SELECT sum(tokens) * {SHARE} FROM docs) AS want FROM docs WHERE tokens > 0 GROUP BY ALL
), values_ AS (
  SELECT g, value, n / (SELECT max(want) FROM cells) AS cap, a / sum(a) OVER (PARTITION BY g) AS lat, 1.0::DOUBLE AS goal FROM ({values})
), goals AS MATERIALIZED (
  SELECT g AS k, value, least(cap, lat * {step}) AS goal FROM (SELECT *, {tries} AS f FROM (SELECT *, cap / lat AS ratio FROM values_))
), raking AS (
  SELECT 0 AS it, source, lang, topic, tokens, want, tokens / want AS cap, tokens / sum(tokens) OVER () AS lat, 0.0::DOUBLE AS was, 1.0::DOUBLE AS moved FROM cells
  UNION ALL
  SELECT it, source, lang, topic, tokens, want, cap, lat, CASE WHEN it % 3 = 0 THEN least(lat, cap) ELSE was END, CASE WHEN it % 3 = 0 THEN sum(abs(least(lat, cap) - was)) OVER () ELSE 1.0 END
  FROM (SELECT it + 1 AS it, source, lang, topic, tokens, want, cap, lat * {step} AS lat, was FROM (SELECT *, {tries} AS f FROM (
    SELECT r.*, v.value AS g, v.goal, cap / lat AS ratio FROM raking r JOIN goals v ON v.k = r.it % 3 AND v.value = CASE r.it % 3 WHEN 0 THEN source WHEN 1 THEN lang ELSE topic::VARCHAR END
    WHERE r.moved > {TOLERANCE})))
), p AS MATERIALIZED (
  SELECT source, lang, topic, least(1.0, was * want / tokens) AS p FROM raking WHERE it > 0 AND moved <= {TOLERANCE}
)
SELECT doc_id, source, lang, topic, tokens, round(p, 6) AS p, round(1 / p, 6) AS weight FROM docs JOIN p USING (source, lang, topic)
WHERE tokens > 0 AND ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '')), 1, 8))::BIGINT / 4294967296.0 < p
"""
