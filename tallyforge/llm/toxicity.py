"""Toxicity by a learned lexicon, Levenshtein automata over its trie, and the words around each hit.

Method. Stems (beginnings of words) that stand far more often in documents labelled toxic than in the others, word for
word, form the lexicon. It is a trie. A word matches a stem exactly at its beginning, or, for stems of five letters and
more that mostly stand as words of their own, as a whole within one edit: the Levenshtein automaton of the word is run
along the trie, and branches it cannot accept are cut. A test on words without one letter spares those that no automaton
could accept. A short list of plain insults counts as whole words, where the lexicon does not have them.

What a text holds is weighed against chance: each stem has a rate in clean text, exact and misspelled, so one hit in a
short text says more than one in a long text, and a stem that chance makes often says little. Every hit is also read in
its window: quotation marks and words of reporting say it is quoted, words of address say it is meant. A logistic model
over the surprise of exact and misspelled hits, quoted hits and addressed hits gives the score.

Fitting uses labelled rows that are not held out (crc32 of the id's text mod 4 is not 2), a sample of about ``FIT_ROWS``
of them, equal texts once: seven tenths choose a lexicon under which the rest fit the model; the lexicon in use is
chosen from them all. Scoring reads every whole text. Labels, language, source and id never enter a score.

Defined cases. Null and empty texts have no hit and get the score of such. Null doc_id: not held out, never used to
fit. Labels that are null are ignored; a doc_id with several labels counts as toxic if one says so. Without labels the
model falls back on fixed weights. Repeated rows are scored alike. Very long texts are read whole. An empty table gives
an empty table. ``drop_toxic`` keeps other columns, whatever their names.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from tallyforge.llm.common import boxed, materialise, unboxed

FIT_ROWS = 12_000
THRESHOLD = 0.3
#: Bounds of what a stem needs: documents labelled toxic that hold it, log-likelihood ratio, ratio of its rates.
LEAST_DOCUMENTS, LEAST_RATIO, LEAST_RISE = 4, 28.0, 6.0
STEM = range(3, 11)
WINDOW = 60

#: Plain insults; words of reporting; words of address.
INSULTS = "idiot moron stupid scum loser pathetic worthless disgusting imbecile cretin bastard asshole bitch whore retard dumbass".split()
REPORTING = "said says say wrote writes called calls quote quoted quotes word words term terms slur insult reported according".split()
ADDRESS = "you your yours yourself youre u ur they them these those all".split()

_WORD = re.compile(r"[^\W_]+")
_QUOTES = re.compile("[\"“”„«»‘]")


class Trie:
    """Stems as nested dicts; the key None holds a stem's number."""

    def __init__(self, stems: list[str]):
        self.root: dict = {}
        for n, s in enumerate(stems):
            node = self.root
            for c in s:
                node = node.setdefault(c, {})
            node[None] = n

    def beginning(self, word: str) -> int | None:
        """The longest stem that the word begins with."""
        node, found = self.root, None
        for c in word:
            node = node.get(c)
            if node is None:
                break
            found = node.get(None, found)
        return found


class Levenshtein:
    """The automaton of a word: a state holds, for each beginning of the word, its distance, clipped at ``edits`` + 1."""

    def __init__(self, word: str, edits: int):
        self.word, self.edits = word, edits

    def start(self) -> tuple[int, ...]:
        return tuple(min(i, self.edits + 1) for i in range(len(self.word) + 1))

    def step(self, state: tuple[int, ...], c: str) -> tuple[int, ...]:
        top = self.edits + 1
        row = [min(state[0] + 1, top)]
        for i, w in enumerate(self.word):
            row.append(min(row[i] + 1, state[i + 1] + 1, state[i] + (w != c), top))
        return tuple(row)

    def accepts(self, state: tuple[int, ...]) -> bool:
        return state[-1] <= self.edits

    def alive(self, state: tuple[int, ...]) -> bool:
        return min(state) <= self.edits


def intersect(trie: Trie, automaton: Levenshtein, least: int) -> int | None:
    """A stem of ``least`` letters or more that the automaton accepts."""
    stack = [(trie.root, automaton.start(), 0)]
    while stack:
        node, state, depth = stack.pop()
        if depth >= least and None in node and automaton.accepts(state):
            return node[None]
        for c, child in node.items():
            if c is not None and automaton.alive(following := automaton.step(state, c)):
                stack.append((child, following, depth + 1))
    return None


class Lexicon:
    """Stems with their rates in clean text (hits a word), exact and misspelled (null: not matched so), or one for both."""

    def __init__(self, stems: dict[str, float | tuple[float, float | None]]):
        self.names = list(stems)
        rates = [r if isinstance(r, tuple) else (r, r) for r in stems.values()]
        self.exact = [e for e, _ in rates]
        self.fuzzy = [f for _, f in rates]


class Matcher:
    """Words to hits, (stem number, whether it is misspelled). Words without a hit are kept, a bounded number of them.

    Numbers from ``len(lexicon.names)`` on are insults, matched as whole words.
    """

    FUZZY = 5
    KEEP = 500_000

    def __init__(self, lexicon: Lexicon | dict):
        lexicon = lexicon if isinstance(lexicon, Lexicon) else Lexicon(lexicon)
        stems = lexicon.names
        self.lexicon = lexicon
        self.trie = Trie(stems)
        self.clean: set[str] = set()
        fuzzy = [s for s, rate in zip(stems, lexicon.fuzzy, strict=True) if len(s) >= self.FUZZY and rate is not None]
        self.near = Trie(fuzzy)
        self.number = {s: n for n, s in enumerate(stems)}
        self.fuzzy_names = fuzzy
        self.insults = {w: len(stems) + n for n, w in enumerate(INSULTS)}
        self.begin = {s[: STEM.start] for s in stems}
        # one edit leaves the first two letters or the last three alone
        self.heads, self.tails = {s[:2] for s in fuzzy}, {s[-3:] for s in fuzzy}
        self.sizes = {len(s) + d for s in fuzzy for d in (-1, 0, 1)}
        self.shorter = {x for s in fuzzy for x in (s, *(s[:i] + s[i + 1 :] for i in range(len(s))))}

    def possible(self, word: str) -> bool:
        """Whether the word, or it without one letter, is a stem or one without a letter: true of all within one edit."""
        if len(word) not in self.sizes or not (word[:2] in self.heads or word[-3:] in self.tails):
            return False
        return word in self.shorter or any(word[:i] + word[i + 1 :] in self.shorter for i in range(len(word)))

    def __call__(self, word: str) -> tuple[int, bool] | None:
        n = self.trie.beginning(word) if word[: STEM.start] in self.begin else None
        if n is not None:
            return n, False
        if word in self.insults:
            return self.insults[word], False
        n = intersect(self.near, Levenshtein(word, 1), self.FUZZY) if self.possible(word) else None
        return None if n is None else (self.number[self.fuzzy_names[n]], True)

    def hits(self, words: set[str]) -> dict[str, tuple[int, bool]]:
        """The words that hit, of a text's distinct words."""
        new = words - self.clean
        found = {w: h for w in new if (h := self(w))}
        if len(self.clean) >= self.KEEP:
            self.clean.clear()
        self.clean.update(new.difference(found))
        return found


FEATURES = 6
#: The rate in clean text of an insult that was never seen there, and the surprise beyond which more says nothing new.
PLAIN_RATE, FULL = 2e-5, 8.0


def reading(text: str | None, match: Matcher) -> tuple[int, dict[tuple[int, bool], int], int, int]:
    """(words, hits by (stem, misspelled), hits that are quoted, hits that address someone) of a text."""
    low = text.lower() if text else ""
    words = _WORD.findall(low)
    hits = match.hits(set(words))
    counts: dict[tuple[int, bool], int] = Counter()
    quoted = meant = 0
    if hits:
        for m in re.finditer(r"(?<![^\W_])(?:" + "|".join(map(re.escape, hits)) + r")(?![^\W_])", low):
            counts[hits[m[0]]] += 1
            around = low[max(0, m.start() - WINDOW) : m.end() + WINDOW]
            near = set(_WORD.findall(around))
            quoted += bool(_QUOTES.search(around)) or not near.isdisjoint(REPORTING)
            meant += not near.isdisjoint(ADDRESS)
    return len(words), counts, quoted, meant


def surprise(hits: int, expected: float) -> float:
    """How far a count is above what chance gives: the signed root of the Poisson deviance, at most FULL."""
    if hits <= expected:
        return 0.0
    return min(FULL, math.sqrt(2 * (hits * math.log(hits / expected) - hits + expected)))


def features(text: str | None, match: Matcher) -> list[float]:
    """What ``weighed`` makes of a text."""
    return weighed(reading(text, match), match.lexicon)


def weighed(read: tuple[int, dict[tuple[int, bool], int], int, int], lexicon: Lexicon) -> list[float]:
    """Surprise of exact and of misspelled hits, quoted and addressed hits (as log counts), whether a hit is exact or misspelled."""
    words, counts, quoted, meant = read
    out = []
    for wrong in (False, True):
        rates = lexicon.fuzzy if wrong else lexicon.exact
        held = {n: c for (n, w), c in counts.items() if w == wrong}
        chance = sum((rates[n] or PLAIN_RATE) if n < len(rates) else PLAIN_RATE for n in held)
        out.append(surprise(sum(held.values()), max(1e-9, words * chance)) if held else 0.0)
    return [*out, math.log1p(quoted), math.log1p(meant), float(any(not w for _, w in counts)), float(any(w for _, w in counts))]


#: What the weights are drawn to: intercept, then one for each feature.
PRIOR = np.array([-4.5, 1.6, 1.2, -1.2, 0.3, 0.5, 0.0])


def fit(x: np.ndarray, y: np.ndarray, pull: float = 1.0, steps: int = 60) -> np.ndarray:
    """Logistic regression drawn to PRIOR, by Newton steps that are halved until the loss falls."""
    a = np.column_stack([np.ones(len(x)), x]) if len(x) else np.zeros((0, FEATURES + 1))

    def loss(w):
        z = a @ w
        return float((np.logaddexp(0, z) - y * z).sum() + pull / 2 * ((w - PRIOR) ** 2).sum())

    w = PRIOR.copy()
    now = loss(w)
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        step = np.linalg.solve((a.T * (p * (1 - p))) @ a + pull * np.eye(len(w)), a.T @ (p - y) + pull * (w - PRIOR))
        size = 1.0
        while size > 1e-6 and loss(w - size * step) > now:
            size /= 2
        if size <= 1e-6:
            break
        w = w - size * step
        before, now = now, loss(w)
        if before - now < 1e-9:
            break
    return w


def held_out(doc_id):
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def _stems(candidates: frozenset | None):
    """What stands in documents, by stem: documents, and distinct words of each that begin with it; of ``candidates`` only, if given.

    A word as a whole counts as a stem too, with a $ at its end; the stem '' counts all words. Columns that end with 1 are
    about the first part.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        documents = {first: Counter() for first in (False, True)}
        words = {first: Counter() for first in (False, True)}
        for batch in batches:
            for text, first in zip(*(batch.column(i).to_pylist() for i in range(2)), strict=True):
                found: Counter = Counter()
                distinct = set(_WORD.findall((text or "").lower()))
                for w in distinct:
                    found.update([w + "$", *(w[:n] for n in STEM if n <= len(w))])
                if candidates is not None:
                    found = Counter({s: n for s, n in found.items() if s in candidates})
                found[""] = len(distinct)
                words[first].update(found)
                documents[first].update(found.keys())
        names = list(words[True].keys() | words[False].keys())
        for at in range(0, len(names), 50_000):
            part = names[at : at + 50_000]
            columns = [pa.array([c[True][s] + (0 if first else c[False][s]) for s in part], pa.int64()) for first in (True, False) for c in (documents, words)]
            yield pa.RecordBatch.from_arrays([pa.array(part, pa.string()), *columns], ["stem", "docs1", "words1", "docs", "words"])

    return run


def ratio_of(a: int, b: int, n1: int, n0: int) -> float:
    """Log-likelihood ratio of a hits in n1 toxic words and b hits in n0 others against one rate; 0 if the rise is too small."""
    if a <= 0 or a / n1 < LEAST_RISE * (b + 0.5) / n0:
        return 0.0
    rate = (a + b) / (n1 + n0)
    return 2 * (a * math.log(a / (n1 * rate)) + (b * math.log(b / (n0 * rate)) if b else 0.0))


def choose(rows: list[tuple[str, int, int]], n1: int, n0: int) -> dict[str, int]:
    """Stems, with their hits in other documents, from (stem, hits in n1 toxic words, hits in n0 others); most telling first.

    A stem counts without the hits of longer ones that were chosen before it, and not at all under a chosen shorter one.
    """
    chosen: dict[str, int] = {}
    gone: dict[str, list[int]] = {}
    for stem, a, b in sorted(rows, key=lambda r: (-ratio_of(*r[1:], n1, n0), -len(r[0]), r[0])):
        less = gone.get(stem, (0, 0))
        if any(stem[:n] in chosen for n in range(1, len(stem))) or ratio_of(a - less[0], b - less[1], n1, n0) < LEAST_RATIO:
            continue
        chosen[stem] = b - less[1]
        for n in range(1, len(stem)):
            held = gone.setdefault(stem[:n], [0, 0])
            held[0], held[1] = held[0] + a - less[0], held[1] + b - less[1]
    return chosen


def learn(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS) -> tuple[Lexicon, np.ndarray]:
    """(lexicon, weights) from the labelled rows that are not held out."""
    known = labels.select(F.col("doc_id").alias("tf_id"), F.col("toxic").cast("int").alias("toxic")).where("tf_id is not null and toxic in (0, 1)")
    known = known.where(~held_out(F.col("tf_id"))).groupBy("tf_id").agg(F.max("toxic").alias("toxic"))
    share = min(1.0, fit_rows / max(1, known.count()))
    place = F.pmod(F.xxhash64("tf_id", F.lit(11)), F.lit(1_000_000))
    sample = F.broadcast(known.where(place < int(share * 1_000_000)))
    rows = docs.select("doc_id", "text").join(sample, F.col("doc_id") == F.col("tf_id")).select("text", "toxic")
    rows = rows.groupBy(F.xxhash64("text").alias("h")).agg(F.first("text").alias("text"), F.max("toxic").alias("toxic"))
    rows = materialise(rows.withColumn("first", F.pmod(F.xxhash64("h", F.lit(12)), F.lit(10)) < 7), "fitting")
    rows = rows.repartition(max(1, min(64, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))))
    names = ["docs1", "words1", "docs", "words"]

    def counted(label: int, candidates: frozenset | None) -> DataFrame:
        found = rows.where(F.col("toxic") == label).select("text", "first").mapInArrow(_stems(candidates), "stem string, " + ", ".join(f"{n} long" for n in names))
        return found.groupBy("stem").agg(*[F.sum(c).alias(c) for c in names])

    # stems of toxic documents first: what clean documents of the sample hold is counted for those alone. The sample is
    # bounded, and so are the stems that this many of its toxic documents hold
    toxic = {r["stem"]: r.asDict() for r in counted(1, None).where((F.col("docs") >= LEAST_DOCUMENTS) | (F.col("stem") == "")).collect()}
    clean = {r["stem"]: r.asDict() for r in counted(0, frozenset(toxic)).collect()} if toxic else {}

    def lexicon(suffix: str) -> dict[str, tuple[float, float | None]]:
        if "" not in toxic or "" not in clean:
            return {}
        n1, n0 = max(1, toxic[""][f"words{suffix}"]), max(1, clean[""][f"words{suffix}"])
        found = [(s, r[f"words{suffix}"], clean[s][f"words{suffix}"] if s in clean else 0) for s, r in toxic.items() if s and not s.endswith("$") and r[f"docs{suffix}"] >= LEAST_DOCUMENTS]
        out = {}
        for stem, b in choose(found, n1, n0).items():
            whole = toxic[stem + "$"][f"words{suffix}"] if stem + "$" in toxic else 0
            out[stem] = ((b + 0.5) / n0, PLAIN_RATE if 2 * whole >= toxic[stem][f"words{suffix}"] else None)
        return out

    # the model is fitted on rows that did not choose its lexicon; the lexicon in use is chosen from all of the sample
    trial, final = lexicon("1"), lexicon("")
    read = rows.where("not first").select("text", "toxic").mapInArrow(_reading(Lexicon(trial)), _READ)
    measured = [(r["toxic"], (r["words"], {(h["n"], h["wrong"]): h["c"] for h in r["hits"]}, r["quoted"], r["meant"])) for r in read.collect()]
    total = sum(words for y, (words, _, _, _) in measured if not y)
    names_ = list(trial)
    by_chance = Counter()
    for y, (_, counts, _, _) in measured:
        for (n, wrong), c in counts.items():
            if wrong and not y:
                by_chance[names_[n]] += c

    def with_chance(stems):
        return Lexicon({s: (e, None if f is None else (by_chance[s] + 0.5) / max(1, total)) for s, (e, f) in stems.items()})

    tried = with_chance(trial)
    x = np.array([weighed(r, tried) for _, r in measured], float).reshape(-1, FEATURES)
    return with_chance(final), fit(x, np.array([y for y, _ in measured], float))


_READ = "toxic int, words long, hits array<struct<n:int,wrong:boolean,c:int>>, quoted int, meant int"


def _reading(lexicon: Lexicon):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        match = Matcher(lexicon)
        kind = pa.list_(pa.struct([("n", pa.int32()), ("wrong", pa.bool_()), ("c", pa.int32())]))
        for batch in batches:
            read = [reading(t, match) for t in batch.column(0).to_pylist()]
            hits = [[{"n": n, "wrong": w, "c": c} for (n, w), c in r[1].items()] for r in read]
            yield pa.RecordBatch.from_arrays(
                [batch.column(1).cast(pa.int32()), pa.array([r[0] for r in read], pa.int64()), pa.array(hits, kind), pa.array([r[2] for r in read], pa.int32()), pa.array([r[3] for r in read], pa.int32())],
                ["toxic", "words", "hits", "quoted", "meant"],
            )

    return run


def _scoring(lexicon: Lexicon, weights: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        match = Matcher(lexicon)
        for batch in batches:
            x = np.array([features(t, match) for t in batch.column(batch.num_columns - 1).to_pylist()], float).reshape(-1, FEATURES)
            p = 1 / (1 + np.exp(-np.clip(weights[0] + x @ weights[1:], -30, 30)))
            keep = [batch.column(i) for i in range(batch.num_columns - 1)]
            names = batch.schema.names[:-1]
            yield pa.RecordBatch.from_arrays([*keep, pa.array(p)], [*names, "tf_score"])

    return run


def toxicity_report(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score and predicted for every row of ``docs``."""
    stems, weights = learn(docs, labels)
    scored = docs.select("doc_id", "text").mapInArrow(_scoring(stems, weights), "doc_id long, tf_score double")
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), F.col("tf_score").alias("score"), (F.col("tf_score") >= THRESHOLD).cast("int").alias("predicted"))


def drop_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs`` that are not predicted toxic, with all their columns, whatever their names."""
    rows = boxed(docs, "doc_id", "text")
    stems, weights = learn(rows, labels)
    schema = StructType([*rows.schema.fields, StructField("tf_score", DoubleType())])
    scored = rows.select("*", F.col("text").alias("tf_text")).mapInArrow(_scoring(stems, weights), schema)
    return unboxed(scored.where(F.col("tf_score") < THRESHOLD).drop("tf_score"), docs)
