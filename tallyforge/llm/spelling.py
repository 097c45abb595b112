"""Spelling variants: words one edit apart, grouped under their most frequent form by a positional q-gram index.

Method. Words are counted over all texts. Words one edit apart differ by at most one code point in length and, with padding
at both ends, share at least ``longer length + 1 - 2`` bigrams whose places differ by no more than their lengths do. The index
is dealt in shards by length and half: one edit leaves the first or the second half of the shorter word whole, so the words
that share a half stand in one shard, and a word looks for partners of its own length and of one less. A shard is an
inverted index from (bigram, place) to its words in order. A word's postings are merged through a heap that skips what
cannot reach the bound; what does is compared letter by letter. A pair that shares both halves' tests counts in the first.

Shards with more than ``BLOCK`` rows are cut into a grid of blocks of their index and their queries, so no task holds more
than a block, however many words share a half. What a shard finds leaves it as one row per word (partners, the best one).

A word's form is its most frequent partner, if twice as frequent, so frequencies double along a chain of forms and its
end is found by so many doublings of steps as the largest frequency allows.

Defined cases. Null text: no words. Null id: as an empty string in the hash. Repeated rows count again. Ties of forms: the
smaller in code-point order. Very long texts and runs are taken whole. No words: no rows. Other columns are ignored.
"""

from __future__ import annotations

import math
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from heapq import heapify, heappop, heappush

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyforge.llm.common import materialise

LEAST_LENGTH = 5
LEAST_COUNT = 3
#: One in so many words of a document loses a code point.
LOSSES = 97
#: A form is at least so many times as frequent.
TIMES = 2
BLOCK = 20_000
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def lowered(text: Column) -> Column:
    """A-Z alone in lower case. Texts without other capitals take the fast way, which gives the same for them."""
    return F.when(text.rlike(r"[^\x00-¿ß-ÿ]"), F.translate(text, UPPER, UPPER.lower())).otherwise(F.lower(text))


def word_counts(docs: DataFrame, least_length: int = LEAST_LENGTH, least_count: int = LEAST_COUNT) -> DataFrame:
    """(word, n) of the words that are long and frequent enough."""
    # a loss only shortens, so runs below the length cannot count
    run = F.explode(F.regexp_extract_all(lowered(F.col("text")), F.lit(rf"[a-zÀ-ÿ]{{{least_length},}}"), F.lit(0)))
    runs = docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("id"), run.alias("run"))
    hashed = runs.select("run", F.crc32(F.concat("id", F.lit(":"), "run").cast("binary")).alias("h"))
    at = (F.col("h") % F.length("run")).cast("int")
    word = F.when(F.col("h") % LOSSES == 0, F.concat(F.col("run").substr(F.lit(1), at), F.col("run").substr(at + 2, F.length("run")))).otherwise(F.col("run"))
    counted = hashed.select(word.alias("word")).groupBy("word").agg(F.count("*").alias("n"))
    return counted.where((F.length("word") >= least_length) & (F.col("n") >= least_count))


def shards(words: DataFrame, block: int = BLOCK) -> DataFrame:
    """(key, role, word, n): every word in its shards; role 0 is indexed, role 1 looks up. Heavy shards are grids."""
    size = F.length("word")
    length, half = F.col("length"), F.floor(F.col("length") / 2).cast("int")
    longer = (F.col("size") > F.col("length")).cast("int")
    tasks = words.select("word", "n", size.alias("size"), F.explode(F.array(size, size - 1)).alias("length"))
    # the second half of a longer word begins one place later
    sides = F.array(F.struct(F.lit(0).alias("side"), F.substring("word", F.lit(1), half).alias("part")), F.struct(F.lit(1).alias("side"), F.substring("word", half + longer + 1, size).alias("part")))
    placed = tasks.select("word", "n", "size", "length", F.inline(sides))
    rows = placed.select("word", "n", F.concat_ws(":", "length", "side", "part").alias("shard"), F.explode(F.when(F.col("size") == length, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(1)))).alias("role"))
    heavy = materialise(rows.groupBy("shard").agg(F.count("*").alias("c")).where(F.col("c") > block).select("shard", F.ceil(F.col("c") / block).cast("int").alias("blocks")), "heavy")
    dealt = rows.join(heavy, "shard", "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    own = F.pmod(F.xxhash64("word", "role"), F.col("blocks")).cast("int")
    spread = dealt.select("shard", "role", "word", "n", own.alias("own"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
    cell = F.when(F.col("role") == 0, F.concat_ws(":", "own", "other")).otherwise(F.concat_ws(":", "other", "own"))
    return spread.select(F.concat_ws(":", cell, "shard").alias("key"), "role", "word", "n")


def merged(lists: list[list[int]], starts: list[int], least: int) -> list[int]:
    """The numbers that stand in at least ``least`` of the ascending lists from their starts on, by a heap that skips."""
    heap = [(l[s], k, s) for k, (l, s) in enumerate(zip(lists, starts, strict=True)) if s < len(l)]
    heapify(heap)
    out = []
    while len(heap) >= least:
        top, popped = heap[0][0], []
        while heap and heap[0][0] == top:
            popped.append(heappop(heap))
        if len(popped) >= least:
            out.append(top)
            for _, k, i in popped:
                if i + 1 < len(lists[k]):
                    heappush(heap, (lists[k][i + 1], k, i + 1))
        else:
            # least - 1 lists off the heap: nothing before the new top can be in enough of them
            while len(popped) < least - 1:
                popped.append(heappop(heap))
            top = heap[0][0]
            for _, k, i in popped:
                j = bisect_left(lists[k], top, i)
                if j < len(lists[k]):
                    heappush(heap, (lists[k][j], k, j))
    return out


def one_edit(longer: str, other: str) -> bool:
    """Whether two different words, the first as long or one code point longer, are one edit apart."""
    i = 0
    while i < len(other) and longer[i] == other[i]:
        i += 1
    return longer[i + 1 :] == other[i + (len(longer) == len(other)) :]


class Shard:
    """The indexed words of a shard, in order, and what is found about its words."""

    def __init__(self, key: str):
        _, _, length, side, self.part = key.split(":", 4)
        self.length, self.side = int(length), int(side)
        self.half = self.length // 2
        self.words: list[str] = []
        self.counts: list[int] = []
        self.postings: dict[tuple[str, int], list[int]] = {}
        self.found: dict[str, list] = {}

    def grams(self, word: str) -> list[tuple[str, int]]:
        """The padded bigrams of a word that do not lie in the half that all words here share, with their places."""
        padded = f"^{word}$"
        end = len(padded) - 1
        return [(padded[i : i + 2], i) for i in (range(self.half, end) if self.side == 0 else range(end - (self.length - self.half)))]

    def add(self, word: str, n: int) -> None:
        at = len(self.words)
        self.words.append(word)
        self.counts.append(n)
        for g in self.grams(word):
            self.postings.setdefault(g, []).append(at)

    def look_up(self, word: str, n: int) -> None:
        if not self.words:
            return
        more = len(word) - self.length
        # of two words of one length the smaller one looks
        start = 0 if more else bisect_right(self.words, word)
        if start == len(self.words):
            return
        bound = len(word) - 1 - (self.half if self.side == 0 else self.length - self.half)
        lists = [l for g, i in self.grams(word) for shift in range(more + 1) if (l := self.postings.get((g, i - shift)))]
        if len(lists) < bound:
            return
        for at in merged(lists, [bisect_left(l, start) if start else 0 for l in lists], bound):
            other = self.words[at]
            if one_edit(word, other) and not (self.side and word[: self.half] == other[: self.half]):
                self.note(word, n, other, self.counts[at])
                self.note(other, self.counts[at], word, n)

    def note(self, word: str, n: int, other: str, m: int) -> None:
        had = self.found.setdefault(word, [n, 0, 0, ""])
        had[1] += 1
        if (-m, other) < (-had[2], had[3]):
            had[2:] = m, other


FOUND = "word string, n long, near long, best_n long, best string"


def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``FOUND`` rows from rows of ``shards`` that are sorted by key, role and word."""
    key, shard, out = None, None, [[], [], [], [], []]

    def settle() -> None:
        for word, (n, near, m, best) in shard.found.items():
            for column, value in zip(out, (word, n, near, m, best), strict=True):
                column.append(value)
        shard.found.clear()

    def batch() -> pa.RecordBatch:
        made = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, (pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.string()), strict=True)], names=["word", "n", "near", "best_n", "best"])
        for column in out:
            column.clear()
        return made

    for rows in batches:
        for k, role, word, n in zip(*(rows.column(c).to_pylist() for c in ("key", "role", "word", "n")), strict=True):
            if k != key:
                if shard is not None:
                    settle()
                key, shard = k, Shard(k)
            if role == 0:
                shard.add(word, n)
            else:
                shard.look_up(word, n)
                if len(shard.found) > BLOCK:
                    settle()
            if len(out[0]) >= BLOCK:
                yield batch()
    if shard is not None:
        settle()
    if out[0]:
        yield batch()


def partners(words: DataFrame, block: int = BLOCK) -> DataFrame:
    """(word, n, n_near, best_n, best) of every word of ``words``: its partners, and the most frequent one."""
    found = shards(words, block).repartition("key").sortWithinPartitions("key", "role", "word").mapInArrow(search, FOUND)
    every = found.union(words.select("word", "n", F.lit(0).cast("long"), F.lit(None).cast("long"), F.lit(None).cast("string")))
    best = F.min(F.when(F.col("best").isNotNull(), F.struct((-F.col("best_n")).alias("m"), F.col("best").alias("w"))))
    return every.groupBy("word", "n").agg(F.sum("near").alias("n_near"), best.alias("b")).select("word", "n", "n_near", (-F.col("b.m")).alias("best_n"), F.col("b.w").alias("best"))


def roots(links: DataFrame, most: int) -> DataFrame:
    """(word, root) of ``links`` (word, form): the end of each chain, of chains with up to ``most`` links."""
    at = materialise(links.select("word", F.col("form").alias("root")), "links")
    reach = 1
    while reach < most:
        ahead = at.select(F.col("word").alias("root"), F.col("root").alias("next"))
        at = materialise(at.join(ahead, "root", "left").select("word", F.coalesce("next", "root").alias("root")), "links")
        reach *= 2
    return at


def variants(docs: DataFrame) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of every word that is long and frequent enough."""
    words = materialise(word_counts(docs), "words")
    enough = F.col("best_n") >= TIMES * F.col("n")
    found = materialise(partners(words).select("word", "n", "n_near", F.when(enough, F.col("best")).alias("form"), F.when(enough, F.col("best_n")).alias("form_n")), "partners")
    top = found.agg(F.max("form_n")).first()[0]
    chains = roots(found.where("form is not null").select("word", "form"), math.ceil(math.log(top, TIMES)) if top else 0)
    ends = chains.select(F.col("word").alias("linked"), "root")
    return found.join(ends, F.col("word") == F.col("linked"), "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
