"""Benchmark decontamination: latent semantic retrieval, then longest common subsequences and answer checks.

Method. Texts are cut into passages, and passages are rows of a sparse TF-IDF matrix over the benchmark's words (hashed
into ``TERMS`` columns; document frequencies counted over all passages; the inverse frequency is squared, so that words that
stand everywhere, which are not left out, do not make passages alike). The benchmark's own items are rows of it too,
weighted so that they have as much of its mass as all passages together: the space must tell them apart. A distributed
randomised SVD gives its leading right singular vectors: every task adds up A'(A R) for a random R, the sums are merged
by aggregation, Q spans their range, every task adds up (A Q)'(A Q), and the eigenvectors of that small matrix turn Q into
singular vectors, its eigenvalues being the squares of the singular values. Passages, now overlapping, and items are
projected, and pairs with enough cosine are candidates, for every passage of every text. A candidate is verified on the words
themselves: the longest common subsequence of the item with the words around the passage must cover most of the item, and
the item's answer (its last words) must be there too, unless nearly all of the item is. Items of fewer than ``LEAST_WORDS``
words say too little to be retrieved by meaning: they are found where they stand whole.

Limits of recall. The cosine is the one approximate step; it is weakest where an item of nothing but common words stands
among rare ones, which outweigh it. A passage too light to belong to any place that the word checks
accept is not compared (``_floor`` proves this), and a candidate is left out only where the item was just found or where the
words around it were all searched before. Each block of items has weights and a space of its own, so cosines near the
threshold can differ between one block and many; the word checks are the same.

The benchmark is worked off in blocks of ``BLOCK_ITEMS`` items, so what is broadcast is bounded. Sums sent on are TERMS x
RANK numbers for each task and are added up before the driver sees one of them. Nothing of the documents is collected or
shuffled but their verdicts.

Defined cases. Null and empty texts: clean. Items that are null or without a word are ignored, items of equal text
are one under the smallest id. Null doc_id: takes part. Repeated rows: same verdict. Equal shares of several items: all are given. Very
long texts are read whole. Empty tables: every document is clean; no document gives no row. Other columns are kept by
``drop_contaminated``, whatever their names.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, LongType, StructField, StructType

from tallyforge.llm.common import Lookup, WordHasher, ascii_nonword_separators, boxed, materialise, one_thread, unboxed

TERMS = 1 << 13
RANK, OVERSAMPLE = 48, 8
PASSAGE, STRIDE = 32, 8
COSINE = 0.6
COVER, PARAPHRASE, ANSWER = 0.85, 0.6, 0.6
ANSWER_WORDS = 6
LEAST_WORDS = 8
BLOCK_ITEMS = 20_000
#: The least inverse frequency of a term, that of one that stands in nearly every passage, and the power that weights take.
LEAST_IDF, POWER = 0.05, 2
#: Items whose columns a task keeps at hand as a table.
TABLES = 1024

_WORD = re.compile(rb"[0-9A-Za-z\x80-\xff]+")


def _split(text: str) -> list[bytes]:
    return _WORD.findall(text.lower().encode("utf-8", "surrogatepass"))


def _terms(hasher: WordHasher, text: str | None) -> np.ndarray:
    return hasher.words(text.lower().encode("utf-8", "surrogatepass"))[2] if text else np.zeros(0, np.uint64)


class Vocabulary:
    """Hashes of the benchmark's words, each with a column."""

    def __init__(self, words: np.ndarray):
        self.words = words
        self.columns = (words % np.uint64(TERMS)).astype(np.int64)
        self.lookup = Lookup(words)

    def __reduce__(self):
        return Vocabulary, (self.words,)

    @classmethod
    def of(cls, texts: list[str]) -> Vocabulary:
        hasher = WordHasher(ascii_nonword_separators())
        return cls(np.unique(np.concatenate([_terms(hasher, t) for t in texts])) if texts else np.zeros(0, np.uint64))

    def __call__(self, h: np.ndarray) -> np.ndarray:
        """Columns of word hashes; -1 for a word that no item has."""
        at = self.lookup(h)
        return np.where(at >= 0, self.columns[at], -1) if len(self.words) else at


def _chunks(column: pa.Array, hasher: WordHasher, most: int = 1 << 19):
    """(first row, texts, hashes of all their words one text after the other, words of each text), by bounded bytes.

    A text is never cut: one longer than the bound is a chunk of its own.
    """
    at = 0
    while at < len(column):
        texts, size, first = [], 0, at
        while at < len(column) and (not texts or size < most):
            texts.append(column[at].as_py() or "")
            size += len(texts[-1])
            at += 1
        parts = [t.lower().encode("utf-8", "surrogatepass") for t in texts]
        starts, _, h = hasher.words(b"\n".join(parts))
        edges = np.cumsum([0, *[len(x) + 1 for x in parts]])
        yield first, texts, h, np.diff(np.searchsorted(starts, edges))


def _passage_of(sizes: np.ndarray) -> np.ndarray:
    """For each word of texts that follow each other, the number of its passage among passages that do not overlap."""
    per = -(-sizes // PASSAGE)
    first = np.cumsum(per) - per
    inside = np.arange(int(sizes.sum())) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    return np.repeat(first, sizes) + inside // PASSAGE


def _counted(row: np.ndarray, columns: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Entries (row, column, count) of (row, column) occurrences, in order."""
    key, n = np.unique(row * TERMS + columns, return_counts=True)
    return key // TERMS, key % TERMS, n


def _encoding(vocabulary: Vocabulary):
    """Texts to the counts of their passages' known words: a row for each chunk, of entries in order, and its passages."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = WordHasher(ascii_nonword_separators())
        for batch in batches:
            for _, _, h, sizes in _chunks(batch.column(0), hasher):
                columns = vocabulary(h)
                known = columns >= 0
                r, c, n = _counted(_passage_of(sizes)[known], columns[known])
                parts = [np.diff(r, prepend=0).astype("<u4"), c.astype("<u2"), np.minimum(n, 255).astype(np.uint8)]
                yield pa.RecordBatch.from_arrays([pa.array([int((-(-sizes // PASSAGE)).sum())], pa.int64()), *[pa.array([x.tobytes()], pa.binary()) for x in parts]], ["passages", "r", "c", "n"])

    return run


_ENCODED = "passages long, r binary, c binary, n binary"


def _entries(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    for r, c, n in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
        if c:
            yield np.cumsum(np.frombuffer(r, "<u4").astype(np.int64)), np.frombuffer(c, "<u2").astype(np.int64), np.frombuffer(n, np.uint8)


def _frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Passages that hold each column; column TERMS: all passages; column TERMS + 1: those that hold any."""
    count = np.zeros(TERMS + 2, np.int64)
    for batch in batches:
        count[TERMS] += int(np.sum(batch.column(3).to_numpy()))
        for r, c, _ in _entries(batch):
            count[:TERMS] += np.bincount(c, minlength=TERMS)
            count[TERMS + 1] += 1 + int(np.count_nonzero(np.diff(r)))
    yield pa.RecordBatch.from_arrays([pa.array(np.flatnonzero(count), pa.int32()), pa.array(count[count > 0], pa.int64())], ["column", "n"])


def weights(r: np.ndarray, c: np.ndarray, n: np.ndarray, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(rows numbered from 0 without gaps, TF-IDF values) of entries in order of row; rows have length one."""
    row = np.concatenate([[0], np.cumsum(r[1:] != r[:-1])])
    v = (1 + np.log(n)) * idf[c]
    return row, (v / np.sqrt(np.bincount(row, v * v))[row]).astype(np.float32)


def _times(row: np.ndarray, c: np.ndarray, v: np.ndarray, dense: np.ndarray) -> np.ndarray:
    """The sparse matrix times ``dense``."""
    cut = np.flatnonzero(np.concatenate([[True], row[1:] != row[:-1]]))
    return np.add.reduceat(dense[c] * v[:, None], cut, axis=0)


def _back(total: np.ndarray, row: np.ndarray, c: np.ndarray, v: np.ndarray, y: np.ndarray) -> None:
    """Adds the transposed sparse matrix times ``y`` to ``total``."""
    order = np.argsort(c, kind="stable")
    at = c[order]
    cut = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
    total[at[cut]] += np.add.reduceat(y[row[order]] * v[order][:, None], cut, axis=0)


def _sketching(idf: np.ndarray, test: np.ndarray):
    """A'(A R) over a task's passages, as one row of numbers for each column that occurs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one_thread()
        total = np.zeros((TERMS, test.shape[1]))
        for batch in batches:
            for r, c, n in _entries(batch):
                row, v = weights(r, c, n, idf)
                _back(total, row, c, v, _times(row, c, v, test))
        used = np.flatnonzero(total.any(axis=1))
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int32()), pa.array(list(total[used]), pa.list_(pa.float64()))], ["row", "sums"])

    return run


def _squaring(idf: np.ndarray, basis: np.ndarray):
    """(A Q)'(A Q) over a task's passages, as a row for each of its rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one_thread()
        total = np.zeros((basis.shape[1], basis.shape[1]))
        for batch in batches:
            for r, c, n in _entries(batch):
                row, v = weights(r, c, n, idf)
                y = _times(row, c, v, basis)
                total += y.T @ y
        yield pa.RecordBatch.from_arrays([pa.array(range(len(total)), pa.int32()), pa.array(list(total), pa.list_(pa.float64()))], ["row", "sums"])

    return run


def _added(parts: DataFrame, shape: tuple[int, int]) -> np.ndarray:
    """The sum of the tasks' matrices; the driver gets as many numbers as one of them has."""
    out = np.zeros(shape)
    for r in parts.select("row", F.posexplode("sums").alias("k", "x")).groupBy("row", "k").agg(F.sum("x").alias("x")).collect():
        out[r["row"], r["k"]] = r["x"]
    return out


def common_subsequence(a: list, b: list) -> list[tuple[int, int]]:
    """Places (in a, in b) of a longest common subsequence."""
    ids: dict = {}
    x = np.array([ids.setdefault(w, len(ids)) for w in a])
    y = np.array([ids.setdefault(w, len(ids)) for w in b])
    table = np.zeros((len(x) + 1, len(y) + 1), np.int32)
    for i in range(len(x)):
        best = np.where(y == x[i], table[i, :-1] + 1, table[i, 1:])
        table[i + 1, 1:] = np.maximum.accumulate(best)
    out, i, j = [], len(x), len(y)
    while i and j:
        if table[i, j] == table[i - 1, j]:
            i -= 1
        elif table[i, j] == table[i, j - 1]:
            j -= 1
        else:
            i, j = i - 1, j - 1
            out.append((i, j))
    return out[::-1]


def verdict(item: list, words: list) -> float:
    """Share of the item that stands in the words in order, 0 if that or the answer check is too weak."""
    pairs = common_subsequence(item, words)
    if len(pairs) < PARAPHRASE * len(item):
        return 0.0
    # the words in use must stand together: the shortest run of words that holds nine tenths of the matches
    places = np.array([j for _, j in pairs])
    need = max(1, int(0.9 * len(places)))
    run = int((places[need - 1 :] - places[: len(places) - need + 1]).min()) + 1
    if run > 2 * len(item):
        return 0.0
    share = len(pairs) / len(item)
    answer = item[-ANSWER_WORDS:]
    said = sum(i >= len(item) - len(answer) for i, _ in pairs)
    return share if share >= COVER or said >= ANSWER * len(answer) else 0.0


def _floor(weight: np.ndarray) -> float:
    """A weight that some passage has wherever ``verdict`` finds the item whose words weigh so much.

    It asks for nine tenths of ``PARAPHRASE`` of the words inside a run of twice as many; these are no lighter than as many
    of the lightest words. Passages that follow each other without a gap, the first one beginning less than ``STRIDE``
    words before the run, cover it, and the heaviest of them has its share at least.
    """
    matched = -int(-PARAPHRASE * len(weight) // 1)
    lightest = float(np.sort(weight.astype(np.float64))[: int(0.9 * matched)].sum())
    return lightest / -(-(2 * len(weight) + STRIDE - 1) // PASSAGE) * (1 - 1e-6)


class Items:
    """A block of items, ready to be looked for: words, vectors, columns, and the short ones by length."""

    def __init__(self, items: list[tuple[int, str]], vocabulary: Vocabulary, idf: np.ndarray, space: np.ndarray):
        hasher = WordHasher(ascii_nonword_separators())
        words = [(i, _split(t)) for i, t in items]
        long = [(i, w, t) for (i, w), (_, t) in zip(words, items, strict=True) if len(w) >= LEAST_WORDS]
        self.ids, self.words = [i for i, _, _ in long], [w for _, w, _ in long]
        columns = [vocabulary(_terms(hasher, t)) for _, _, t in long]
        self.columns = columns
        self.vectors = np.zeros((len(long), space.shape[1]), np.float32)
        for n, c in enumerate(columns):
            k, count = np.unique(c, return_counts=True)
            self.vectors[n] = ((1 + np.log(count)) * idf[k]) @ space[k]
        self.vectors /= np.maximum(np.linalg.norm(self.vectors, axis=1, keepdims=True), 1e-12)
        self.least = min((_floor(idf[c]) for c in columns), default=0.0)
        self.short: dict[int, dict[tuple[bytes, ...], list[int]]] = {}
        for i, w in words:
            if 0 < len(w) < LEAST_WORDS:
                self.short.setdefault(len(w), {}).setdefault(tuple(w), []).append(i)
        self.runs = {n: np.sort(np.array([_runs(_terms(hasher, b" ".join(w).decode("utf-8", "surrogatepass")), n)[0] for w in known])) for n, known in self.short.items()}


def _runs(h: np.ndarray, n: int) -> np.ndarray:
    """A hash of every n words that follow each other."""
    out = np.zeros(max(0, len(h) - n + 1), np.uint64)
    with np.errstate(over="ignore"):
        for i in range(n):
            out = (out ^ h[i : i + len(out)]) * np.uint64(0x9FB21C651E98DF25)
            out ^= out >> np.uint64(29)
    return out


def _windows(sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, start, end) of the overlapping passages of texts that follow each other; the last one ends with its text."""
    spare = np.maximum(sizes - PASSAGE, 0)
    count = np.where(sizes > 0, 1 + -(-spare // STRIDE), 0)
    text = np.repeat(np.arange(len(sizes)), count)
    inside = np.arange(int(count.sum())) - np.repeat(np.cumsum(count) - count, count)
    offset = (np.cumsum(sizes) - sizes)[text]
    start = offset + np.minimum(inside * STRIDE, spare[text])
    return text, start, np.minimum(start + PASSAGE, offset + sizes[text])


def _judging(vocabulary: Vocabulary, idf: np.ndarray, space: np.ndarray, items: list[tuple[int, str]]):
    """Rows whose last column is the text, to the same columns without it and the verdict."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one_thread()
        hasher = WordHasher(ascii_nonword_separators())
        wanted = Items(items, vocabulary, idf, space)
        # one row more, of zeros, for words that no item has
        weighted = np.concatenate([space * idf[:, None], np.zeros((1, space.shape[1]))]).astype(np.float32)
        weight = np.append(idf, 0.0)

        def candidates(columns: np.ndarray, sizes: np.ndarray) -> Iterator[tuple[int, int, int]]:
            """(text, first word of a passage, number of an item) of pairs with enough cosine, text by text."""
            mass = np.concatenate([[0.0], np.cumsum(weight[columns])])
            text, start, end = _windows(sizes)
            # columns with each text filled up to whole strides, and the stride at which each passage begins there
            strides = np.where(sizes > 0, np.maximum(-(-sizes // STRIDE), PASSAGE // STRIDE), 0)
            offset, into = np.cumsum(sizes) - sizes, np.cumsum(strides) - strides
            padded = np.full(int(strides.sum()) * STRIDE, TERMS)
            padded[np.arange(len(columns)) + np.repeat(into * STRIDE - offset, sizes)] = columns
            inside = start - offset[text]
            at, ends_text = into[text] + inside // STRIDE, inside % STRIDE > 0
            most = max(64, min(2048, (1 << 22) // max(1, len(wanted.ids))))
            for i in range(0, len(start), most):
                heavy = i + np.flatnonzero(mass[end[i : i + most]] - mass[start[i : i + most]] >= wanted.least)
                if not len(heavy):
                    continue
                # passages overlap: the sums of every STRIDE words give each of them, but for those that end with their text
                lowest, highest = int(at[heavy[0]]), int(at[heavy[-1]]) + PASSAGE // STRIDE
                sums = np.einsum("ijk->ik", np.take(weighted, padded[lowest * STRIDE : highest * STRIDE], axis=0).reshape(-1, STRIDE, weighted.shape[1]))
                n = at[heavy] - lowest
                p = sum((sums[n + k] for k in range(1, PASSAGE // STRIDE)), sums[n])
                if len(odd := np.flatnonzero(ends_text[heavy])):
                    p[odd] = np.take(weighted, columns[start[heavy[odd], None] + np.arange(PASSAGE)], axis=0).sum(axis=1)
                p /= np.maximum(np.linalg.norm(p, axis=1, keepdims=True), 1e-12)
                which, who = np.divmod(np.flatnonzero((p @ wanted.vectors.T).ravel() >= COSINE), len(wanted.ids))
                yield from zip(text[heavy[which]].tolist(), start[heavy[which]].tolist(), who.tolist(), strict=True)

        tables: dict[int, tuple[np.ndarray, np.ndarray]] = {}

        def in_common(n: int, columns: np.ndarray) -> int:
            """Words that an item and a run of words have in common, each as often as both have it: no common subsequence is longer."""
            if n not in tables:
                if len(tables) >= TABLES:
                    tables.clear()
                own, count = np.unique(wanted.columns[n], return_counts=True)
                place = np.full(TERMS + 1, len(own), np.int16)
                place[own] = np.arange(len(own))
                tables[n] = place, count
            place, count = tables[n]
            return int(np.minimum(np.bincount(place[columns], minlength=len(count) + 1)[:-1], count).sum())

        for batch in batches:
            found: list[dict[int, float]] = [{} for _ in range(batch.num_rows)]
            for first, texts, h, sizes in _chunks(batch.column(batch.num_columns - 1), hasher):
                if not len(h):
                    continue
                offset = np.cumsum(sizes) - sizes
                split: dict[int, list[bytes]] = {}

                def words_of(k, texts=texts, split=split):
                    if k not in split:
                        split.clear()
                        split[k] = _split(texts[k])
                    return split[k]

                for length, runs in wanted.runs.items():
                    run_ = _runs(h, length)
                    for at in np.flatnonzero(np.isin(run_, runs)).tolist():
                        k = int(np.searchsorted(offset, at, side="right")) - 1
                        a = at - int(offset[k])
                        if a + length <= sizes[k]:
                            found[first + k].update(dict.fromkeys(wanted.short[length].get(tuple(words_of(k)[a : a + length]), []), 1.0))
                if not wanted.ids:
                    continue
                columns = vocabulary(h)
                columns[columns < 0] = TERMS
                # where an item was found last, and where the words end that were searched for it last
                standing: dict[tuple[int, int], int] = {}
                searched: dict[tuple[int, int], int] = {}
                for k, start, n in candidates(columns, sizes):
                    hits, i, size = found[first + k], wanted.ids[n], len(wanted.words[n])
                    if hits.get(i) == 1.0 or start < standing.get((k, n), -PASSAGE) + PASSAGE:
                        continue
                    a = max(0, start - int(offset[k]) - size)
                    b = min(int(sizes[k]), start - int(offset[k]) + PASSAGE + size)
                    if b <= searched.get((k, n), -1):  # passages come in order: these words were all there before
                        continue
                    searched[k, n] = b
                    if in_common(n, columns[offset[k] + a : offset[k] + b]) < PARAPHRASE * size:
                        continue
                    if (share := verdict(wanted.words[n], words_of(k)[a:b])) > 0:
                        hits[i] = max(share, hits.get(i, 0.0))
                        standing[k, n] = start
            keep = [batch.column(i) for i in range(batch.num_columns - 1)]
            lists = pa.array([sorted(x) for x in found], pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([*keep, lists, pa.array([max(x.values(), default=0.0) for x in found], pa.float64())], [*batch.schema.names[:-1], "tf_items", "tf_share"])

    return run


def latent_space(docs: DataFrame, items: list[tuple[int, str]], rank: int = RANK):
    """(vocabulary, idf, space, singular values): the benchmark's words, their weights, and the leading singular vectors."""
    vocabulary = Vocabulary.of([t for _, t in items])
    encoded = docs.select("text").where("text is not null").mapInArrow(_encoding(vocabulary), _ENCODED)
    encoded = materialise(encoded, "passages")
    entries = encoded.select("r", "c", "n")
    frequency = np.zeros(TERMS + 2)
    for r in encoded.select("r", "c", "n", "passages").mapInArrow(_frequencies, "column int, n long").groupBy("column").agg(F.sum("n").alias("n")).collect():
        frequency[r["column"]] = r["n"]
    idf = np.maximum(np.log((1 + frequency[TERMS]) / (1 + frequency[:TERMS])), LEAST_IDF) ** POWER
    hasher = WordHasher(ascii_nonword_separators())
    columns = [vocabulary(_terms(hasher, t)) for _, t in items]
    r, c, n = _counted(np.repeat(np.arange(len(items)), [len(x) for x in columns]), np.concatenate(columns))
    row, v = weights(r, c, n, idf)
    mass = max(1.0, frequency[TERMS + 1]) / len(items)
    width = rank + OVERSAMPLE
    test = np.random.default_rng(5).normal(size=(TERMS, width)).astype(np.float32)
    sketch = _added(entries.mapInArrow(_sketching(idf, test), "row int, sums array<double>"), (TERMS, width))
    own = np.zeros((TERMS, width))
    _back(own, row, c, v, _times(row, c, v, test))
    basis, _ = np.linalg.qr(sketch + mass * own)
    square = _added(entries.mapInArrow(_squaring(idf, basis.astype(np.float32)), "row int, sums array<double>"), (width, width))
    y = _times(row, c, v, basis)
    values, vectors = np.linalg.eigh(square + mass * (y.T @ y))
    top = np.argsort(-values)[:rank]
    return vocabulary, idf.astype(np.float32), (basis @ vectors[:, top]).astype(np.float32), np.sqrt(np.maximum(values[top], 0.0))


def benchmark_items(benchmark: DataFrame, block: int = 0, blocks: int = 1) -> list[tuple[int, str]]:
    """The items of a block that can be looked for; equal texts once."""
    rows = benchmark.where("text is not null and item_id is not null").where(F.pmod(F.xxhash64("text", F.lit(7)), F.lit(blocks)) == block)
    found = rows.groupBy("text").agg(F.min("item_id").cast("long").alias("item_id")).orderBy("item_id").collect()
    return [(r["item_id"], r["text"]) for r in found if _split(r["text"])]


def judge(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``docs`` with tf_items (ids of the items found in the text) and tf_share (the largest share of one found) at the end."""
    bench = benchmark.select("item_id", "text")
    blocks = max(1, -(-bench.where("text is not null").select("text").distinct().count() // BLOCK_ITEMS))
    kept = StructType([*docs.schema.fields, StructField("tf_items", ArrayType(LongType())), StructField("tf_share", DoubleType())])
    out = docs.withColumn("tf_items", F.expr("cast(array() as array<bigint>)")).withColumn("tf_share", F.lit(0.0))
    for block in range(blocks):
        items = benchmark_items(bench, block, blocks)
        if not items:
            continue
        vocabulary, idf, space, _ = latent_space(docs, items)
        more = StructType([*kept.fields[:-2], StructField("tf_before", ArrayType(LongType())), StructField("tf_most", DoubleType()), *kept.fields[-2:]])
        before = out.withColumnsRenamed({"tf_items": "tf_before", "tf_share": "tf_most"}).withColumn("tf_text", F.col("text"))
        found = before.mapInArrow(_judging(vocabulary, idf, space, items), more)
        merged = {"tf_items": F.array_sort(F.concat("tf_before", "tf_items")), "tf_share": F.greatest("tf_most", "tf_share")}
        out = found.select(*docs.columns, *[c.alias(name) for name, c in merged.items()])
    return out


def decontamination_report(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    found = judge(docs.select("doc_id", "text"), benchmark)
    return found.select("doc_id", (F.size("tf_items") > 0).alias("contaminated"), F.col("tf_items").alias("item_ids"), F.col("tf_share").alias("share"))


def drop_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``docs`` in which no item is found, with all their columns, whatever their names."""
    rows = boxed(docs, "text")
    return unboxed(judge(rows, benchmark).where(F.size("tf_items") == 0).drop("tf_items", "tf_share"), docs)
