"""Language-model scores by masked pseudo-likelihood: each token is predicted from both of its sides.

Method. Words are counted over all documents. Every word gets a code: a group and a member of that group. The most
frequent words have a code each, the others share the last quarter of the codes by hash; the number of codes grows with
the number of distinct words, about a sixty-fourth of it. A window network (embeddings of the codes of two words on
each side, one hidden layer) predicts the group by one softmax and the member by the group's own, trained in numpy; of
the words that share a code each has its part of all their occurrences, by its exact count. A document's score is the
sum over its words of the log probability of that word, masked, given the others.

Texts are read twice, to count and to encode; afterwards a word is two bytes. Counts of the most frequent words travel
with the code table, those of all other words are joined from the table of counts, pre-aggregated by document.

Training. Every word of every document is a training case once. Documents are dealt by a hash of their own to shards of
about ``SHARD`` words, so copies and scores do not depend on how the input is partitioned. Each shard trains a copy of
the network; copies are averaged by cases, task by task and then in an aggregate, before the driver sees the result. In
``TURNS`` turns, each with its share of the documents, the next starts from the average of the last.

What is gathered (counts of all words, codes, copies of the network) grows with the input; what is broadcast is bounded
by ``MOST_SIDE`` squared codes and ``KNOWN`` counts.

Defined cases. Null and empty texts: no tokens, score 0 and mean null. A word that was never counted cannot occur.
Null doc_id: passes through. Repeated rows: alike. Very long texts: whole, in slices that see their neighbours. An
empty table gives an empty table. Other columns are ignored, whatever their names.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyforge.llm.common import Lookup, WordHasher, ascii_nonword_separators, grouped, materialise, one_thread, word_chunks

SIDE = 2
EMBED, HIDDEN = 12, 24
LEAST_SIDE, MOST_SIDE = 8, 64
KNOWN = 131_072
SHARD, TURNS, RATE = 1 << 21, 2, 0.05
STEPS, LEAST_BATCH, MOST_BATCH = 512, 128, 4096
SLICE = 1 << 15
TILE, SPAN = 8, 512
UNITS = 2.0**28
BLOCK = 4096


def side_of(distinct: int) -> int:
    """Groups, and members of each group, for so many distinct words: a power of two near an eighth of their root."""
    return int(min(MOST_SIDE, max(LEAST_SIDE, 2 ** round(math.log2(max(1.0, math.sqrt(distinct) / 8))))))


def shapes(side: int) -> list[tuple[int, ...]]:
    """Embeddings (the last stands beyond either end of a text), hidden layer, groups, members."""
    return [(side * side + 1, EMBED), (2 * SIDE * EMBED, HIDDEN), (HIDDEN,), (HIDDEN, side), (side,), (side, HIDDEN, side), (side, side)]


def new_network(side: int, seed: int = 1) -> np.ndarray:
    rng = np.random.default_rng(seed)
    scale = [0.3, 0.2, 0.0, 0.2, 0.0, 0.2, 0.0]
    return np.concatenate([rng.normal(0, s, int(np.prod(shape))) if s else np.zeros(int(np.prod(shape))) for s, shape in zip(scale, shapes(side), strict=True)]).astype(np.float32)


def parts_of(flat: np.ndarray, side: int) -> list[np.ndarray]:
    """Views of the arrays that make up a network."""
    out, at = [], 0
    for shape in shapes(side):
        n = int(np.prod(shape))
        out.append(flat[at : at + n].reshape(shape))
        at += n
    return out


class Codes:
    """Codes of words, and the log share of each among the words of its code."""

    def __init__(self, side: int, hashes: np.ndarray, counts: np.ndarray, mass: np.ndarray):
        """``hashes``, ``counts``: words, the most frequent first; ``mass``: occurrences of all words without an own code, by hashed code."""
        self.side, self.hashes, self.counts, self.mass = side, hashes, counts, mass
        self.own = own_codes(side)
        self.lookup = Lookup(hashes)
        self.log_mass = np.log(np.maximum(mass, 1.0))
        self.log_counts = np.log(np.maximum(counts, 1.0))

    def __reduce__(self):
        return Codes, (self.side, self.hashes, self.counts, self.mass)

    def prior(self) -> np.ndarray:
        """Share of each code of all occurrences, by group and member."""
        mass = np.zeros(self.side * self.side)
        n = min(self.own, len(self.counts))
        mass[:n] = self.counts[:n]
        mass[self.own :] = self.mass
        mass = np.maximum(mass, 0.5)
        return (mass / mass.sum()).reshape(self.side, self.side)

    def __call__(self, h: np.ndarray, at: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(codes, log shares, whether the log count is still to be added to the share); ``at``: places in the list, if known."""
        at = self.lookup(h) if at is None else at
        shared = ((h >> np.uint64(33)) % np.uint64(len(self.mass))).astype(np.int64)
        alone = (at >= 0) & (at < self.own)
        inside = np.where(alone, 0.0, -self.log_mass[shared])
        counted = at >= self.own
        inside[counted] += self.log_counts[at[counted]]
        return np.where(alone, at, self.own + shared), inside, at < 0


def own_codes(side: int) -> int:
    return side * side * 3 // 4


def contexts(held: list[np.ndarray], edge: int, order=slice(None)) -> np.ndarray:
    """For each word of the texts, in this order, the codes of SIDE words before and after it; ``edge`` beyond the ends of its text."""
    gap = np.full(SIDE, edge, np.uint16)
    line = np.concatenate([gap, *(x for text in held for x in (text, gap))])
    sizes = [len(text) for text in held]
    places = (np.arange(sum(sizes)) + SIDE * np.repeat(np.arange(1, len(held) + 1), sizes))[order]
    out = np.empty((len(places), 2 * SIDE), np.uint16)
    for k, step in enumerate([*range(-SIDE, 0), *range(1, SIDE + 1)]):
        out[:, k] = line.take(places + step)
    return out


def sums_of(x: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Sums of runs of these sizes, each by itself: a run has the same sum whatever runs are beside it."""
    out, some = np.zeros(len(sizes)), np.flatnonzero(sizes)
    if len(some):
        out[some] = np.add.reduceat(x, (np.cumsum(sizes) - sizes)[some])
    return out


def _wide(w: list[np.ndarray]) -> tuple[bool, bool]:
    """Whether logits of groups, and of members, could be too large for their powers; hidden values are at most one."""
    return tuple(bool(np.abs(a).sum(axis=-2).max() + np.abs(b).max() > 60) for a, b in ((w[3], w[4]), (w[5], w[6])))


def _heads(w: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Weights of groups, and of members by group, each with its biases as the last row."""
    return np.concatenate([w[3], w[4][None]]), np.concatenate([w[5], w[6][:, None]], axis=1)


def _by_group(group: np.ndarray, side: int) -> tuple[np.ndarray, list[tuple[int, int, int]]]:
    """An order by group, and (group, first, end) of each that occurs."""
    order = np.argsort(group.astype(np.uint16), kind="stable")  # two bytes are sorted by their digits
    edges = np.concatenate([[0], np.cumsum(np.bincount(group, minlength=side))]).tolist()
    return order, [(g, a, b) for g, (a, b) in enumerate(zip(edges[:-1], edges[1:], strict=True)) if a < b]


def _log_shares(z: np.ndarray, right: np.ndarray, wide: bool) -> np.ndarray:
    """Log probability of the ``right`` column of each row of logits, which are overwritten."""
    if wide:
        z -= z.max(axis=1, keepdims=True)
    chosen = z[np.arange(len(z)), right]
    return chosen - np.log(np.exp(z, out=z).sum(axis=1))


def log_probabilities(w: list[np.ndarray], context: np.ndarray, codes: np.ndarray, side: int) -> np.ndarray:
    """Log probability of each code given its context.

    A case has the same result whatever cases are beside it. The rounding of a library's product depends on the place of
    a row, more so outside whole tiles, so products are taken in double precision of ``TILE`` rows at least, and rounded
    to the network's own precision before anything else.
    """
    kind, wide = w[0].dtype, _wide(w)
    e, a, b, *_ = w = [x.astype(np.float64) for x in w]
    cd, mn = _heads(w)
    order, runs = _by_group(codes // side, side)
    place, spans, end = np.empty(len(codes), np.int64), [], 0
    for g, i, j in runs:
        place[i:j] = np.arange(end, end + j - i)
        start, end = end, end + -(-(j - i) // TILE) * TILE
        spans += [(g, k, min(k + SPAN, end)) for k in range(start, end, SPAN)]
    near, code = np.full((end, context.shape[1]), side * side), np.zeros(end, np.int64)
    near[place], code[place] = context.take(order, axis=0), codes.take(order)
    group, member = code // side, code % side
    h, logs = np.ones((end, HIDDEN + 1)), np.empty(end)
    for i in range(0, end, SPAN):
        rows = slice(i, i + SPAN)
        z = e.take(near[rows], axis=0).reshape(-1, len(a)) @ a
        z += b
        h[rows, :-1] = np.tanh(z.astype(kind))
        logs[rows] = _log_shares((h[rows] @ cd).astype(kind), group[rows], wide[0])
    for g, i, j in spans:
        logs[i:j] += _log_shares((h[i:j] @ mn[g]).astype(kind), member[i:j], wide[1])
    out = np.empty(len(codes))
    out[order] = logs[place]
    return out


def _errors(z: np.ndarray, right: np.ndarray, wide: bool) -> np.ndarray:
    """Gradient of the mean negative log probability by the logits, in their place; where they can be ``wide``, the largest of each row is taken off first."""
    if wide:
        z -= z.max(axis=1, keepdims=True)
    np.exp(z, out=z)
    size = len(z)
    z *= (1 / (size * (z @ np.ones(z.shape[1], z.dtype))))[:, None]
    z[np.arange(size), right] -= 1 / size
    return z


def slopes(w: list[np.ndarray], context: np.ndarray, codes: np.ndarray, side: int) -> list[np.ndarray]:
    """Gradients of the mean negative log probability by all arrays of the network, zero for groups that do not occur.

    Only products are taken group by group; the rest is done on the whole batch at once.
    """
    wide, (cd, mn) = _wide(w), _heads(w)
    order, runs = _by_group(codes // side, side)
    context, codes = context.take(order, axis=0), codes.take(order)
    x = w[0].take(context, axis=0).reshape(len(codes), -1)
    h = np.ones((len(codes), HIDDEN + 1), x.dtype)  # the last column is of the biases
    h[:, :-1] = np.tanh(x @ w[1] + w[2])
    errors = _errors(h @ cd, codes // side, wide[0])
    g_cd, back = h.T @ errors, errors @ w[3].T
    inner, g_mn = np.empty_like(back), np.zeros_like(mn)
    for g, i, j in runs:
        np.dot(h[i:j], mn[g], out=errors[i:j])
    errors = _errors(errors, codes % side, wide[1])
    for g, i, j in runs:
        np.dot(h[i:j].T, errors[i:j], out=g_mn[g])
        np.dot(errors[i:j], w[5][g].T, out=inner[i:j])
    back += inner
    back *= 1 - np.square(h[:, :-1])
    # by numbers of an embedding, each over the words of all places one after the other
    into = (w[1].reshape(2 * SIDE, EMBED, HIDDEN).swapaxes(0, 1).reshape(-1, HIDDEN) @ back.T).reshape(EMBED, -1)
    near, g_e = context.T.ravel().astype(np.intp), np.empty_like(w[0])
    for k in range(EMBED):
        g_e[:, k] = np.bincount(near, into[k], len(g_e))
    return [g_e, x.T @ back, back.sum(axis=0), g_cd[:-1], g_cd[-1], g_mn[:, :-1], g_mn[:, -1]]


def gradients(w: list[np.ndarray], context: np.ndarray, codes: np.ndarray, side: int):
    """Gradients of the shared arrays, and (group, of m[group], of n[group]) of the groups that occur."""
    *shared, m, n = slopes(w, context, codes, side)
    return shared, [(g, m[g], n[g]) for g in np.unique(codes // side)]


def train(flat: np.ndarray, side: int, context: np.ndarray, codes: np.ndarray, rate: float = RATE) -> np.ndarray:
    """One pass of Adagrad over the cases, in about ``STEPS`` steps."""
    flat = flat.copy()
    w = parts_of(flat, side)
    seen = parts_of(np.full(len(flat), 1e-7, flat.dtype), side)
    batch = min(MOST_BATCH, max(LEAST_BATCH, len(codes) // STEPS))
    for at in range(0, len(codes), batch):
        for p, s, grad in zip(w, seen, slopes(w, context[at : at + batch], codes[at : at + batch], side), strict=True):
            s += grad * grad
            p -= rate * grad / np.sqrt(s)
    return flat


def _counting(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    hasher = WordHasher(ascii_nonword_separators())
    held, size = [], 0

    def flush():
        h, n = np.unique(np.concatenate(held), return_counts=True)
        return pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(n.astype(np.int64))], ["h", "n"])

    for batch in batches:
        for _, h, _ in word_chunks(batch.column(0), hasher):
            held.append(h)
            size += len(h)
            if size > 4_000_000:
                yield flush()
                held, size = [], 0
    if size:
        yield flush()


def _encoding(codes: Codes):
    """Rows of (doc_id, text) to (doc_id, n, inside, own, codes, rare, times).

    Codes are two bytes each; own counts the words of the list that stand in no other document; rare are the words whose
    count is not known here.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = WordHasher(ascii_nonword_separators())
        for batch in batches:
            for first, h, sizes in word_chunks(batch.column(1), hasher):
                at = codes.lookup(h)
                code, inside, unknown = codes(h, at)
                raw = code.astype("<u2").tobytes()
                edges = np.concatenate([[0], np.cumsum(sizes)])
                rare, times, own = [], [], []
                for i, j in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
                    u, n = np.unique(h[i:j][unknown[i:j]], return_counts=True)
                    rare.append(u.view(np.int64))
                    times.append(n.astype(np.int32))
                    u, n = np.unique(at[i:j][~unknown[i:j]], return_counts=True)
                    own.append(int(n[codes.counts[u] == n].sum()))
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(first, len(sizes)), pa.array(sizes, pa.int64()), pa.array(sums_of(inside, sizes)), pa.array(own, pa.int64()),
                        pa.array([raw[2 * i : 2 * j] for i, j in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True)], pa.binary()),
                        pa.array(rare, pa.list_(pa.int64())), pa.array(times, pa.list_(pa.int32())),
                    ],
                    ["doc_id", "n", "inside", "own", "codes", "rare", "times"],
                )

    return run


def _training(flat: np.ndarray, side: int, turn: int):
    """Rows of (shard, codes), in order of shard, to blocks of the task's copies, summed and weighted by their cases."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one_thread()
        total, cases = np.zeros(len(flat)), 0

        def solve(group: pa.Table):
            nonlocal total, cases
            held = [np.frombuffer(x, "<u2") for x in group.column("codes").to_pylist()]
            code = np.concatenate(held).astype(np.int64)
            order = np.random.default_rng([turn, len(code)]).permutation(len(code))
            total += len(code) * train(flat, side, contexts(held, side * side, order), code.take(order)).astype(np.float64)
            cases += len(code)
            yield from ()

        for _ in grouped(1, solve)(batches):
            pass
        if cases:
            cuts = range(0, len(flat), BLOCK)
            yield pa.RecordBatch.from_arrays([pa.array(range(len(cuts)), pa.int32()), pa.array([cases] * len(cuts), pa.int64()), pa.array([total[i : i + BLOCK].tobytes() for i in cuts], pa.binary())], ["block", "cases", "w"])

    return run


def _summing(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of (block, cases, w), in order of block, added up."""
    block, cases, total = None, 0, None

    def row():
        return pa.RecordBatch.from_arrays([pa.array([block], pa.int32()), pa.array([cases], pa.int64()), pa.array([total.tobytes()], pa.binary())], ["block", "cases", "w"])

    for batch in batches:
        for b, n, w in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
            if b != block:
                if block is not None:
                    yield row()
                block, cases, total = b, 0, np.zeros(len(w) // 8)
            cases += n
            total += np.frombuffer(w)
    if block is not None:
        yield row()


def _scoring(flat: np.ndarray, side: int):
    """Rows of (doc_id, rid, n, inside, codes, own) to (doc_id, rid, n, s, own): the sum of log probabilities but for joined counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one_thread()
        w = parts_of(flat, side)
        for batch in batches:
            held = [np.frombuffer(x, "<u2") for x in batch.column(4).to_pylist()]
            sums = np.zeros(len(held))
            at = 0
            while at < len(held):
                end, size = at, 0
                while end < len(held) and (end == at or size + len(held[end]) <= SLICE):
                    size += len(held[end])
                    end += 1
                if size:
                    code = np.concatenate(held[at:end]).astype(np.int64)
                    context = contexts(held[at:end], side * side)
                    logp = np.concatenate([log_probabilities(w, context[i : i + SLICE], code[i : i + SLICE], side) for i in range(0, size, SLICE)])
                    sums[at:end] = sums_of(logp, np.array([len(x) for x in held[at:end]]))
                at = end
            s = sums + batch.column(3).to_numpy(zero_copy_only=False)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), pa.array(s), batch.column(5)], ["doc_id", "rid", "n", "s", "own"])

    return run


def code_table(counts: DataFrame) -> Codes:
    """Codes for a table of counts (h, n) of all words."""
    whole = counts.agg(F.count("*").alias("d")).first()
    side = side_of(whole["d"])
    own, shared = own_codes(side), side * side - own_codes(side)
    # bounded: as many rows as there are codes and known counts at most
    top = counts.orderBy(F.desc("n"), "h").limit(own + KNOWN).toPandas()
    hashes, n = top.h.to_numpy(np.int64).view(np.uint64), top.n.to_numpy(np.float64)
    sums = counts.groupBy((F.shiftrightunsigned("h", 33) % shared).cast("int").alias("code")).agg(F.sum("n").alias("n")).collect()
    mass = np.zeros(shared)
    for r in sums:
        mass[r["code"]] = r["n"]
    mass -= np.bincount(((hashes[:own] >> np.uint64(33)) % np.uint64(shared)).astype(np.int64), n[:own], shared)
    return Codes(side, hashes, n, mass)


def fit(docs: DataFrame) -> tuple[DataFrame, DataFrame, Codes, np.ndarray]:
    """(encoded documents with a row id, counts of words, codes, network), from all documents."""
    texts = docs.select("text").where("text is not null and text != ''")
    counts = materialise(texts.mapInArrow(_counting, "h long, n long").groupBy("h").agg(F.sum("n").alias("n")), "counts")
    codes = code_table(counts)
    encoded = docs.select("doc_id", "text").mapInArrow(_encoding(codes), "doc_id long, n long, inside double, own long, codes binary, rare array<long>, times array<int>")
    encoded = materialise(encoded.withColumn("rid", F.monotonically_increasing_id()), "encoded")
    side, flat = codes.side, new_network(codes.side)
    w, prior = parts_of(flat, side), codes.prior()
    w[4][:] = np.log(prior.sum(axis=1))
    w[6][:] = np.log(prior / prior.sum(axis=1, keepdims=True))
    total = encoded.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first()["n"]
    shards = max(1, math.ceil(total / TURNS / SHARD))
    mark = F.xxhash64("doc_id", "codes")
    for turn in range(TURNS):
        turned = encoded.where("n > 0").select(mark.alias("mark"), "codes").where(F.pmod("mark", F.lit(TURNS)) == turn)
        dealt = turned.withColumn("shard", F.pmod(F.xxhash64("mark"), F.lit(shards))).repartition(shards, "shard").sortWithinPartitions("shard", "mark")
        copies = dealt.select("shard", "codes").mapInArrow(_training(flat, side, turn), "block int, cases long, w binary")
        sums = copies.repartition(max(1, len(flat) // BLOCK // 8), "block").sortWithinPartitions("block").mapInArrow(_summing, "block int, cases long, w binary").collect()
        if sums:  # as many numbers as the network has
            flat = np.concatenate([np.frombuffer(r["w"]) / r["cases"] for r in sorted(sums, key=lambda r: r["block"])]).astype(np.float32)
    return encoded, counts, codes, flat


def lm_report(docs: DataFrame) -> DataFrame:
    """doc_id, n_tokens, log_likelihood (the sum over tokens), its mean, and n_unshared, for every row of ``docs``.

    n_unshared counts the tokens whose word stands in no other row: what a model of the others would know nothing of.
    """
    encoded, counts, codes, flat = fit(docs)
    scored = encoded.select("doc_id", "rid", "n", "inside", "codes", "own").mapInArrow(_scoring(flat, codes.side), "doc_id long, rid long, n long, s double, own long")
    rare = encoded.where(F.size("rare") > 0).select("rid", F.explode(F.arrays_zip("rare", "times")).alias("x")).select("rid", F.col("x.rare").alias("h"), F.col("x.times").alias("k"))
    alone = F.sum(F.when(F.col("k") == F.col("n"), F.col("k")).otherwise(0))
    # in whole units, since sums of fractions depend on the order of the rows; a text of 2 GB stays within a long
    more = F.sum(F.round(F.col("k") * F.log("n") * F.lit(UNITS)).cast("long")) / F.lit(UNITS)
    added = rare.join(counts, "h").groupBy("rid").agg(more.alias("more"), alone.alias("alone"))
    joined = scored.join(added, "rid", "left").select("doc_id", F.col("n").alias("n_tokens"), (F.col("s") + F.coalesce("more", F.lit(0.0))).alias("log_likelihood"), (F.col("own") + F.coalesce("alone", F.lit(0))).alias("n_unshared"))
    mean = F.when(F.col("n_tokens") > 0, F.col("log_likelihood") / F.col("n_tokens"))
    return joined.select("doc_id", "n_tokens", "log_likelihood", mean.alias("mean_log_likelihood"), "n_unshared")
