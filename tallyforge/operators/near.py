"""Near-equal texts by the similarity of their shingle sets: exact pairs, or one row per text with its class and links.

1. Shingles are put in one order for all texts: those that many texts have come last, as far as counts of hashed shingles show
   it (counted by numpy in each task, in as many cells whatever the input; the order decides on work, never on results). Two
   sets as similar as wanted have a shingle in common among the first few of each (their prefixes).
2. Texts meet by shingle of their prefix and length class: sizes of near texts differ by a factor, so they lie in one class or
   in two neighbouring ones. Among the longer texts of the next class a shorter prefix does. Where they meet, sizes, the
   places of the shingle (which bound what can still follow) and bitmaps of all shingles (the bits that differ bound the
   difference from below) refuse pairs without reading their sets; no such test refuses a near pair. Where few meet, the
   pairs go on, each once, and bitmaps are joined to them. Where many meet, the same texts mostly meet by many shingles: each
   such crowd goes on once, bitmaps are joined to it, and it sends on a spanning forest of what is left, never its pairs.
3. Joined parts of these forests are families. Texts of a family are compared in blocks by length class, all at once on
   their whole sets, which only move to blocks where there is another text. A block sends on its pairs where pairs are
   wanted, or else links per text and a forest again.

Shingles are written once; only prefixes of them are shuffled to meeting places, bitmaps (which would make rows of a text
grow with the square of its length there) only to pairs and crowds, whole sets only to families.
So rows grow with texts, not with the square of a family, as long as classes are asked for. Meeting places and families beyond
a block are dealt to every pair of blocks: bounded memory, whatever a shingle or a family holds.

Defined cases. Texts with fewer than ``least`` shingles take no part. Null texts must be left out before. Repeated rows are
one text. An empty table gives empty results.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyforge.functions.text import words
from tallyforge.sources.io import materialise

#: Texts in a block of a meeting place, and of a family.
MEETING_BLOCK = 2048
FAMILY_BLOCK = 512
SALTS = 8
#: Texts at a meeting place whose pairs are all looked at at once.
FEW = 16
#: Texts of a crowd whose pairs are all looked at at once, and bytes of bitmaps at once.
WHOLE, MAPS = 256, 1 << 22
#: Cells in which shingles are counted, and cells in a row of counts.
CELLS, CELLS_IN_ROW = 1 << 20, 1 << 14
#: Sets that are compared two by two; more of them all at once.
SHARED = 6
#: Bits of a bitmap at least and at most; between them half as many as there are shingles.
BITS = (256, 1 << 16)


def run_hashes(hashes: np.ndarray, n: int) -> np.ndarray:
    """A hash of every n hashes that follow each other, mixed after each step so that their order counts."""
    out = np.zeros(max(0, len(hashes) - n + 1), np.uint64)
    for k in range(n):
        out = (out + hashes[k : k + len(out)]) * np.uint64(0x9E3779B97F4A7C15)
        out ^= out >> np.uint64(32)
    return out.view(np.int64)


def _shingled(n: int, least: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hashes = batch.column("w")
            values, at = hashes.values.to_numpy(zero_copy_only=False).view(np.uint64), hashes.offsets.to_numpy()
            kept, sets = [], []
            for i, (a, b) in enumerate(zip(at.tolist(), at[1:].tolist(), strict=False)):
                own = np.sort(run_hashes(values[a:b], n))
                own = own[np.concatenate([[True], own[1:] != own[:-1]])] if len(own) else own
                if len(own) >= least:
                    kept.append(i)
                    sets.append(own)
            if kept:
                size = np.array([len(x) for x in sets], np.int32)
                grams = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(size)]), pa.int32()), pa.array(np.concatenate(sets)))
                names = [batch.column(c).take(pa.array(kept)) for c in ("id", "text_type", "h")]
                yield pa.RecordBatch.from_arrays([*names, grams, pa.array(size)], ["id", "text_type", "h", "grams", "size"])

    return run


def text_sets(rows: DataFrame, n: int = 5, least: int = 26, text: str = "norm") -> DataFrame:
    """(id, text_type, h, grams, size) of the distinct texts with at least ``least`` shingles (runs of n words, ascending hashes).

    Words are found and hashed one by one in the JVM; their runs are hashed by numpy.
    """
    # a fixed number of partitions: texts are small next to the work that they make, so their bytes must not decide on tasks
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    distinct = rows.select("text_type", F.col(text).alias("t")).repartition(parts, "text_type", "t").distinct()
    made = distinct.select(F.monotonically_increasing_id().alias("id"), "text_type", F.sha2("t", 256).alias("h"), F.transform(words(F.col("t")), lambda w: F.xxhash64(w)).alias("w"))
    return materialise(made.mapInArrow(_shingled(n, least), "id long, text_type string, h string, grams array<long>, size int"), "grams")


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(row, counts): how many shingles fall into each cell, in rows of cells."""
    total = np.zeros(CELLS, np.int32)
    for batch in batches:
        grams = batch.column("grams").flatten().to_numpy(zero_copy_only=False)
        total += np.bincount(grams & (CELLS - 1), minlength=CELLS).astype(np.int32)
    rows = total.reshape(-1, CELLS_IN_ROW)
    yield pa.RecordBatch.from_arrays([pa.array(range(len(rows)), pa.int32()), pa.array([r.tobytes() for r in rows], pa.binary())], ["row", "counts"])


def _levels(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(row, levels) from (row, counts): 0 for cells as full as chance has it, more for those that hold a frequent shingle."""
    found: dict[int, np.ndarray] = {}
    for batch in batches:
        for row, counts in zip(batch.column("row").to_pylist(), batch.column("counts").to_pylist(), strict=True):
            found[row] = found.get(row, 0) + np.frombuffer(counts, np.int32).astype(np.int64)
    for row, counts in found.items():
        usual = np.median(counts)
        over = np.maximum(counts - usual - 8 * np.sqrt(usual) - 16, 0)
        yield pa.RecordBatch.from_arrays([pa.array([row], pa.int32()), pa.array([np.ceil(np.log2(1 + over)).astype(np.uint8).tobytes()], pa.binary())], ["row", "levels"])


def frequent(sets: DataFrame) -> np.ndarray:
    """The level of each cell of shingles: ``CELLS`` bytes, whatever the input."""
    counts = sets.select("grams").mapInArrow(_counted, "row int, counts binary")
    levels = counts.repartition(CELLS // CELLS_IN_ROW // 8, "row").mapInArrow(_levels, "row int, levels binary")
    out = np.zeros((CELLS // CELLS_IN_ROW, CELLS_IN_ROW), np.uint8)
    for row, found in levels.collect():
        out[row] = np.frombuffer(found, np.uint8)
    return out.ravel()


def _prefixes(similarity: float, levels: np.ndarray):
    # a little more than the factor, so that rounding never puts near sizes two classes apart
    step = -math.log(similarity) * (1 + 1e-9)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            grams = batch.column("grams")
            values, at = grams.values.to_numpy(zero_copy_only=False), grams.offsets.to_numpy()
            short, k, prefix, bits, bits_up = [], [], [], [], []
            for a, b in zip(at, at[1:], strict=False):
                own, n = np.sort(values[a:b]), int(b - a)
                order = np.argsort(levels[own & (CELLS - 1)], kind="stable")
                c = math.floor(math.log(n) / step)
                # whatever is near shares this much at least; where the other one is as long or longer, twice the share of both
                prefix.append(own[order[: n - math.ceil(n * similarity - 1e-9) + 1]])
                short.append(n - math.ceil(2 * n * similarity / (1 + similarity) - 1e-9) + 1)
                k.append(c)
                bits.append(bitmap(own, bits_of(c, similarity)))
                bits_up.append(bitmap(own, bits_of(c + 1, similarity)))
            made = [pa.array(short, pa.int32()), pa.array(k, pa.int32()), pa.array(prefix, pa.list_(pa.int64())), pa.array(bits, pa.binary()), pa.array(bits_up, pa.binary())]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("id", "text_type", "h", "size")), *made], ["id", "text_type", "h", "size", "short", "k", "prefix", "bits", "bits_up"])

    return run


def numbered(sets: DataFrame) -> DataFrame:
    """``sets`` with ids that stay."""
    return sets if "id" in sets.columns else materialise(sets.withColumn("id", F.monotonically_increasing_id()), "numbered")


def ordered(sets: DataFrame, similarity: float) -> DataFrame:
    """(id, text_type, h, size, short, k, prefix, bits, bits_up) of the texts.

    prefix: the shingles to meet by, in order; short: how many of them do among longer texts; k: the length class; bits and
    bits_up: bitmaps for that class and for the next one.
    """
    sets = numbered(sets).where("size > 0")
    run = _prefixes(similarity, frequent(sets))
    return materialise(sets.select("id", "text_type", "h", "size", "grams").mapInArrow(run, "id long, text_type string, h string, size int, short int, k int, prefix array<long>, bits binary, bits_up binary"), "ordered")


def classed(rows: DataFrame) -> DataFrame:
    """``rows`` in the class of their own and as visitors (``host`` false) in the next one; c: the class they are in."""
    return rows.withColumn("c", F.explode(F.array(F.col("k"), F.col("k") + 1))).withColumn("host", F.col("c") == F.col("k"))


def placed(rows: DataFrame, key: list[str], size: int) -> DataFrame:
    """``rows`` with place (a hash of ``key`` and blocks), split and side.

    A key with more rows than ``size`` is cut into blocks, and a row goes to every pair of blocks that holds its own: there
    ``split`` says that two blocks meet, ``side`` which one is its own. Such keys are few, so their table is small.
    """
    named = rows.withColumn("place", F.xxhash64(*key))
    heavy = materialise(named.groupBy("place").agg(F.count("*").alias("n")).where(F.col("n") > size).select("place", F.ceil(F.col("n") / size).cast("int").alias("blocks")), "heavy")
    met = named.join(heavy, "place", "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    own, other = F.pmod(F.xxhash64("id", F.lit(5)), F.col("blocks")).cast("int"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    sides = met.withColumn("own_block", own).withColumn("other", other).withColumns({"split": F.col("own_block") != F.col("other"), "side": F.col("own_block") > F.col("other")})
    pair = F.when(F.col("blocks") == 1, F.col("place")).otherwise(F.xxhash64("place", F.least("own_block", "other"), F.greatest("own_block", "other")))
    return sides.withColumn("place", pair).drop("own_block", "other", "blocks")


def gathered(rows: DataFrame) -> DataFrame:
    """``rows`` place by place."""
    return rows.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), "place").sortWithinPartitions("place")


def bits_of(c: int, similarity: float) -> int:
    """Bits of the bitmaps of a class: a power of two, about half of the shingles of its longest texts or more."""
    return int(min(BITS[1], max(BITS[0], 1 << math.ceil(math.log2(max(2.0, similarity ** -(c + 1.0) / 2))))))


def bitmap(tokens: np.ndarray, bits: int) -> bytes:
    """Bit i: whether an odd number of tokens fall on it."""
    return np.packbits((np.bincount((tokens.view(np.uint64) & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1).astype(bool)).tobytes()


def forest(n: int, near: Callable[[int, np.ndarray], np.ndarray]) -> list[tuple[int, int]]:
    """Edges of a spanning forest; ``near(i, rest)`` says which of ``rest`` are neighbours of i. A clique costs one look."""
    rest, out = np.arange(n), []
    while len(rest):
        queue, rest = [int(rest[0])], rest[1:]
        while queue and len(rest):
            i = queue.pop()
            hit = near(i, rest)
            more = rest[hit].tolist()
            out += [(i, j) for j in more]
            queue += more
            rest = rest[~hit]
    return out


class Meeting:
    """Texts of many meeting places, one after the other, and the pairs of them that no bound refuses."""

    def __init__(self, t: pa.Table, similarity: float):
        self.similarity, self.share = similarity, similarity / (1 + similarity)
        self.ids, self.size, self.at = (t.column(x).to_numpy() for x in ("id", "size", "at"))
        self.host, self.side, self.split = (t.column(x).to_numpy(zero_copy_only=False) for x in ("host", "side", "split"))
        self.maps: dict[int, np.ndarray] = {}
        if "bits" in t.column_names:
            self.read_maps(t)

    def read_maps(self, t: pa.Table) -> None:
        bits = t.column("bits").combine_chunks()
        at = np.frombuffer(bits.buffers()[1], np.int32)[bits.offset : bits.offset + len(bits) + 1].astype(np.int64)
        data, self.width = np.frombuffer(bits.buffers()[2], np.uint8), np.diff(at)
        self.place = np.zeros(len(bits), np.int64)
        for w in np.unique(self.width).tolist():
            mine = np.flatnonzero(self.width == w)
            self.place[mine] = np.arange(len(mine))
            self.maps[w] = np.ascontiguousarray(data[at[mine][:, None] + np.arange(w)]).view(np.uint64)

    def near(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Whether rows i and j of one place each may be near."""
        a, b = self.size[i], self.size[j]
        need = self.share * (a + b) - 1e-6  # of both sets, to be shared
        # what is before the shingle in one order can be shared at most as far as the shorter start goes, likewise after it
        room = np.minimum(a - self.at[i], b - self.at[j]) + np.minimum(self.at[i], self.at[j])
        ok = (self.host[i] | self.host[j]) & (np.minimum(a, b) >= self.similarity * np.maximum(a, b) - 1e-9) & (room >= need)
        ok &= ~self.split[i] | (self.side[i] != self.side[j])
        for w, maps in self.maps.items():
            some = np.flatnonzero(ok & (self.width[i] == w))
            step = max(1, MAPS // w)
            for k in range(0, len(some), step):
                s = some[k : k + step]
                differ = np.bitwise_count(maps[self.place[i[s]]] ^ maps[self.place[j[s]]]).sum(axis=1)
                ok[s] = differ <= a[s] + b[s] - 2 * need[s]
        return ok

    def pairs(self, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """What may be near at each place of few texts: rows i and j."""
        u, v, count = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], ends - starts
        for n in range(2, FEW + 1):
            first = starts[count == n]
            if len(first):
                x, y = np.triu_indices(n, 1)
                i, j = (first[:, None] + x).ravel(), (first[:, None] + y).ravel()
                ok = self.near(i, j)
                u.append(i[ok])
                v.append(j[ok])
        return np.concatenate(u), np.concatenate(v)

    def crowds(self, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rows of each place of many texts, and a number for each that tells who meets there, whatever the shingle."""
        many = ends - starts > FEW
        starts, count = starts[many], (ends - starts)[many]
        if not len(starts):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        rows = np.repeat(starts - np.concatenate([[0], np.cumsum(count)[:-1]]), count) + np.arange(count.sum())
        x = self.ids[rows].astype(np.uint64) * np.uint64(8) + (self.host[rows] * 4 + self.side[rows] * 2 + self.split[rows]).astype(np.uint64)
        for factor, shift in ((0x9E3779B97F4A7C15, 32), (0xD6E8FEB86659FD93, 29), (0xD6E8FEB86659FD93, 32)):
            x = (x + np.uint64(1)) * np.uint64(factor)
            x ^= x >> np.uint64(shift)
        return rows, np.repeat(np.add.reduceat(x, np.cumsum(count) - count).view(np.int64), count)

    def edges(self, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """A spanning forest, in ids, of what may be near at each place."""
        u, v = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for a, b in zip(starts.tolist(), ends.tolist(), strict=True):
            if b - a <= WHOLE:
                x, y = np.triu_indices(b - a, 1)
                near = np.zeros((b - a, b - a), bool)
                near[x, y] = near[y, x] = self.near(a + x, a + y)
                found = forest(b - a, lambda i, rest: near[i, rest])  # noqa: B023
            else:
                found = forest(b - a, lambda i, rest: self.near(np.full(len(rest), a + i), a + rest))  # noqa: B023
            if found:
                x, y = np.array(found).T
                u.append(a + x)
                v.append(a + y)
        return self.ids[np.concatenate(u)], self.ids[np.concatenate(v)]


def runs(solve: Callable[[pa.Table, np.ndarray, np.ndarray], pa.RecordBatch | None]):
    """``solve`` on tables sorted by place, with starts and ends of places; a place that a batch cuts waits for the next one."""

    def cut(t: pa.Table, whole: bool) -> tuple[pa.RecordBatch | None, pa.Table | None]:
        key = t.column("place").to_numpy()
        edge = np.concatenate([[0], np.flatnonzero(np.diff(key)) + 1, [len(key)]])
        starts, ends, rest = edge[:-1], edge[1:], None
        if not whole:
            rest, starts, ends = t.slice(int(starts[-1])), starts[:-1], ends[:-1]
        return solve(t.slice(0, int(ends[-1])), starts, ends) if len(starts) else None, rest

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest = None
        for batch in batches:
            if batch.num_rows:
                t = pa.Table.from_batches([batch])
                made, rest = cut(t if rest is None else pa.concat_tables([rest, t]), False)
                if made is not None:
                    yield made
        if rest is not None and rest.num_rows:
            made, _ = cut(rest, True)
            if made is not None:
                yield made

    return run


def _meet(similarity: float):
    """Pairs of places of few texts (crowd null) and rows of places of many (v null), from rows without bitmaps."""

    def solve(t: pa.Table, starts: np.ndarray, ends: np.ndarray) -> pa.RecordBatch | None:
        m = Meeting(t, similarity)
        i, j = m.pairs(starts, ends)
        i, j = np.where(m.ids[i] < m.ids[j], i, j), np.where(m.ids[i] < m.ids[j], j, i)
        k, crowd = m.crowds(starts, ends)
        n, o = len(i), len(k)
        if not n + o:
            return None
        pair = np.arange(n + o) < n
        u = np.concatenate([i, k])
        v = np.concatenate([j, k])
        columns = [pa.array(np.concatenate([np.zeros(n, np.int64), crowd]), mask=pair), pa.array(m.ids[u]), pa.array(m.ids[v], mask=~pair), pa.array(m.host[u]), pa.array(m.host[v]), pa.array(m.side[u] & ~pair), pa.array(m.split[u] & ~pair), pa.array(m.size[u]), pa.array(m.size[v])]
        return pa.RecordBatch.from_arrays(columns, ["crowd", "u", "v", "u_host", "v_host", "side", "split", "u_size", "v_size"])

    return runs(solve)


def _forests(similarity: float):
    """(u, v) from crowds with their bitmaps."""

    def solve(t: pa.Table, starts: np.ndarray, ends: np.ndarray) -> pa.RecordBatch | None:
        u, v = Meeting(t, similarity).edges(starts, ends)
        return pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], ["u", "v"]) if len(u) else None

    return runs(solve)


def _refused(similarity: float):
    """(u, v) of the pairs that their bitmaps do not refuse."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            need = similarity / (1 + similarity) * (batch.column("u_size").to_numpy() + batch.column("v_size").to_numpy()) - 1e-6
            most = batch.column("u_size").to_numpy() + batch.column("v_size").to_numpy() - 2 * need
            a, b = batch.column("u_bits"), batch.column("v_bits")
            differ = np.array([np.bitwise_count(np.frombuffer(x.as_buffer(), np.uint64) ^ np.frombuffer(y.as_buffer(), np.uint64)).sum() for x, y in zip(a, b, strict=True)])
            if len(differ):
                ok = pa.array(differ <= most)
                yield pa.RecordBatch.from_arrays([batch.column(c).filter(ok) for c in ("u", "v")], ["u", "v"])

    return run


def links(texts: DataFrame, similarity: float) -> DataFrame:
    """(u, v) ids: forests and pairs whose parts hold every near pair together."""
    rows = classed(texts.select("id", "text_type", "size", "short", "k", "prefix"))
    tokens = F.when(F.col("host"), F.col("prefix")).otherwise(F.slice("prefix", F.lit(1), F.col("short")))
    rows = rows.select("id", "text_type", "size", "c", "host", F.posexplode(tokens).alias("at", "g"))
    met = gathered(placed(rows, ["text_type", "g", "c"], MEETING_BLOCK).select("place", "id", "size", "at", "host", "side", "split"))
    met = materialise(met.mapInArrow(_meet(similarity), "crowd long, u long, v long, u_host boolean, v_host boolean, side boolean, split boolean, u_size int, v_size int"), "met")
    maps = texts.select("id", "bits", "bits_up")
    bits = lambda host: F.when(F.col(host), F.col("bits")).otherwise(F.col("bits_up"))
    pairs = met.where("crowd is null").select("u", "v", "u_host", "v_host", "u_size", "v_size").distinct()
    for s in "uv":
        pairs = pairs.join(maps, F.col(s) == F.col("id")).withColumn(f"{s}_bits", bits(f"{s}_host")).drop("id", "bits", "bits_up")
    crowds = met.where("crowd is not null").select(F.col("crowd").alias("place"), F.col("u").alias("id"), F.col("u_size").alias("size"), F.col("u_host").alias("host"), "side", "split").distinct()
    crowds = crowds.join(maps, "id").select("place", "id", "size", F.lit(0).alias("at"), "host", "side", "split", bits("host").alias("bits"))
    return pairs.mapInArrow(_refused(similarity), "u long, v long").union(gathered(crowds).mapInArrow(_forests(similarity), "u long, v long"))


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, label) of each node of ``edges`` (u, v); label: the smallest node that it is joined with.

    Each round takes the least label of all neighbours and then the label of one's label. A node with very many edges is
    met in ``SALTS`` parts. Not to settle is an error.
    """
    both = materialise(edges.union(edges.select("v", "u")).toDF("u", "v").where("u <> v").distinct().withColumn("salt", F.pmod(F.xxhash64("u", F.lit(3)), F.lit(SALTS)).cast("int")), "edges")
    now = materialise(both.groupBy(F.col("u").alias("node")).agg(F.least(F.min("v"), F.col("u")).alias("label")), "labels")
    every = F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))
    for _ in range(rounds):
        told = now.select(F.col("node").alias("v"), F.col("label").alias("theirs")).withColumn("salt", every)
        least = both.join(told, ["v", "salt"]).groupBy(F.col("u").alias("node")).agg(F.min("theirs").alias("theirs"))
        took = now.join(least, "node").select("node", F.least("label", "theirs").alias("new"), F.col("label").alias("old"))
        ahead = now.select(F.col("node").alias("new"), F.col("label").alias("next"))
        step = materialise(took.join(ahead, "new", "left").select("node", F.least("new", F.coalesce("next", "new")).alias("label"), "old"), "labels")
        if step.where("label <> old").limit(1).count() == 0:
            return now.select("node", "label")
        now = step.select("node", "label")
    raise RuntimeError(f"components: not settled after {rounds} rounds")


def overlaps(sets: list[np.ndarray], cells: int = 1 << 23) -> np.ndarray:
    """Sizes of the intersections of every two sets, by slabs of the tokens that at least two of them hold."""
    n = len(sets)
    owner = np.repeat(np.arange(n), [len(s) for s in sets])
    _, column, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    rank = np.cumsum(count > 1) - 1
    keep = count[column] > 1
    owner, column = owner[keep], rank[column[keep]]
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], column[order]
    total, width = np.zeros((n, n)), max(1, cells // n)
    top = int(column[-1]) + 1 if len(column) else 0
    for at in range(0, top, width):
        a, b = np.searchsorted(column, [at, at + width])
        m = np.zeros((n, min(width, top - at)), np.float32)
        m[owner[a:b], column[a:b] - at] = 1
        total += m @ m.T
    return total


def shared(sets: list[np.ndarray]) -> np.ndarray:
    """What ``overlaps`` gives off its diagonal, for a few sets of ascending tokens."""
    total = np.zeros((len(sets), len(sets)))
    for i, a in enumerate(sets):
        for j in range(i):
            met = np.sort(np.concatenate([a, sets[j]]), kind="stable")
            total[i, j] = total[j, i] = np.count_nonzero(met[1:] == met[:-1])
    return total


def _verify(similarity: float, pairs: bool):
    def block(ids: np.ndarray, size: np.ndarray, host: np.ndarray, side: np.ndarray, split: np.ndarray, sets: list[np.ndarray]) -> list[np.ndarray]:
        both = shared(sets) if len(sets) <= SHARED else overlaps(sets)
        jaccard = both / (size[:, None] + size[None, :] - both)
        near = (jaccard >= similarity) & (host[:, None] | host[None, :])
        if split.any():
            near &= side[:, None] != side[None, :]
        np.fill_diagonal(near, False)
        if pairs:
            u, v = np.nonzero(np.triu(near))
            return [ids[u], ids[v], jaccard[u, v]]
        root = np.arange(len(ids))
        for i, j in forest(len(ids), lambda i, rest: near[i, rest]):
            root[j] = root[i]
        some = np.flatnonzero(near.any(axis=1))
        return [ids[some], ids[root[some]], near[some].sum(axis=1).astype(float)]

    def solve(t: pa.Table, starts: np.ndarray, ends: np.ndarray) -> pa.RecordBatch | None:
        ids, size = t.column("id").to_numpy(), t.column("size").to_numpy().astype(float)
        host, side, split = (t.column(x).to_numpy(zero_copy_only=False) for x in ("host", "side", "split"))
        sets = [s for chunk in t.column("grams").chunks for s in np.split(chunk.values.to_numpy(), chunk.offsets.to_numpy())[1:-1]]
        found = [block(*(x[a:b] for x in (ids, size, host, side, split, sets))) for a, b in zip(starts.tolist(), ends.tolist(), strict=True) if b - a > 1]
        columns = [np.concatenate(x) for x in zip(*found, strict=True)]
        return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["u", "v", "x"]) if found and len(columns[0]) else None

    return runs(solve)


def _compared(sets: DataFrame, similarity: float, pairs: bool) -> tuple[DataFrame, DataFrame]:
    sets = numbered(sets)
    texts = ordered(sets, similarity)
    families = components(links(texts, similarity))
    members = classed(texts.join(families, F.col("id") == F.col("node")).select("label", "text_type", "id", "size", "k")).withColumn("met", F.xxhash64("label", "text_type", "c"))
    # sets only move to where a text of the class is met by another one
    live = members.groupBy("met").agg(F.count("*").alias("n"), F.max("host").alias("hosts")).where("n > 1 and hosts").select("met")
    rows = materialise(members.join(live, "met", "left_semi").drop("met"), "members")
    places = placed(rows, ["label", "text_type", "c"], FAMILY_BLOCK).select("place", "id", "size", "host", "side", "split")
    blocks = gathered(places.join(sets.select("id", "grams"), "id").select("place", "id", "size", "host", "side", "split", "grams"))
    return texts, materialise(blocks.mapInArrow(_verify(similarity, pairs), "u long, v long, x double"), "found")


def near_pairs(sets: DataFrame, similarity: float = 0.9) -> DataFrame:
    """(text_type, left, right, jaccard) of the distinct texts at or above the similarity, left before right."""
    texts, found = _compared(sets, similarity, True)
    names = texts.select("id", "text_type", "h")
    a, b = (names.toDF(f"id_{s}", f"type_{s}", f"h_{s}") for s in "ab")
    both = found.join(a, F.col("u") == F.col("id_a")).join(b, F.col("v") == F.col("id_b"))
    return both.select(F.col("type_a").alias("text_type"), F.least("h_a", "h_b").alias("left"), F.greatest("h_a", "h_b").alias("right"), F.col("x").alias("jaccard"))


def near_classes(sets: DataFrame, similarity: float = 0.9) -> DataFrame:
    """(text_type, h, class_h, links) of every text of ``sets``: the smallest h of its class, and its near texts."""
    texts, found = _compared(sets, similarity, False)
    classes = components(found.select("u", "v"))
    linked = found.groupBy(F.col("u").alias("id")).agg(F.sum("x").cast("long").alias("links")).join(classes, F.col("id") == F.col("node")).join(texts.select(F.col("id").alias("text_id"), "text_type", "h"), F.col("id") == F.col("text_id"))
    first = linked.groupBy("label").agg(F.min("h").alias("class_h"))
    rows = linked.join(first, "label").select(F.col("text_type").alias("t"), F.col("h").alias("l_h"), "class_h", "links")
    joined = sets.select("text_type", "h").join(rows, (F.col("text_type") == F.col("t")) & (F.col("h") == F.col("l_h")), "left")
    return joined.select("text_type", "h", F.coalesce("class_h", "h").alias("class_h"), F.coalesce("links", F.lit(0).cast("long")).alias("links"))
