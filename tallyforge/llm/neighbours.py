"""Nearest neighbours by inner product over a hierarchical k-means tree, searched best bin first.

Method. A tree of k-means cells is fitted on a bounded sample of the vectors; the cells are as small as the table wants,
as far as the sample goes. Every vector is indexed under its leaf. A query walks the tree with a priority queue ordered by
an estimate of the largest inner product inside a cell: the centre's product plus a part of the query's length times the
cell's radius (all of it would be an upper bound), so leaves come best first. How many leaves a query visits is calibrated
on sample queries that are not their own neighbours: visits widen one by one until recall against brute force reaches the
target; the part of the radius is the one that needs the fewest. How much that prunes depends on the vectors: of vectors
without any clusters in many dimensions, most leaves must be visited.

Leaves that follow each other in the tree form blocks of bounded size, a larger leaf several blocks. A query is sent once
to each block it visits, with the leaves it visits there; one task multiplies the queries of a leaf with its vectors, in
double precision, and the best of each query are merged.

Equal vectors are one vector with its smallest ids: a search for k needs no more than k + 1 ids of the same vector, and
a row number limits them before the shuffle, so a vector that a third of all rows share is no hot spot. Equal queries
are searched once.

Bounds: about FIT_ROWS vectors fit the tree, CALIBRATE_ROWS of them ask for the calibration.

Defined cases. Vectors that are null, zero, or hold a null or a non-finite component take no part, nor do rows with a
null id. Vectors are compared with those of their own length. Fewer candidates than k: all of them. Ties: the smaller
vec_id first. Repeated rows of one id and vector count once. An empty table gives an empty table. Other columns are
ignored, whatever their names.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import FloatType

from tallyforge.llm.common import grouped, materialise, one_thread

K = 20
QUERY_EVERY = 20
FIT_ROWS = 65_536
CALIBRATE_ROWS = 256
RECALL = 0.94
BRANCH = 8
#: Vectors of the table that a leaf should hold, and of the sample that it must.
CELL, LEAF = 256, 16
#: Parts of a cell's radius that the calibration tries.
PARTS = (0.0, 0.1, 0.2, 0.35, 0.5)
BLOCK, ASKING = 4096, 8192
SALTS = 8


class Tree:
    """Cells of a hierarchical k-means: centre, radius and children; leaves are numbered."""

    def __init__(self, x: np.ndarray, branch: int = BRANCH, leaf: int = CELL, seed: int = 7):
        self.part = 0.35
        self.centre, self.radius, self.children, self.leaf = [], [], [], []
        self.leaves = 0
        rng = np.random.default_rng(seed)

        def grow(rows: np.ndarray) -> int:
            me = len(self.centre)
            c = x[rows].mean(axis=0)
            self.centre.append(c)
            self.radius.append(float(np.sqrt(((x[rows] - c) ** 2).sum(axis=1).max())))
            self.children.append([])
            self.leaf.append(-1)
            if len(rows) > max(leaf, branch):
                centres = x[rng.choice(rows, branch, replace=False)].copy()
                for _ in range(8):
                    own = self._nearest(x[rows], centres)
                    for j in range(branch):
                        if (own == j).any():
                            centres[j] = x[rows[own == j]].mean(axis=0)
                own = self._nearest(x[rows], centres)
                parts = [rows[own == j] for j in range(branch) if (own == j).any()]
                if len(parts) > 1:
                    self.children[me] = [grow(p) for p in parts]
                    return me
            self.leaf[me] = self.leaves
            self.leaves += 1
            return me

        grow(np.arange(len(x)))
        self.centre = np.array(self.centre)
        self.radius = np.array(self.radius)

    @staticmethod
    def _nearest(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
        return np.argmin((centres**2).sum(axis=1)[None, :] - 2 * (x @ centres.T), axis=1)

    def assign(self, x: np.ndarray) -> np.ndarray:
        """The leaf of each row."""
        out = np.zeros(len(x), np.int32)
        stack = [(0, np.arange(len(x)))]
        while stack:
            node, rows = stack.pop()
            if not self.children[node]:
                out[rows] = self.leaf[node]
                continue
            kids = np.array(self.children[node])
            own = self._nearest(x[rows], self.centre[kids])
            stack += [(int(k), rows[own == j]) for j, k in enumerate(kids) if (own == j).any()]
        return out

    def order(self, q: np.ndarray, visits: int) -> list[int]:
        """The first ``visits`` leaves for query q, best estimate first."""
        length = float(np.sqrt(q @ q))
        bound = (self.centre @ q + length * self.radius * self.part).tolist()
        queue, out = [(-bound[0], 0)], []
        while queue and len(out) < visits:
            _, node = heapq.heappop(queue)
            if self.children[node]:
                for k in self.children[node]:
                    heapq.heappush(queue, (-bound[k], k))
            else:
                out.append(self.leaf[node])
        return out


def _top(scores: np.ndarray, k: int) -> np.ndarray:
    return np.argpartition(-scores, min(k, scores.shape[1]) - 1, axis=1)[:, :k] if scores.shape[1] > k else np.argsort(-scores, axis=1)


def calibrate(tree: Tree, sample: np.ndarray, asking: np.ndarray, k: int, target: float) -> int:
    """The fewest leaves to visit for this recall, for queries that are rows ``asking`` of the sample; sets ``tree.part``."""
    if tree.leaves == 1 or len(sample) <= 1:
        return tree.leaves
    queries, own = sample[asking], tree.assign(sample)
    scores = queries @ sample.T
    scores[np.arange(len(asking)), asking] = -np.inf
    best = _top(scores, min(k, len(sample) - 1))
    found = {}
    for part in PARTS:
        tree.part, need = part, []
        for i, q in enumerate(queries):
            rank = np.empty(tree.leaves, np.int64)
            rank[tree.order(q, tree.leaves)] = np.arange(tree.leaves)
            need.append(rank[own[best[i]]])
        need = np.sort(np.concatenate(need))
        found[part] = int(need[min(len(need), int(np.ceil(target * len(need)))) - 1]) + 1
    tree.part = min(found, key=lambda p: (found[p], p))
    return found[tree.part]


def usable(rows: DataFrame, id_column: str, vector_column: str) -> DataFrame:
    """(id, v) of the rows that take part; components stay floats where they are floats, and are doubles otherwise."""
    column = rows.select(vector_column).schema[0].dataType
    kind = "float" if isinstance(column.elementType, FloatType) else "double"
    v = F.transform(F.col(vector_column), lambda x: x.cast(kind))
    kept = rows.select(F.col(id_column).cast("long").alias("id"), v.alias("v")).where(F.col("id").isNotNull() & F.col("v").isNotNull())
    good = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))) & F.exists("v", lambda x: x != 0)
    return kept.where(F.coalesce(good, F.lit(False)))


def _matrix(column: pa.Array | pa.ChunkedArray, dim: int) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)


def nearest(rows: DataFrame, k: int = K, every: int = QUERY_EVERY, id_column: str = "vec_id", vector_column: str = "embedding", recall: float = RECALL) -> DataFrame:
    """For each id divisible by ``every``: query_id, rank from 1, vec_id and score of its nearest rows."""
    points = usable(rows, id_column, vector_column)
    by_vector = Window.partitionBy("v").orderBy("id")
    first = points.distinct().withColumn("n", F.row_number().over(by_vector)).where(F.col("n") <= k + 1)
    vectors = materialise(first.groupBy("v").agg(F.array_sort(F.collect_list("id")).alias("ids")).withColumn("vid", F.col("ids")[0]), "vectors")
    asked = materialise(points.where(F.col("id") % every == 0).distinct(), "asked")
    sizes = vectors.groupBy(F.size("v").alias("dim")).count().orderBy("dim").collect()
    best = None
    for r in sizes:  # one length as a rule
        part = search(vectors.where(F.size("v") == r["dim"]), asked.where(F.size("v") == r["dim"]), r["count"], r["dim"], k, recall)
        best = part if best is None else best.union(part)
    if best is None:
        return rows.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    opened = best.join(vectors.select("vid", "ids"), "vid").select("qid", "score", F.explode("ids").alias("vec_id"))
    opened = opened.withColumn("n", F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("score"), "vec_id"))).where(F.col("n") <= k + 1)
    answers = opened.groupBy("qid").agg(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("s"), "vec_id"))).alias("best"))
    # every row that asks gets its own list: without itself, cut to k
    answers = answers.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    salted = asked.withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(SALTS)).cast("int"))
    names = asked.groupBy("v").agg(F.min("id").alias("qid")).withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    members = salted.join(names, ["v", "salt"]).select(F.col("id").alias("query_id"), "qid", "salt")
    lists = members.join(answers, ["qid", "salt"]).select("query_id", F.posexplode(F.slice(F.filter("best", lambda b: b["vec_id"] != F.col("query_id")), 1, k)).alias("at", "b"))
    return lists.select("query_id", (F.col("at") + 1).cast("int").alias("rank"), F.col("b.vec_id").alias("vec_id"), (-F.col("b.s")).alias("score"))


def search(vectors: DataFrame, asked: DataFrame, count: int, dim: int, k: int, recall: float) -> DataFrame:
    """(qid, vid, score): the k + 1 best of ``vectors`` (vid, v) for each vector of ``asked`` (id, v), named by its smallest id."""
    spark = vectors.sparkSession
    share = min(1.0, FIT_ROWS / count)
    sample = vectors.where(F.pmod(F.xxhash64("vid", F.lit(3)), F.lit(1 << 20)) < int(np.ceil(share * (1 << 20)))).select("vid", "v").toArrow()
    order = np.argsort(sample.column("vid").to_numpy(), kind="stable")
    x = _matrix(sample.column("v"), dim)[order]
    if not len(x):
        x = np.zeros((1, dim))
    tree = Tree(x, leaf=int(max(LEAF, CELL * len(x) / count)))
    visits = calibrate(tree, x, np.random.default_rng(5).permutation(len(x))[:CALIBRATE_ROWS], k, recall)
    shared = spark.sparkContext.broadcast(tree)
    kind = vectors.schema["v"].dataType.simpleString()

    def to_leaves(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            leaf = shared.value.assign(_matrix(batch.column(1), dim)) if batch.num_rows else np.zeros(0, np.int32)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(leaf, pa.int32())], ["vid", "v", "leaf"])

    indexed = materialise(vectors.select("vid", "v").mapInArrow(to_leaves, f"vid long, v {kind}, leaf int"), "index")
    held = np.zeros(tree.leaves, np.int64)
    for r in indexed.groupBy("leaf").count().collect():  # a row for each leaf
        held[r["leaf"]] = r["count"]
    # leaves in order fill blocks; a leaf of more than a block starts one of its own and goes on in the next
    start, parts, block, room = np.zeros(tree.leaves, np.int64), np.ones(tree.leaves, np.int64), 0, BLOCK
    for i, n in enumerate(held.tolist()):
        if n > room and room < BLOCK:
            block, room = block + 1, BLOCK
        start[i], parts[i] = block, max(1, -(-n // BLOCK))
        if n > BLOCK:
            block, room = block + int(parts[i]), BLOCK
        else:
            room -= n
    plan = spark.sparkContext.broadcast((start, parts, held))

    def to_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, several, _ = plan.value
        for batch in batches:
            leaf = batch.column(2).to_numpy()
            spread = (batch.column(0).to_numpy().astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(40)
            at = first[leaf] + (spread % several[leaf].astype(np.uint64)).astype(np.int64)
            edges = pa.array(np.arange(len(leaf) + 1), pa.int32())
            yield pa.RecordBatch.from_arrays([pa.array(at), batch.column(0), batch.column(1), pa.ListArray.from_arrays(edges, pa.array(leaf, pa.int32()))], ["block", "id", "v", "leaves"])

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, several, size = plan.value
        for batch in batches:
            which, where, leaves = [], [], []
            for i, q in enumerate(_matrix(batch.column(1), dim) if batch.num_rows else ()):
                mine: dict[int, list[int]] = {}
                for leaf in shared.value.order(q, visits):
                    for j in range(int(several[leaf]) if size[leaf] else 0):
                        mine.setdefault(int(first[leaf]) + j, []).append(leaf)
                which += [i] * len(mine)
                where += mine.keys()
                leaves += mine.values()
            which = pa.array(which, pa.int32())
            yield pa.RecordBatch.from_arrays([pa.array(where, pa.int64()), batch.column(0).take(which), batch.column(1).take(which), pa.array(leaves, pa.list_(pa.int32()))], ["block", "id", "v", "leaves"])

    sent = f"block long, id long, v {kind}, leaves array<int>"
    asks = materialise(asked.groupBy("v").agg(F.min("id").alias("qid")).select("qid", "v").mapInArrow(ask, sent), "asks")
    # a block that very many ask is dealt out with all its vectors to several tasks
    groups = asks.groupBy("block").agg(F.ceil(F.count("*") / ASKING).cast("int").alias("groups"))
    left = indexed.select("vid", "v", "leaf").mapInArrow(to_blocks, sent).join(groups, "block").select("block", F.explode(F.sequence(F.lit(0), F.col("groups") - 1)).alias("b"), F.lit(0).alias("kind"), "id", "v", "leaves")
    right = asks.join(groups, "block").select("block", F.pmod(F.xxhash64("id"), F.col("groups")).cast("int").alias("b"), F.lit(1).alias("kind"), "id", "v", "leaves")
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    met = left.union(right).repartition(tasks, "block", "b").sortWithinPartitions("block", "b", "kind")

    def solve(group: pa.Table):
        one_thread()
        side = group.column("kind").to_numpy()
        ids = group.column("id").to_numpy()
        v = _matrix(group.column("v"), dim)
        lists = group.column("leaves").combine_chunks()
        asking = np.flatnonzero(side == 1)
        own = np.flatnonzero(side == 0)
        if not len(own) or not len(asking):
            return
        leaf = lists.take(pa.array(own)).flatten().to_numpy()
        own, leaf = own[np.argsort(leaf, kind="stable")], np.sort(leaf, kind="stable")
        names, begin = np.unique(leaf, return_index=True)
        end = np.append(begin[1:], len(leaf))
        wanted = lists.take(pa.array(asking))
        visit = np.zeros((len(asking), len(names)), bool)
        rows_ = np.repeat(np.arange(len(asking)), wanted.value_lengths().to_numpy())
        flat = wanted.flatten().to_numpy()
        at = np.minimum(np.searchsorted(names, flat), len(names) - 1)
        good = names[at] == flat
        visit[rows_[good], at[good]] = True
        cand = v[own]
        # a product's rounding grows with both norms: what lies so near the edge may be a tie
        slack = 4 * dim * np.finfo(float).eps * np.linalg.norm(cand, axis=1).max()
        for i in range(0, len(asking), 512):
            q, looks = v[asking[i : i + 512]], visit[i : i + 512]
            scores = np.full((len(q), len(own)), -np.inf)
            for n, (a, b) in enumerate(zip(begin.tolist(), end.tolist(), strict=True)):
                who = np.flatnonzero(looks[:, n])
                if len(who):
                    scores[who, a:b] = q[who] @ cand[a:b].T
            n = min(k + 1, scores.shape[1])
            # ties at the edge stay, all of them: the least id among them is settled after the merge
            edge = -np.partition(-scores, n - 1, axis=1)[:, n - 1]
            near = edge - slack * np.linalg.norm(q, axis=1)
            who, which = np.nonzero((scores >= near[:, None]) & (scores > -np.inf))
            exact = np.einsum("ij,ij->i", q[who], cand[which])
            yield pa.RecordBatch.from_arrays([pa.array(ids[asking[i + who]]), pa.array(ids[own[which]]), pa.array(exact)], ["qid", "vid", "score"])

    found = met.mapInArrow(grouped(2, solve), "qid long, vid long, score double")
    return found.withColumn("n", F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("score"), "vid"))).where(F.col("n") <= k + 1).drop("n")
