"""Near-duplicate join on word n-grams: MinHash bands for candidates, full n-gram sets for the verdict.

Method. Words are maximal runs of letters and digits, lower-cased; a text's set holds the hashes of its runs of five
words. Texts with equal word sequences are one node, so copies cost one row each. A node's MinHash signature is cut
into bands; rows and bands follow from the similarity threshold and the recall wanted there. Nodes are shuffled on band
hashes. Inside a bucket a spanning forest of the pairs whose signatures agree well enough is kept, never all pairs; the
forests' components are small families of look-alikes. Each family is then verified: its full n-gram sets meet block by
block, every pair inside is counted exactly, and links at or above the threshold give link counts and final classes.

Buckets and families beyond one block are split into blocks and each pair of blocks is a task of its own, so nothing
is capped and no task holds an unbounded group.

Recall: a pair at the threshold shares a band with probability 1-(1-s^r)^b, and its signatures agree at the candidate
level except with probability below 1e-5; pairs above it are safer still.

Defined cases. Null and empty texts: a class of their own each, no links. Texts under five words: joined to equal word
sequences only. Null doc_id: takes part; a class's id is its smallest non-null doc_id (null if it has none). Repeated
rows: same class. Very long texts: their whole set takes part. An empty table gives an empty table. Other columns,
whatever their names, are ignored by the report and kept by ``deduplicate``.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyforge.llm.common import WordHasher, ascii_nonword_separators, boxed, grouped, materialise, one_thread, unboxed
from tallyforge.llm.graph import blocked, components

WORDS = 5
SIMILARITY = 0.8
RECALL = 0.99995
BUCKET_BLOCK = 4096
FAMILY_BLOCK = 512

_u64 = np.uint64


def choose_bands(similarity: float, recall: float, rows: int = 4) -> tuple[int, int]:
    """(bands, rows): the fewest bands of ``rows`` values that catch a pair at the threshold with the wanted recall."""
    return math.ceil(math.log(1 - recall) / math.log(1 - similarity**rows)), rows


def shingles(hasher: WordHasher, text: str | None, words: int) -> tuple[np.ndarray, np.ndarray]:
    """Word hashes and n-gram hashes of a text."""
    h = hasher.words(text.lower().encode("utf-8", "surrogatepass"))[2] if text else np.zeros(0, _u64)
    return h, fold(h, words)


def fold(h: np.ndarray, words: int, seed: int = 0x9FB21C651E98DF25) -> np.ndarray:
    size = max(0, len(h) - words + 1)
    acc = np.full(size, _u64(words))
    with np.errstate(over="ignore"):
        for i in range(words):
            acc = (acc ^ h[i : i + size]) * _u64(seed)
            acc ^= acc >> _u64(29)
    return acc


def _fingerprint(h: np.ndarray) -> int:
    """63-bit fingerprint of a whole word sequence."""
    with np.errstate(over="ignore"):
        place = np.arange(1, len(h) + 1, dtype=_u64) * _u64(0xC2B2AE3D27D4EB4F)
        mixed = (h ^ (place ^ (place >> _u64(31)))) * _u64(0x9E3779B185EBCA87)
        total = _u64(len(h)) * _u64(0x165667B19E3779F9) + np.sum(mixed ^ (mixed >> _u64(32)), dtype=_u64)
        total = (total ^ (total >> _u64(33))) * _u64(0xFF51AFD7ED558CCD)
    return int(total >> _u64(1))


def _sketch(words: int, bands: int, rows: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rng = np.random.default_rng(12345)
        k = bands * rows
        xors = rng.integers(0, 1 << 32, k, dtype=np.uint32)[:, None]
        mults = (rng.integers(0, 1 << 32, k, dtype=np.uint32) | np.uint32(1))[:, None]
        lanes = rng.integers(1, 1 << 63, (bands, rows), dtype=np.uint64) | _u64(1)
        hasher = WordHasher(ascii_nonword_separators())
        for batch in batches:
            known: dict[int, tuple] = {}
            nodes, keys, sigs = [], [], []
            for row, text in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                h, grams = shingles(hasher, text, words)
                if not len(h):
                    nodes.append(-1 - (row & (2**62 - 1)))
                    keys.append([])
                    sigs.append(b"")
                    continue
                node = _fingerprint(h)
                if node not in known:
                    if len(grams):
                        x = (grams >> _u64(32)).astype(np.uint32)
                        least = np.full(k, 0xFFFFFFFF, np.uint32)
                        for at in range(0, len(x), 4096):
                            part = (x[None, at : at + 4096] ^ xors) * mults
                            least = np.minimum(least, (part ^ (part >> np.uint32(15))).min(axis=1))
                        with np.errstate(over="ignore"):
                            band = (least.reshape(bands, rows).astype(_u64) * lanes).sum(axis=1, dtype=_u64)
                            band = (band ^ (band >> _u64(31))) * _u64(0x9E3779B97F4A7C15)
                        known[node] = (band.view(np.int64).tolist(), (least & np.uint32(255)).astype(np.uint8).tobytes())
                    else:
                        known[node] = ([], b"")
                nodes.append(node)
                keys.append(known[node][0])
                sigs.append(known[node][1])
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(nodes, pa.int64()), pa.array(keys, pa.list_(pa.int64())), pa.array(sigs, pa.binary())], ["doc", "row", "node", "bands", "sig"])

    return run


def forest(sig: np.ndarray, least: int) -> np.ndarray:
    """For each row of ``sig`` the root of its tree in the graph of rows that agree in ``least`` places or more."""
    n = len(sig)
    root = np.full(n, -1)
    todo = np.arange(n)
    while len(todo):
        first = todo[0]
        root[first] = first
        queue, todo = [first], todo[1:]
        while queue and len(todo):
            p = queue.pop()
            near = (sig[todo] == sig[p]).sum(axis=1) >= least
            if near.any():
                joined = todo[near]
                root[joined] = first
                queue.extend(joined.tolist())
                todo = todo[~near]
    return root


def _links(least: int):
    def solve(group: pa.Table):
        nodes = group.column("node").to_numpy()
        _, first = np.unique(nodes, return_index=True)
        if len(first) < 2:
            return
        sig = np.stack([np.frombuffer(s, np.uint8) for s in np.array(group.column("sig").to_pylist(), object)[first]])
        nodes = nodes[first]
        root = nodes[forest(sig, least)]
        far = root != nodes
        if far.any():
            yield pa.RecordBatch.from_arrays([pa.array(nodes[far]), pa.array(root[far])], ["u", "v"])

    return grouped(3, solve)


def _sets(words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = WordHasher(ascii_nonword_separators())
        for batch in batches:
            grams = [np.unique(shingles(hasher, t, words)[1]).tobytes() for t in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(grams, pa.binary())], ["family", "node", "grams"])

    return run


def overlaps(sets: list[np.ndarray], cells: int = 1 << 23) -> np.ndarray:
    """Sizes of the intersections of every two sets, by slabs of n-grams that at least two sets hold."""
    n = len(sets)
    owner = np.repeat(np.arange(n), [len(s) for s in sets])
    grams, inverse, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    rank = np.cumsum(count > 1) - 1
    shared = count[inverse] > 1
    owner, column = owner[shared], rank[inverse[shared]]
    total = np.zeros((n, n))
    width = max(1, cells // n)
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], column[order]
    top = int(column[-1]) + 1 if len(column) else 0
    for at in range(0, top, width):
        a, b = np.searchsorted(column, [at, at + width])
        m = np.zeros((n, min(width, top - at)), np.float32)
        m[owner[a:b], column[a:b] - at] = 1
        total += m @ m.T
    return total


def _verify(similarity: float):
    def solve(group: pa.Table):
        one_thread()
        nodes = group.column("node").to_numpy()
        _, first = np.unique(nodes, return_index=True)
        nodes = nodes[first]
        side = group.column("side").to_numpy()[first]
        raw = group.column("grams").to_pylist()
        sets = [np.frombuffer(raw[i], _u64) for i in first.tolist()]
        sizes = np.array([len(s) for s in sets], float)
        both = overlaps(sets)
        union = sizes[:, None] + sizes[None, :] - both
        near = (both >= similarity * union - 1e-9) & (union > 0)
        np.fill_diagonal(near, False)
        if group.column("bi")[0].as_py() != group.column("bj")[0].as_py():
            near &= side[:, None] != side[None, :]
        links = near.sum(axis=1)
        root = np.full(len(nodes), -1)
        for i in range(len(nodes)):
            if root[i] < 0:
                root[i] = i
                queue = [i]
                while queue:
                    more = np.flatnonzero(near[queue.pop()] & (root < 0))
                    root[more] = i
                    queue.extend(more.tolist())
        yield pa.RecordBatch.from_arrays([pa.array(nodes), pa.array(links.astype(np.int64)), pa.array(nodes[root])], ["node", "links", "root"])

    return grouped(3, solve)


def near_classes(docs: DataFrame, words: int = WORDS, similarity: float = SIMILARITY, recall: float = RECALL) -> DataFrame:
    """One row per row of ``docs``: doc_id, row (hash of id and text), label of its class, class_id, n_copies and n_links.

    n_copies counts the documents with this word sequence, itself included; n_links the different word sequences whose
    n-gram sets are at least ``similarity`` alike.
    """
    bands, rows = choose_bands(similarity, recall)
    base = docs.select(F.col("doc_id").alias("doc"), "text").select("doc", F.xxhash64("doc", "text").alias("row"), "text")
    sketches = materialise(base.mapInArrow(_sketch(words, bands, rows), "doc long, row long, node long, bands array<long>, sig binary"), "sketches")
    nodes = sketches.groupBy("node").agg(F.min("doc").alias("least"), F.count("*").alias("copies"), F.min("row").alias("row"), F.min("sig").alias("sig"), F.min("bands").alias("bands"))
    nodes = materialise(nodes, "nodes")
    k = bands * rows
    agree = max(1, math.floor(k * similarity - 4.5 * math.sqrt(k * similarity * (1 - similarity))))
    keyed = nodes.where("size(bands) > 0").select("node", "sig", F.posexplode("bands").alias("band", "value")).select(F.xxhash64("band", "value").alias("key"), "node", "sig")
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def dealt(df, key):
        return df.repartition(parts, *key).sortWithinPartitions(*key)

    met = blocked(keyed, ["key"], "node", BUCKET_BLOCK).select("key", "bi", "bj", "node", "sig")
    alike = components(dealt(met, ["key", "bi", "bj"]).mapInArrow(_links(agree), "u long, v long"))
    families = alike.select("node", F.col("label").alias("family")).join(nodes.select("node", "row"), "node")
    sets = base.join(families, "row").select("family", "node", "text").mapInArrow(_sets(words), "family long, node long, grams binary")
    sets = materialise(sets, "sets")
    blocks = blocked(sets, ["family"], "node", FAMILY_BLOCK).select("family", "bi", "bj", "node", "side", "grams")
    found = materialise(dealt(blocks, ["family", "bi", "bj"]).mapInArrow(_verify(similarity), "node long, links long, root long"), "links")
    links = found.groupBy("node").agg(F.sum("links").alias("links"))
    joined = components(found.select(F.col("node").alias("u"), F.col("root").alias("v")))
    labelled = nodes.select("node", "least", "copies").join(joined, "node", "left").withColumn("label", F.coalesce("label", "node")).join(links, "node", "left")
    ids = labelled.groupBy("label").agg(F.min("least").alias("class_id"))
    info = labelled.join(ids, "label").select("node", "label", "class_id", F.col("copies").alias("n_copies"), F.coalesce("links", F.lit(0)).alias("n_links"))
    return sketches.select("doc", "row", "node").join(info, "node").select(F.col("doc").alias("doc_id"), "row", "label", "class_id", "n_copies", "n_links")


def near_report(docs: DataFrame) -> DataFrame:
    return near_classes(docs).drop("row", "label")


def deduplicate(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that stay, one of each class: that with the smallest doc_id (null last), equal rows once."""
    rows = boxed(docs, "doc_id", "text")
    first = near_classes(rows).groupBy("label").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row")).alias("first"))
    marked = rows.withColumn("tf_row", F.xxhash64("doc_id", "text"))
    kept = marked.join(first.select(F.col("first.row").alias("tf_row")), "tf_row", "left_semi").dropDuplicates(["tf_row"])
    return unboxed(kept.drop("tf_row"), docs)


ORACLE = f"""
WITH RECURSIVE s AS MATERIALIZED (
  SELECT doc_id, regexp_extract_all(lower(coalesce(text, '')), '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+') AS w FROM documents
), t AS MATERIALIZED (
  SELECT doc_id, CASE WHEN len(w) > 0 THEN md5(array_to_string(w, ' ')) END AS k, w FROM s
), n AS MATERIALIZED (
  SELECT k, any_value(w) AS w, min(doc_id) AS least, count(*) AS copies FROM t WHERE k IS NOT NULL GROUP BY k
), g AS MATERIALIZED (
  SELECT DISTINCT k, md5(array_to_string(w[i:i + {WORDS - 1}], ' ')) AS g FROM (SELECT k, w, unnest(generate_series(1, len(w) - {WORDS - 1})) AS i FROM n WHERE len(w) >= {WORDS})
), z AS (
  SELECT k, count(*) AS size FROM g GROUP BY k
), p AS MATERIALIZED (
  SELECT c.a, c.b FROM (SELECT x.k AS a, y.k AS b, count(*) AS shared FROM g x JOIN g y ON x.g = y.g AND x.k <> y.k GROUP BY ALL) c JOIN z za ON za.k = c.a JOIN z zb ON zb.k = c.b
  WHERE shared >= {SIMILARITY} * (za.size + zb.size - shared) - 1e-9
), r AS (
  SELECT k, k AS other FROM n UNION SELECT r.k, p.b FROM r JOIN p ON p.a = r.other
), c AS (
  SELECT r.k, min(n.least) AS class_id FROM r JOIN n ON n.k = r.other GROUP BY r.k
), l AS (
  SELECT a AS k, count(*) AS links FROM p GROUP BY a
)
SELECT t.doc_id, CASE WHEN t.k IS NULL THEN t.doc_id ELSE c.class_id END AS class_id, coalesce(n.copies, 1) AS n_copies, coalesce(l.links, 0) AS n_links
FROM t LEFT JOIN n ON n.k = t.k LEFT JOIN c ON c.k = t.k LEFT JOIN l ON l.k = t.k
"""
