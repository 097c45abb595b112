"""Removal of repeated passages: windows of 13 words that also start in a document with a smaller id.

Method. Consecutive windows that share a minimiser (the smallest hash of the ``order`` -word runs inside a window) form
one super-k-mer. It travels as one string, with the places where it stands, to the bucket of its minimiser; equal
windows have equal minimisers, so they meet in one bucket. A first pass adds up what every slot of minimisers will hold,
over all documents, and buckets are made of slots so that none holds more than ``CAPACITY`` bytes of strings. A slot that
alone holds more (a pair of words that stands in very many windows) is split: its super-k-mers are cut again by the
minimisers of longer runs, and dealt to as many buckets as it needs. A map task packs a string once however often it
stands there, and sends one compressed blob to each bucket. A bucket merges equal strings first, sorts the hashes of the windows of
what is left, compares the words themselves wherever hashes agree, and so knows the smallest document of each window
exactly. Places of windows that a smaller document also starts go back to their document, where the words they cover
are taken out.

A group of thousands of copies is one string per task with a list of places, so its cost does not grow with the pairs.

Defined cases. Null text: no words. A text of fewer than 13 words has no window and is left as it is. Null doc_id:
counts as larger than every id. Rows that repeat an id do not remove from each other; equal rows are treated alike.
Very long texts are packed whole. An empty table gives an empty table. Other columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyforge.llm.common import WordHasher, whitespace_separators

WINDOW = 13
#: Words of the runs that make minimisers, and of those that cut the super-k-mers of a slot that is split.
ORDER, FINER = 2, 7
SLOT_BITS = 14
#: Bytes of strings that a bucket may hold, as far as its windows differ.
CAPACITY = 64 << 20
#: Bytes of packed strings after which a task sends what it holds.
FLUSH = 96 << 20
NULL_ID = 2**63 - 1

_u64 = np.uint64


def _sliding_min(h: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each run of ``width`` values."""
    done, out = 1, h
    while done < width:
        step = min(done, width - done)
        out = np.minimum(out[:-step], out[step:])
        done += step
    return out


def _run_hash(h: np.ndarray, n: int) -> np.ndarray:
    """Hash of each run of n word hashes; order counts."""
    size = len(h) - n + 1
    acc = np.zeros(max(size, 0), _u64)
    with np.errstate(over="ignore"):
        for i in range(n):
            acc = (acc ^ h[i : i + size]) * _u64(0x9FB21C651E98DF25)
            acc ^= acc >> _u64(32)
    return acc


class Plan:
    """The buckets of each slot: the first, and how many it is split over."""

    def __init__(self, loads: np.ndarray, capacity: int):
        self.parts = np.maximum(1, -(-loads // capacity)).astype(np.int64)
        self.parts[self.parts > 1] *= 2  # finer cuts repeat more words
        self.base, bucket, room = np.zeros(len(loads), np.int64), 0, capacity
        for slot, (load, parts) in enumerate(zip(loads.tolist(), self.parts.tolist(), strict=True)):
            if load > room and room < capacity:
                bucket, room = bucket + 1, capacity
            self.base[slot] = bucket
            if parts > 1:
                bucket, room = bucket + parts, capacity
            else:
                room -= load
        self.buckets = bucket + 1


def _slots(least: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return ((least * _u64(0xD6E8FEB86659FD93)) >> _u64(64 - SLOT_BITS)).astype(np.int64)


def super_kmers(h: np.ndarray, window: int, order: int, plan: Plan | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first window, last window, slot, or with a plan bucket) of each maximal run of windows that belong together."""
    if len(h) < window:
        z = np.zeros(0, np.int64)
        return z, z, z
    least = _sliding_min(_run_hash(h, order), window - order + 1)
    slot = _slots(least)
    change = least[1:] != least[:-1]
    if plan is not None:
        where, parts = plan.base[slot], plan.parts[slot]
        split = parts > 1
        if split.any():
            finer = min(FINER, window)
            finest = _sliding_min(_run_hash(h, finer), window - finer + 1)
            change = change | (split[1:] & (finest[1:] != finest[:-1]))
            with np.errstate(over="ignore"):
                spread = ((finest * _u64(0xA0761D6478BD642F)) >> _u64(32)) % parts.astype(_u64)
            where = where + np.where(split, spread.astype(np.int64), 0)
        slot = where
    cut = np.flatnonzero(change) + 1
    first = np.concatenate([[0], cut])
    return first, np.concatenate([cut - 1, [len(least) - 1]]), slot[first]


def _surveying(window: int, order: int):
    """Arrow batches of (text) to one row of bytes to come for each slot that occurs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = WordHasher(whitespace_separators())
        loads = np.zeros(1 << SLOT_BITS, np.int64)
        for batch in batches:
            for text in batch.column(0).to_pylist():
                starts, ends, h = hasher.words(text.encode("utf-8", "surrogatepass") if text else b"")
                first, last, slot = super_kmers(h, window, order)
                if len(first):
                    loads += np.bincount(slot, ends[last + window - 1] - starts[first], 1 << SLOT_BITS).astype(np.int64)
        used = np.flatnonzero(loads)
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int32()), pa.array(loads[used])], ["slot", "load"])

    return run


def _packer(window: int, order: int, plan: Plan):
    """Arrow batches of (k, row, text) to rows of (bucket, blob)."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = WordHasher(whitespace_separators())
        held: dict[int, dict[bytes, list[int]]] = {}
        size = 0
        squeeze = zstandard.ZstdCompressor(level=5)

        def flush():
            keys, blobs = [], []
            for bucket, strings in held.items():
                lengths = np.fromiter(map(len, strings), np.int64, len(strings))
                counts = np.fromiter((len(p) // 3 for p in strings.values()), np.int64, len(strings))
                places = np.fromiter((x for p in strings.values() for x in p), np.int64, int(counts.sum()) * 3).reshape(-1, 3)
                raw = b"".join([np.int64(len(strings)).tobytes(), lengths.astype(np.int32).tobytes(), counts.astype(np.int32).tobytes(), np.ascontiguousarray(places.T).tobytes(), *strings])
                keys.append(bucket)
                blobs.append(squeeze.compress(raw))
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(blobs, pa.binary())], ["bucket", "blob"])

        for batch in batches:
            for doc, row, text in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                data = text.encode("utf-8", "surrogatepass") if text else b""
                starts, ends, h = hasher.words(data)
                first, last, where = super_kmers(h, window, order, plan)
                if not len(first):
                    continue
                for a, b, w, bucket in zip(starts[first].tolist(), ends[last + window - 1].tolist(), first.tolist(), where.tolist(), strict=True):
                    s = data[a:b]
                    strings = held.setdefault(bucket, {})
                    places = strings.get(s)
                    if places is None:
                        strings[s] = [doc, row, w]
                        size += b - a + 120
                    else:
                        places += (doc, row, w)
                        size += 40
                if size > FLUSH:
                    size = 0
                    yield flush()
        if held:
            yield flush()

    return pack


def _merge(blobs: list[bytes]) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    """The distinct strings of a bucket, and (string, doc, row, word) of each place."""
    index: dict[bytes, int] = {}
    owners, places = [], []
    loosen = zstandard.ZstdDecompressor()
    for blob in blobs:
        raw = loosen.decompress(blob)
        n = int(np.frombuffer(raw, np.int64, 1)[0])
        lengths = np.frombuffer(raw, np.int32, n, 8)
        counts = np.frombuffer(raw, np.int32, n, 8 + 4 * n)
        m = int(counts.sum())
        places.append(np.frombuffer(raw, np.int64, 3 * m, 8 + 8 * n).reshape(3, m))
        at = 8 + 8 * n + 24 * m
        edges = (at + np.concatenate([[0], np.cumsum(lengths, dtype=np.int64)])).tolist()
        own = [index.setdefault(raw[a:b], len(index)) for a, b in zip(edges[:-1], edges[1:], strict=True)]
        owners.append(np.repeat(np.array(own, np.int64), counts))
    return list(index), np.concatenate(owners), np.concatenate(places, axis=1)


def repeated_starts(blobs: list[bytes], window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(doc, row, word) of each window in a bucket that a document with a smaller id also starts."""
    strings, owner, (doc, row, word) = _merge(blobs)
    n = len(strings)
    least = np.full(n, NULL_ID, np.int64)
    np.minimum.at(least, owner, doc)
    hasher = WordHasher(whitespace_separators())
    hashes, holder, offset, spans = [], [], [], {}
    for group in range(0, n, 4096):
        part = strings[group : group + 4096]
        joined = b" ".join(part)
        starts, ends, h = hasher.words(joined)
        edge = np.cumsum([0, *[len(s) + 1 for s in part]])
        words = np.diff(np.searchsorted(starts, edge))
        hash_ = _run_hash(h, window)
        of = np.repeat(np.arange(len(part)), words)
        begin = np.concatenate([[0], np.cumsum(words)])[:-1]
        inner = np.arange(len(h)) - np.repeat(begin, words)
        good = np.flatnonzero(inner[: len(hash_)] <= (np.repeat(words, words) - window)[: len(hash_)])
        hashes.append(hash_[good])
        holder.append(of[good] + group)
        offset.append(inner[good])
    hashes, holder, offset = np.concatenate(hashes), np.concatenate(holder), np.concatenate(offset)
    order = np.argsort(hashes, kind="stable")
    sorted_ = hashes[order]
    same = np.concatenate([[False], sorted_[1:] == sorted_[:-1]]) if len(sorted_) else np.zeros(0, bool)
    run = np.cumsum(~same) - 1
    shared = np.bincount(run, minlength=1)[run] > 1 if len(run) else same
    floor = least[holder].copy()
    groups: dict[tuple[int, bytes], list[int]] = {}
    for i in order[shared].tolist():  # the words themselves decide, not their hashes
        s = holder[i]
        if s not in spans:
            spans[s] = strings[s].split()
        groups.setdefault(b" ".join(spans[s][offset[i] : offset[i] + window]), []).append(i)
        if len(spans) > 50_000:
            spans.clear()
    for members in groups.values():
        if len(members) > 1:
            floor[members] = least[holder[members]].min()
    # places of each string, in order of strings
    by = np.argsort(owner, kind="stable")
    count = np.bincount(owner, minlength=n)
    begin = np.concatenate([[0], np.cumsum(count)])
    most = np.full(n, -(2**63), np.int64)
    np.maximum.at(most, owner, doc)
    out = [[], [], []]
    for i in np.flatnonzero(floor < most[holder]).tolist():
        at = by[begin[holder[i]] : begin[holder[i] + 1]]
        at = at[doc[at] > floor[i]]
        out[0].append(doc[at])
        out[1].append(row[at])
        out[2].append(word[at] + offset[i])
    if not out[0]:
        z = np.zeros(0, np.int64)
        return z, z, z
    return tuple(np.concatenate(x) for x in out)


def _bucket(window: int):
    """Rows of (bucket, blob), grouped and in order of bucket, to rows of (doc, row, starts)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, blobs = None, []

        def solve():
            doc, row, word = repeated_starts(blobs, window)
            order = np.lexsort((word, row, doc))
            doc, row, word = doc[order], row[order], word[order]
            cut = np.flatnonzero((doc[1:] != doc[:-1]) | (row[1:] != row[:-1])) + 1 if len(doc) else np.zeros(0, np.int64)
            edges = np.concatenate([[0], cut, [len(doc)]]).astype(np.int32) if len(doc) else np.zeros(1, np.int32)
            return pa.RecordBatch.from_arrays(
                [pa.array(doc[edges[:-1]]), pa.array(row[edges[:-1]]), pa.ListArray.from_arrays(pa.array(edges), pa.array(word.astype(np.int32)))], ["doc", "row", "starts"]
            )

        for batch in batches:
            for bucket, blob in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if bucket != current and blobs:
                    yield solve()
                    blobs = []
                current = bucket
                blobs.append(blob)
        if blobs:
            yield solve()

    return run


def _covering(window: int):
    """Rows of (doc_id, text, starts) to the digest of what is left."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts, starts = (batch.column(i) for i in range(3))
            words, gone, digests, left = [], [], [], []
            for text, at in zip(texts.to_pylist(), starts.to_pylist(), strict=True):
                w = text.encode("utf-8", "surrogatepass").split() if text else []
                words.append(len(w))
                if at:
                    mark = np.zeros(len(w) + 1, np.int64)
                    at = np.unique(np.array(at, np.int64))
                    np.add.at(mark, at, 1)
                    np.add.at(mark, at + window, -1)
                    keep = np.cumsum(mark[:-1]) == 0
                    gone.append(int(len(w) - keep.sum()))
                    w = [x for x, k in zip(w, keep.tolist(), strict=True) if k]
                else:
                    gone.append(0)
                kept = b" ".join(w)
                digests.append(hashlib.sha256(kept).hexdigest())
                left.append(kept.decode("utf-8", "surrogatepass"))
            yield pa.RecordBatch.from_arrays([ids, pa.array(words, pa.int64()), pa.array(gone, pa.int64()), pa.array(digests, pa.string()), pa.array(left, pa.string())], ["doc_id", "n_words", "n_removed", "kept_sha256", "kept"])

    return run


def survey(docs: DataFrame, window: int, order: int, capacity: int) -> Plan:
    """Buckets for the super-k-mers of all texts: small enough for memory, and enough of them for the session's tasks."""
    found = docs.where("text is not null").select("text").mapInArrow(_surveying(window, order), "slot int, load long").groupBy("slot").agg(F.sum("load").alias("load")).collect()
    loads = np.zeros(1 << SLOT_BITS, np.int64)
    for r in found:  # as many rows as there are slots at most
        loads[r["slot"]] = r["load"]
    tasks = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return Plan(loads, max(1, min(capacity, int(loads.sum()) // (4 * tasks) + 1)))


def drop_repeats(docs: DataFrame, window: int = WINDOW, order: int = ORDER, capacity: int = CAPACITY) -> DataFrame:
    """Per row of ``docs``: doc_id, n_words, n_removed, kept_sha256 and kept, the words that are left."""
    base = docs.select("doc_id", "text").select("doc_id", "text", F.coalesce("doc_id", F.lit(NULL_ID)).cast("long").alias("k"), F.coalesce(F.xxhash64("text"), F.lit(0)).alias("row"))
    plan = survey(base, window, order, capacity)
    packed = base.where("text is not null").select("k", "row", "text").mapInArrow(_packer(window, order, plan), "bucket long, blob binary")
    dealt = packed.repartition(plan.buckets, "bucket").sortWithinPartitions("bucket")
    found = dealt.mapInArrow(_bucket(window), "doc long, row long, starts array<int>")
    at = found.groupBy("doc", "row").agg(F.flatten(F.collect_list("starts")).alias("starts")).select(F.col("doc").alias("k"), "row", "starts")
    joined = base.join(at, ["k", "row"], "left").select("doc_id", "text", "starts")
    return joined.mapInArrow(_covering(window), "doc_id long, n_words long, n_removed long, kept_sha256 string, kept string")


def substring_report(docs: DataFrame) -> DataFrame:
    return drop_repeats(docs).drop("kept")


ORACLE = f"""
WITH d AS MATERIALIZED (
  SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w FROM documents
), p AS MATERIALIZED (
  SELECT doc_id, i, md5(array_to_string(w[i:i + {WINDOW - 1}], ' ')) AS g FROM (SELECT doc_id, w, unnest(generate_series(1, len(w) - {WINDOW - 1})) AS i FROM d WHERE len(w) >= {WINDOW})
), m AS (
  SELECT g, min(doc_id) AS least FROM p GROUP BY g
), c AS (
  SELECT DISTINCT doc_id, unnest(generate_series(i, i + {WINDOW - 1})) AS i FROM p JOIN m USING (g) WHERE doc_id > least
), k AS (
  SELECT x.doc_id, string_agg(x.word, ' ' ORDER BY x.i) AS kept, count(*) AS n FROM (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS i FROM d) x ANTI JOIN c ON c.doc_id = x.doc_id AND c.i = x.i GROUP BY x.doc_id
)
SELECT d.doc_id, len(d.w) AS n_words, len(d.w) - coalesce(k.n, 0) AS n_removed, sha256(coalesce(k.kept, '')) AS kept_sha256 FROM d LEFT JOIN k ON k.doc_id = d.doc_id
"""
