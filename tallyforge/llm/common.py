"""What the training-data operators share: table access, lineage cuts and word hashing."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

DOCUMENT_COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_root(spark: SparkSession) -> str:
    """The folder that driver and executors share, as ``spark.checkpoint.dir`` names it.

    A local session without that setting (a test) gets a folder of this machine; a cluster without it is an error.
    """
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        root = tempfile.mkdtemp(prefix="tallyforge-")
        spark.conf.set("spark.checkpoint.dir", root)
    return root


#: What this process has written and not dropped.
_written: list[str] = []


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder, for ``drop_tables`` to delete."""
    path = f"{shared_root(spark)}/tallyforge/{uuid.uuid4().hex}-{name}"
    _written.append(path)
    return path


def materialise(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as Parquet in the shared folder and read again: a lineage cut that outlives executors."""
    spark = df.sparkSession
    path = shared_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop_tables(spark: SparkSession) -> int:
    """Deletes the tables that ``materialise`` has written so far and says how many; call it when results are written,
    since results read them until then."""
    count = len(_written)
    for path in _written:
        place = spark._jvm.org.apache.hadoop.fs.Path(path)
        place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)
    _written.clear()
    return count


def boxed(rows: DataFrame, *named: str) -> DataFrame:
    """``rows`` with all columns but ``named`` renamed by place, so that no name of theirs can clash with one in use."""
    return rows.toDF(*[c if c in named else f"tf_c{i}" for i, c in enumerate(rows.columns)])


def unboxed(result: DataFrame, rows: DataFrame, *more: str) -> DataFrame:
    """The first columns of ``result`` under the names of ``rows`` again, then ``more``, which follow them."""
    return result.toDF(*rows.columns, *more)


# ---------------------------------------------------------------------------------------------------------------------
# Vectorised word hashing over the UTF-8 bytes of a batch of texts.

_MULTIPLIER = 0x9E3779B97F4A7C15 | 1


def _mix(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> np.uint64(27))
    h = h * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


class WordHasher:
    """64-bit polynomial hashes of words, all at once, from the bytes of many texts.

    A word's hash depends on its bytes alone. ``separators`` is a 256-entry boolean table of the bytes between words.
    """

    def __init__(self, separators: np.ndarray, chunk: int = 1 << 20):
        self.separators = separators
        self.chunk = chunk
        self.codes = _mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(_MULTIPLIER))
        self._grow(1 << 16)

    def _grow(self, n: int) -> None:
        base = np.uint64(_MULTIPLIER)
        inverse = np.uint64(pow(_MULTIPLIER, -1, 1 << 64))
        with np.errstate(over="ignore"):
            self.powers = np.multiply.accumulate(np.concatenate([[np.uint64(1)], np.full(n, base)]))
            self.inverses = np.multiply.accumulate(np.concatenate([[np.uint64(1)], np.full(n, inverse)]))

    def words(self, data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Starts, ends and hashes of the words of one text."""
        b = np.frombuffer(data, np.uint8)
        if not len(b):
            return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64)
        if len(b) + 1 > len(self.powers):
            self._grow(2 * len(b))
        inside = ~self.separators[b]
        edge = np.diff(np.concatenate([[False], inside, [False]]).astype(np.int8))
        starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        with np.errstate(over="ignore"):
            run = np.cumsum(self.codes[b] * self.powers[: len(b)], dtype=np.uint64)
            before = np.where(starts > 0, run[starts - 1], np.uint64(0)) if len(starts) else run[:0]
            h = (run[ends - 1] - before) * self.inverses[starts] if len(starts) else run[:0]
            h = _mix(h + np.uint64(1) * (ends - starts).astype(np.uint64))
        return starts, ends, h


def whitespace_separators() -> np.ndarray:
    """Space and 0x09 to 0x0D."""
    t = np.zeros(256, bool)
    t[[0x20, *range(0x09, 0x0E)]] = True
    return t


def ascii_nonword_separators() -> np.ndarray:
    """Every ASCII byte that is neither letter nor digit; bytes of non-ASCII characters belong to words."""
    t = np.zeros(256, bool)
    t[:128] = True
    t[[*range(48, 58), *range(65, 91), *range(97, 123)]] = False
    return t


def grouped(columns: int, solve):
    """Runs ``solve`` on each group of consecutive rows with equal first ``columns`` values."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, key = [], None
        for batch in batches:
            keys = list(zip(*(batch.column(i).to_pylist() for i in range(columns)), strict=True))
            a = 0
            while a < len(keys):
                b = a
                while b < len(keys) and keys[b] == keys[a]:
                    b += 1
                if keys[a] != key and held:
                    yield from solve(pa.Table.from_batches(held))
                    held = []
                key = keys[a]
                held.append(batch.slice(a, b - a))
                a = b
        if held:
            yield from solve(pa.Table.from_batches(held))

    return run


def word_chunks(column: pa.Array, hasher: WordHasher, most: int = 1 << 19) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, hashes of the lower-cased words of some rows one after the other, words of each row), by bounded bytes.

    A text is never cut: one longer than the bound is a chunk of its own. ``hasher`` must take a newline as a separator.
    """
    at = 0
    while at < len(column):
        parts, size, first = [], 0, at
        while at < len(column) and (not parts or size < most):
            parts.append((column[at].as_py() or "").lower().encode("utf-8", "surrogatepass"))
            size += len(parts[-1])
            at += 1
        starts, _, h = hasher.words(b"\n".join(parts))
        edges = np.cumsum([0, *[len(x) + 1 for x in parts]])
        yield first, h, np.diff(np.searchsorted(starts, edges))


class Lookup:
    """Places of 64-bit hashes in an array of distinct ones, -1 for others, by two small direct tables and then a search."""

    def __init__(self, hashes: np.ndarray):
        self.hashes = hashes
        self.bits = int(min(22, max(8, np.ceil(np.log2(4 * len(hashes) + 1)))))
        self.tables, rest = [], np.arange(len(hashes))
        for shift in (64 - self.bits, 8):  # what the first table has no room for goes to the second, then to a search
            table = np.full(1 << self.bits, -1, np.int32)
            slot = self._slot(hashes[rest], shift)
            table[slot] = rest
            self.tables.append((shift, table))
            rest = rest[table[slot] != rest]
        self.rest = rest[np.argsort(hashes[rest])]

    def __reduce__(self):
        return Lookup, (self.hashes,)

    def _slot(self, h: np.ndarray, shift: int) -> np.ndarray:
        return (h >> np.uint64(shift)).astype(np.int64) & ((1 << self.bits) - 1)

    def __call__(self, h: np.ndarray) -> np.ndarray:
        out = np.full(len(h), -1, np.int64)
        if not len(self.hashes) or not len(h):
            return out
        todo = np.arange(len(h))
        for shift, table in self.tables:
            at = table[self._slot(h[todo], shift)]
            good = (at >= 0) & (self.hashes[at] == h[todo])
            out[todo[good]] = at[good]
            todo = todo[~good]
        if len(self.rest) and len(todo):
            known = self.hashes[self.rest]
            at = np.minimum(np.searchsorted(known, h[todo]), len(known) - 1)
            good = known[at] == h[todo]
            out[todo[good]] = self.rest[at[good]]
        return out


def one_thread() -> None:
    """Keeps this process's linear algebra to one thread, where the library can be told: tasks run side by side already."""
    for path in Path(np.__file__).parents[1].glob("numpy.libs/*openblas*"):
        library = ctypes.CDLL(str(path))
        for name in ("scipy_openblas_set_num_threads64_", "openblas_set_num_threads64_", "openblas_set_num_threads"):
            if hasattr(library, name):
                getattr(library, name)(1)
