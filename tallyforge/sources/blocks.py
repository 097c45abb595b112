"""Hashes of files of any size as a Python data source: a partition holds files, and a file is read a block at a time.

``format("blockhash")`` gives (path, size, blocks, sha256) for every file below a folder, or for one file. Nothing holds more
of a file than ``BLOCK`` bytes, so a file may be larger than a cell of a table or an executor's memory. Hidden files (names
that begin with a dot or an underscore) are left out, as Spark leaves them out. Empty files have the hash of nothing.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import datasource as ds
from pyspark.sql import functions as F

BLOCK = 1 << 20
#: Bytes that a task is given, unless one file has more.
TASK_BYTES = 256 << 20


def located(path: str) -> tuple[pafs.FileSystem, str]:
    path = re.sub(r"^s3[an]:", "s3:", re.sub(r"^file:/+", "file:///", path))
    return pafs.FileSystem.from_uri(path) if "://" in path else (pafs.LocalFileSystem(), path)


@dataclass
class Files(ds.InputPartition):
    files: list[str]


class BlockReader(ds.DataSourceReader):
    def __init__(self, path: str, task_bytes: int):
        self.path, self.task_bytes = path, task_bytes

    def partitions(self) -> list[ds.InputPartition]:
        fs, root = located(self.path)
        info = fs.get_file_info(root)
        found = [info] if info.type == pafs.FileType.File else fs.get_file_info(pafs.FileSelector(root, recursive=True))
        below = lambda p: p[len(root) :].split("/") if info.type != pafs.FileType.File else [""]
        files = sorted((f.path, f.size) for f in found if f.type == pafs.FileType.File and not any(x[:1] in "._" and x for x in below(f.path)))
        tasks, held = [[]], 0
        for name, size in files:
            if tasks[-1] and held + size > self.task_bytes:
                tasks, held = [*tasks, []], 0
            tasks[-1].append(name)
            held += size
        return [Files(t) for t in tasks]

    def read(self, partition: Files) -> Iterator[tuple]:
        fs, _ = located(self.path)
        for name in partition.files:
            h, size, blocks = hashlib.sha256(), 0, 0
            with fs.open_input_stream(name, compression=None) as f:
                while block := f.read(BLOCK):
                    h.update(block)
                    size, blocks = size + len(block), blocks + 1
            yield name, size, blocks, h.hexdigest()


class BlockSource(ds.DataSource):
    """Options: path, task_bytes."""

    @classmethod
    def name(cls) -> str:
        return "blockhash"

    def schema(self) -> str:
        return "path string, size long, blocks long, sha256 string"

    def reader(self, schema) -> BlockReader:
        return BlockReader(self.options["path"], int(self.options.get("task_bytes", TASK_BYTES)))


def block_hashes(spark: SparkSession, path: str, task_bytes: int = TASK_BYTES) -> DataFrame:
    """(path, size, blocks, sha256) of the files below ``path``."""
    spark.dataSource.register(BlockSource)
    return spark.read.format("blockhash").option("task_bytes", task_bytes).load(path)


def freeze_check(spark: SparkSession, folder: str, manifest: DataFrame) -> DataFrame:
    """(name, rule) where the files of a folder are not those of a ``manifest`` (name, sha256): missing, changed or added."""
    bare = F.regexp_replace("path", f"^.*?{re.escape(located(folder)[1].rstrip('/'))}/", "")
    found = block_hashes(spark, folder).select(bare.alias("name"), F.col("sha256").alias("now"))
    both = manifest.select("name", "sha256").join(found, "name", "full_outer")
    rule = F.when(F.col("now").isNull(), "missing").when(F.col("sha256").isNull(), "added").when(F.col("now") != F.col("sha256"), "changed")
    return both.select("name", rule.alias("rule")).where("rule is not null")
