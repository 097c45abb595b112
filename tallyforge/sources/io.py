"""Readers, writers and identities of files."""

from __future__ import annotations

import gzip
import hashlib
import io
import json
import platform
import tempfile
import uuid
import zipfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def shared_folder(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; one of this machine where a local session has none, an error on a cluster."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        root = tempfile.mkdtemp(prefix="tallyforge-")
        spark.conf.set("spark.checkpoint.dir", root)
    return root


#: What this process has written with ``materialise`` and not dropped.
_written: list[str] = []


#: Whether shuffle files go when the query that made them ends.
FREED = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def materialise(df: DataFrame, name: str) -> DataFrame:
    """``df`` written in the shared folder and read again; the shuffle files of the write go with it."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/tables/{uuid.uuid4().hex}-{name}"
    _written.append(path)
    before = spark.conf.get(FREED, None)
    spark.conf.set(FREED, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.unset(FREED) if before is None else spark.conf.set(FREED, before)
    return spark.read.schema(df.schema).parquet(path)


def drop_tables(spark: SparkSession) -> int:
    """Deletes the tables that ``materialise`` has written so far and says how many; call it when results are written."""
    count = len(_written)
    for path in _written:
        place = spark._jvm.org.apache.hadoop.fs.Path(path)
        place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)
    _written.clear()
    return count


def read_csv(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """CSV with a header; quotes are doubled, fields may span lines."""
    return spark.read.schema(schema).option("header", True).option("multiLine", True).option("quote", '"').option("escape", '"').option("mode", "FAILFAST").csv(path)


def read_jsonl(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """One JSON object per line; blank lines are skipped, broken ones are errors."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def read_json(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    return spark.read.schema(schema).option("multiLine", True).option("mode", "FAILFAST").json(path)


def finite(df: DataFrame) -> DataFrame:
    """``df``, with an error where a double is not finite."""
    checks = {n: F.when(F.isnan(n) | (F.abs(F.col(n)) == float("inf")), F.raise_error(F.lit(f"{n} is not finite")).cast(t)).otherwise(F.col(n)) for n, t in df.dtypes if t in ("double", "float")}
    return df.withColumns(checks) if checks else df


def write_jsonl(df: DataFrame, path: str) -> None:
    """JSON lines through Spark's commit protocol: readers see all of it or nothing."""
    finite(df).write.mode("overwrite").json(path)


def write_splits(df: DataFrame, path: str, key: str = "example_id") -> None:
    """Parquet by split, each file in order of the key."""
    df.repartition("split", F.pmod(F.xxhash64(key), F.lit(8))).sortWithinPartitions("split", key).write.mode("overwrite").partitionBy("split").parquet(path)


def file_hashes(spark: SparkSession, path: str) -> DataFrame:
    """(path, sha256, size) of files."""
    return spark.read.format("binaryFile").load(path).select("path", F.sha2("content", 256).alias("sha256"), F.col("length").alias("size"))


def unequal(manifest: DataFrame, hashes: DataFrame) -> DataFrame:
    """Manifest entries whose file is missing or has another hash."""
    return manifest.select("path", "sha256").join(hashes.select("path", F.col("sha256").alias("found")), "path", "left").where(~F.col("sha256").eqNullSafe(F.col("found")))


def verified_gzip(spark: SparkSession, manifest: DataFrame, path: str) -> DataFrame:
    """(path, line) of gzip files that agree with (path, gzip_sha256, sha256, rows); three kinds of error else."""
    files = spark.read.format("binaryFile").load(path).select("path", "content").join(manifest, "path")

    def open_(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for r in f.itertuples(index=False):
                if hashlib.sha256(r.content).hexdigest() != r.gzip_sha256:
                    raise ValueError(f"archive hash differs: {r.path}")
                raw = gzip.decompress(r.content)
                if hashlib.sha256(raw).hexdigest() != r.sha256:
                    raise ValueError(f"content hash differs: {r.path}")
                lines = [x for x in raw.decode().split("\n") if x.strip()]
                if len(lines) != r.rows:
                    raise ValueError(f"row count differs: {r.path}")
                yield pd.DataFrame({"path": [r.path] * len(lines), "line": lines})

    return files.mapInPandas(open_, "path string, line string")


def unsafe_members(content: bytes) -> list[str]:
    """Members of a zip archive that would leave its folder."""
    return [n for n in zipfile.ZipFile(io.BytesIO(content)).namelist() if n.startswith("/") or ".." in n.split("/")]


def with_line_numbers(df: DataFrame, order: str, first: int = 2) -> DataFrame:
    """Rows numbered from ``first`` in the order of a column, range by range."""
    from tallyforge.operators.runlog import positions

    return positions(df, [order]).withColumn("row_number", F.col("pos") + first).drop("pos")


def replace_text(spark: SparkSession, path: str, text: str) -> None:
    """A small text file, written aside and renamed over the old one: readers see the old or the new, never nothing."""
    jvm = spark._jvm
    fs = jvm.org.apache.hadoop.fs
    target, aside = fs.Path(path), fs.Path(f"{path}.{uuid.uuid4().hex}.tmp")
    files = fs.FileContext.getFileContext(target.toUri(), spark._jsc.hadoopConfiguration()) if target.toUri().getScheme() else fs.FileContext.getFileContext(spark._jsc.hadoopConfiguration())
    out = target.getFileSystem(spark._jsc.hadoopConfiguration()).create(aside, True)
    try:
        out.write(bytearray(text.encode("utf-8", "surrogatepass")))
    finally:
        out.close()
    kind = getattr(fs, "Options$Rename")
    over = spark.sparkContext._gateway.new_array(kind, 1)
    over[0] = kind.OVERWRITE
    files.rename(aside, target, over)


def read_text(spark: SparkSession, path: str) -> str | None:
    """A small text file, None where there is none."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = place.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(place):
        return None
    return spark.read.text(path, wholetext=True).first()[0]


def write_json(spark: SparkSession, document: dict, path: str) -> None:
    """A small document as JSON, indented, non-ASCII kept; readers see the old or the new document."""
    replace_text(spark, path, json.dumps(document, indent=2, ensure_ascii=False, allow_nan=False) + "\n")


def config_hash(config: dict) -> str:
    """The hash of a configuration, whatever the order of its keys."""
    return hashlib.sha256(json.dumps(config, sort_keys=True).encode()).hexdigest()


def run_metadata(spark: SparkSession, config: dict, code_commit: str, code_dirty: bool | None, files: dict[str, str]) -> DataFrame:
    """One row that says where a result comes from: configuration and its hash, code, platform, hashes of named inputs.

    ``files`` maps a name to the path of a file, or of a folder of which each file counts, in order.
    """
    row = {"config": json.dumps(config, sort_keys=True), "config_sha256": config_hash(config), "platform": platform.platform(), "spark": spark.version, "code_commit": code_commit, "code_dirty": code_dirty}
    for name, path in files.items():
        found = file_hashes(spark, path).select(F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("path", "sha256"))), lambda x: x["sha256"]), "\n"), 256).alias("h"), F.count("*").alias("n"), F.max("sha256").alias("one")).first()
        row[f"{name}_sha256"] = found["one"] if found["n"] == 1 else found["h"]
    types = {"code_dirty": "boolean"}
    return spark.createDataFrame([tuple(row.values())], ", ".join(f"{k} {types.get(k, 'string')}" for k in row))


def missing_splits(spark: SparkSession, path: str, splits: list[str]) -> list[str]:
    """Which splits a folder written by ``write_splits`` does not have."""
    root = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = root.getFileSystem(spark._jsc.hadoopConfiguration())
    return [s for s in splits if not fs.exists(spark._jvm.org.apache.hadoop.fs.Path(f"{path}/split={s}"))]


def write_missing(df: DataFrame, path: str, splits: list[str], key: str = "example_id") -> list[str]:
    """Writes the rows of missing splits and leaves the others as they are; the splits written."""
    todo = missing_splits(df.sparkSession, path, splits)
    if todo:
        df.where(F.col("split").isin(todo)).repartition("split", F.pmod(F.xxhash64(key), F.lit(8))).sortWithinPartitions("split", key).write.mode("append").partitionBy("split").parquet(path)
    return todo


def same_identity(a: DataFrame, b: DataFrame) -> DataFrame:
    """(field, left, right) where two single-row descriptions differ."""
    long = lambda df, s: df.select(F.explode(F.map_from_arrays(F.array(*map(F.lit, df.columns)), F.array(*[F.col(c).cast("string") for c in df.columns]))).alias("field", s))
    return long(a, "left").join(long(b, "right"), "field", "full_outer").where(~F.col("left").eqNullSafe(F.col("right")))


def log_metrics(df: DataFrame, run: str, step: int) -> DataFrame:
    """(run, key, value, step) from the numeric columns of a single-row report."""
    numeric = [n for n, t in df.dtypes if t in ("double", "float", "int", "bigint")]
    return df.select(*[F.col(c).cast("double").alias(c) for c in numeric]).unpivot([], numeric, "key", "value").select(F.lit(run).alias("run"), "key", "value", F.lit(step).alias("step"))
