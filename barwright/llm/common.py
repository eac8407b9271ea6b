"""Helpers that the corpus operators share: words, scratch tables, names."""

from __future__ import annotations

import atexit
import contextlib
import re
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space of all contracts: U+0020 and U+0009 to U+000D.
SPACE = r"[\x20\x09-\x0D]"
SPACE_CHARS = " \t\n\x0b\x0c\r"

_scratch: list[tuple[SparkSession, str]] = []
_owners = [_scratch]
_at_exit: list[tuple[SparkSession, str]] = []


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def words(text: Column) -> Column:
    """Array of the maximal runs of other than white space; null and blank texts have none."""
    bare = F.btrim(F.coalesce(text, F.lit("")), F.lit(SPACE_CHARS))
    return F.when(bare == "", F.array().cast("array<string>")).otherwise(F.split(bare, SPACE + "+"))


def word_count(text: Column) -> Column:
    return F.size(words(text)).cast("long")


def slices(batch: pa.RecordBatch, column: int | str, step: int = 1 << 22, rows: int = 1024) -> Iterator[pa.RecordBatch]:
    """The batch in parts of at most `rows` rows whose texts have about `step` bytes in all; a longer text is alone."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64) + 1)
    at = 0
    while at < batch.num_rows:
        to = int(np.searchsorted(ends, (ends[at - 1] if at else 0) + step, side="right"))
        to = min(max(at + 1, to), at + rows)
        yield batch.slice(at, to - at)
        at = to


@contextlib.contextmanager
def small_batches(spark: SparkSession, size: str = "8m") -> Iterator[None]:
    """What runs inside sends Arrow batches of so many bytes at most, which bounds the memory of both sides."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, size)
    try:
        yield
    finally:
        spark.conf.set(name, before)


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors see; a session on one machine that has none gets one here."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        if not spark.sparkContext.getCheckpointDir():
            spark.sparkContext.setCheckpointDir(named)
        return named
    if not spark.sparkContext.getCheckpointDir():
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="barwright-"))
    return spark.sparkContext.getCheckpointDir()


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder; release() or the end of the session removes it."""
    path = f"{shared_dir(spark).rstrip('/')}/barwright-scratch/{name}-{run_id()}"
    _owners[-1].append((spark, path))
    return path


def written(df: DataFrame, name: str, **options) -> tuple[DataFrame, str]:
    """df written as Parquet in the shared folder and read again, and its path."""
    path = scratch_path(df.sparkSession, name)
    df.write.options(**({"compression": "zstd"} | options)).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), path


def saved(df: DataFrame, name: str, **options) -> DataFrame:
    """df written as Parquet in the shared folder and read again: cuts lineage, survives lost executors."""
    return written(df, name, **options)[0]


def hot_join(left: DataFrame, right: DataFrame, on: list[str], share: int = 1000) -> DataFrame:
    """left with the columns of right (one row for each key, none null), null where it has no such key; left is read three times.

    At most `share` keys have more than 1/share of left's rows each; what right
    has of them is broadcast, so that no task gets all rows of such a key. The
    other rows are shuffled.
    """
    most = left.count() / share
    hot = saved(left.groupBy(*on).agg(F.count(F.lit(1)).alias("__n")).where(F.col("__n") > most).select(*on), "hot-keys")
    near = F.broadcast(saved(right.join(F.broadcast(hot), on, "left_semi"), "hot-rows"))
    columns = [*left.columns, *[c for c in right.columns if c not in on]]
    some = left.join(F.broadcast(hot), on, "left_semi").join(near, on, "left")
    others = left.join(F.broadcast(hot), on, "left_anti").join(right, on, "left")
    return some.select(*columns).unionByName(others.select(*columns))


def run_id() -> str:
    return uuid.uuid4().hex


@contextlib.contextmanager
def collected(tables: list[tuple[SparkSession, str]]) -> Iterator[None]:
    """Scratch tables made inside belong to this list, for a release() of them alone."""
    _owners.append(tables)
    try:
        yield
    finally:
        _owners.pop()


def later(spark: SparkSession, path: str) -> None:
    """Delete path when Python ends."""
    _at_exit.append((spark, path))


def release(paths: list[tuple[SparkSession, str]] = _scratch) -> None:
    """Delete the scratch tables of a list, or all that belong to none. Call it once nothing lazy reads them any more."""
    while paths:
        spark, path = paths.pop()
        try:
            hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
            hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(hadoop, True)
        except Exception:  # noqa: BLE001  the session may have ended; its folder goes with it
            continue


atexit.register(release)
atexit.register(release, _at_exit)
