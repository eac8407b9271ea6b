"""Exact deduplication with a log-structured merge index.

Flush: each task buffers its rows (a memtable), sorts them by the digest of
their normalised text and writes them as a sorted run with per-page minima and
maxima and a Bloom filter for each row group; `memtable_rows` bounds a file.
No shuffle is needed to flush, and the source is read this once: runs hold the
rows themselves.

Compact: `fan_in` runs at a time merge into a run of the next level, level by
level until one is left. A merged run has an entry for each digest: the row
that stays (most code points, smallest doc_id, and of rows alike the first
written) and the number of rows. Entries are summed before they move, so a
digest that a third of all rows share costs one entry a task and level.

Verify: a bitmap filter of the digests that occur more than once, of at most
`filter_bits` bits (so it can be broadcast whatever the corpus), lets through
the rows of those digests and few others. Their normalised texts are compared
byte for byte through the smallest and largest of each digest. Should two texts
share a digest, their rows are grouped by the text itself.

lookup() probes the index by digests and lets the runs' Bloom filters skip row
groups.

Defined results: a null text is an empty text; rows that are alike in every
column are separate rows, of which one is kept; of rows of equal length a null
doc_id comes first; an empty table gives an empty result; other columns are not
read by dedup() and pass through distinct().
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE, saved

#: Runs merged into one, and bits of the filter of repeated digests (8 MB).
FAN_IN, FILTER_BITS = 16, 1 << 26
RUN_OPTIONS = {"parquet.bloom.filter.enabled#digest": "true", "parquet.bloom.filter.adaptive.enabled#digest": "true"}


def normalised(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), SPACE + "+", "")


def flush(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", memtable_rows: int = 1_000_000, digest_chars: int = 64) -> DataFrame:
    """Sorted runs in the shared folder: digest, n_points, doc_id, text_sha256, run (of the task that wrote it), row (a number of its own) and doc (all columns of docs)."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(F.struct(*docs.columns).alias("doc"), F.col(id_col).cast("long").alias("doc_id"), F.length(text).alias("n_points"), F.sha2(normalised(text).cast("binary"), 256).alias("text_sha256"))
    runs = rows.select("*", F.substring("text_sha256", 1, digest_chars).alias("digest"), F.spark_partition_id().alias("run"), F.monotonically_increasing_id().alias("row"))
    return saved(runs.sortWithinPartitions("digest"), "dedup-runs", maxRecordsPerFile=str(memtable_rows), **RUN_OPTIONS)


def _first() -> Column:
    return F.struct((-F.col("n_points")).alias("short"), F.col("doc_id").alias("id"), F.col("row").alias("row"))


def compact(runs: DataFrame, fan_in: int = FAN_IN) -> DataFrame:
    """The last level: digest, first (the row that stays) and group_size."""
    level = runs.select("run", "digest", _first().alias("first"), F.lit(1).cast("long").alias("group_size"))
    left = (runs.agg(F.max("run")).first()[0] or 0) + 1
    while True:
        merged = level.groupBy(F.floor(F.col("run") / fan_in).cast("int").alias("run"), "digest").agg(F.min("first").alias("first"), F.sum("group_size").alias("group_size"))
        level = saved(merged, "dedup-level")
        left = -(-left // fan_in)
        if left <= 1:
            return level.drop("run")


def lookup(runs: DataFrame, digests: list[str]) -> DataFrame:
    """Rows of the index with one of a few digests; filters of the runs prune row groups."""
    return runs.where(F.col("digest").isin(digests))


def _place(bits: int) -> Column:
    return F.pmod(F.xxhash64("digest"), F.lit(bits))


def repeated_filter(hits: DataFrame, bits: int) -> DataFrame:
    """The filter of the digests of hits, in blocks: block and bitmap."""
    at = hits.select(_place(bits).alias("at"))
    return at.groupBy(F.bitmap_bucket_number("at").alias("block")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("at")).alias("bitmap"))


def probed(rows: DataFrame, filter_: DataFrame, bits: int) -> DataFrame:
    """Rows whose digest the filter may hold."""
    at = rows.withColumn("__at", _place(bits)).withColumn("block", F.bitmap_bucket_number("__at")).join(F.broadcast(filter_), "block")
    bit = F.bitmap_bit_position("__at")
    byte = F.conv(F.hex(F.substring("bitmap", (F.floor(bit / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    return at.where(F.getbit(byte, F.pmod(bit, F.lit(8)).cast("int")) == 1).drop("__at", "block", "bitmap")


def collisions(runs: DataFrame, hits: DataFrame, text_col: str, bits: int) -> DataFrame:
    """Digests of hits whose rows' normalised bytes are not all equal."""
    texts = probed(runs.select("digest", F.col("doc")[text_col].cast("string").alias("text")), repeated_filter(hits, bits), bits)
    same = texts.select("digest", normalised(F.col("text")).alias("norm")).groupBy("digest").agg(F.min("norm").alias("lo"), F.max("norm").alias("hi"))
    return same.where(F.col("lo") != F.col("hi")).select("digest")


def judged(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", memtable_rows: int = 1_000_000, digest_chars: int = 64, fan_in: int = FAN_IN, filter_bits: int = FILTER_BITS) -> DataFrame:
    """doc (the columns of docs), doc_id, keep_id, group_size, kept, text_sha256: one row for each row of docs.

    `digest_chars` shortens the index key; tests use it to force collisions.
    """
    runs = flush(docs, id_col=id_col, text_col=text_col, memtable_rows=memtable_rows, digest_chars=digest_chars)
    hits = compact(runs, fan_in).where("group_size > 1")
    mixed = saved(collisions(runs, hits.select("digest"), text_col, filter_bits), "dedup-collisions")
    out = runs.join(hits, "digest", "left")
    if not mixed.isEmpty():
        bytes_ = saved(runs.join(mixed, "digest", "left_semi").withColumn("key", normalised(F.col("doc")[text_col].cast("string"))), "dedup-bytes")
        groups = saved(bytes_.groupBy("key").agg(F.min(_first()).alias("first"), F.count(F.lit(1)).alias("group_size")), "dedup-texts")
        out = out.join(mixed, "digest", "left_anti").unionByName(bytes_.join(groups, "key").drop("key"))
    alone = F.col("first").isNull()
    keep = F.when(alone, F.col("doc_id")).otherwise(F.col("first.id"))
    kept = alone | (F.col("first.row") == F.col("row"))
    return out.select("doc", "doc_id", keep.alias("keep_id"), F.coalesce("group_size", F.lit(1)).alias("group_size"), kept.alias("kept"), "text_sha256")


def dedup(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256: one row for each row of docs."""
    return judged(docs.select(id_col, text_col), id_col=id_col, text_col=text_col, **options).drop("doc")


def distinct(docs: DataFrame, **options) -> DataFrame:
    """The rows of docs that stay."""
    return judged(docs, **options).where("kept").select("doc.*")


ORACLE = r"""
WITH d AS (
  SELECT doc_id, row_number() OVER () AS r, length(coalesce(text, '')) AS n, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', '', 'g')) AS text_sha256
  FROM documents),
g AS (
  SELECT *, count(*) OVER (PARTITION BY text_sha256) AS group_size,
         first_value(doc_id) OVER (PARTITION BY text_sha256 ORDER BY n DESC, doc_id NULLS FIRST) AS keep_id,
         row_number() OVER (PARTITION BY text_sha256 ORDER BY n DESC, doc_id NULLS FIRST, r) = 1 AS kept
  FROM d)
SELECT doc_id, keep_id, group_size, kept, text_sha256 FROM g
"""
