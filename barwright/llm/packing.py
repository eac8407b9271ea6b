"""Packing documents into training sequences: concatenate and cut.

Pass 1 tokenises each document once, where it is read, and writes its ids with
its run and the offset inside the run. Pass 2 sums tokens a run, turns the sums
into global offsets, and cuts every document at the multiples of the sequence
length: a document that crosses a multiple leaves a boundary record on each
side. No document moves between tasks; what grows on the driver side is one row
for each run.

A run is a partition, in the order of partitions. Spark puts files into
partitions by size, so for tables whose files are in an order, in_file_order()
names the place of each row; then a run is what a task reads of a file without
a gap, in the order of part numbers and rows.

Where no two white space characters meet, and without control characters and
the special token's string, the vocabulary in its ranked form splits a text as
the tokenizer does, in less time; such texts go to it, if it is given, and all
others to the tokenizer. Very long texts are read in segments cut before a lone
space between two other characters, where a token always starts.

Defined results: a null text is an empty text; every document, empty ones too,
ends with the id 0; repeated rows are packed as separate documents; an empty
table gives no piece.
"""

from __future__ import annotations

import functools
import itertools
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import saved, slices, small_batches

SEQUENCE = 1024
#: Texts that only the tokenizer reads.
ODD = re.compile("\\s\\s|[\x00\x1c-\x1f]|<\\|endoftext\\|>")
#: The split pattern of the byte-level vocabulary.
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Where any text may be cut, and after how many characters that is done.
CUT, SEGMENT = re.compile(r"(?<=\S) (?=\S)"), 1 << 16
#: Run totals that may be broadcast (20 bytes each).
BROADCAST_RUNS = 1 << 20


def segments(text: str) -> Iterator[str]:
    at = 0
    while len(text) - at > SEGMENT and (cut := CUT.search(text, at + SEGMENT)):
        yield text[at : cut.start()]
        at = cut.start()
    yield text[at:] if at else text


class Ids:
    """Token ids of texts."""

    def __init__(self, vocabulary: str, ranks: str | None = None):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(vocabulary)
        self.ranked = ranked(ranks) if ranks else None

    def of(self, text: str) -> np.ndarray:
        """The ids of a whole text."""
        return np.concatenate([self._of(part) for part in segments(text)])

    def _of(self, text: str) -> np.ndarray:
        if self.ranked and not ODD.search(text):
            return np.array(self.ranked.encode_ordinary(text), np.uint32)
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, np.uint32)


def ranked(path: str):
    """The byte-level vocabulary as ranks, with the split pattern that belongs to it."""
    import base64

    import tiktoken

    with open(path, "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
    return tiktoken.Encoding("packing", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


@functools.cache
def worker_ids(vocabulary: str, ranks: str | None) -> Ids:
    """One tokenizer for all tasks of a Python worker."""
    return Ids(vocabulary, ranks)


def in_file_order(docs: DataFrame) -> DataFrame:
    """docs, as read from Parquet files, with __file and __row: where each row lies."""
    return docs.select("*", F.col("_metadata.file_path").alias("__file"), F.col("_metadata.row_index").alias("__row"))


def tokenise(vocabulary: str, ranks: str | None = None, end_id: int = 0):
    """Batches of doc_id, text and, for runs by file, __file and __row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, pid, total = worker_ids(vocabulary, ranks), TaskContext.get().partitionId(), 0
        nth, file, row = 0, None, None
        for batch in batches:
            for part in slices(batch, 1, rows=256):
                n = part.num_rows
                blobs, counts, offsets, runs = [], [], [], []
                placed = zip(part.column(2).to_pylist(), part.column(3).to_pylist(), strict=True) if part.num_columns > 2 else itertools.repeat((None, None), n)
                starts = []
                for text, (f, r) in zip(part.column(1), placed, strict=True):
                    if f is not None and (f != file or r != row + 1):
                        nth, total = nth + 1, 0
                    starts.append((f, r) if total == 0 else (None, None))
                    file, row = f, r
                    x = np.append(ids.of(text.as_py() or ""), np.uint32(end_id))
                    blobs.append(x.astype("<u2" if x.max() < 65536 else "<u4").tobytes())
                    counts.append(len(x))
                    offsets.append(total)
                    runs.append(nth)
                    total += len(x)
                first_file, first_row = zip(*starts, strict=True)
                columns = [part.column(0), pa.array([pid] * n, pa.int32()), pa.array(runs, pa.int32()), pa.array(first_file, pa.string()), pa.array(first_row, pa.int64()), pa.array(offsets, pa.int64()), pa.array(counts, pa.int64()), pa.array(blobs, pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "pid", "run", "file", "row", "local", "n", "ids"])

    return run


def unpacked(blob: bytes, n: int) -> np.ndarray:
    return np.frombuffer(blob, "<u2" if len(blob) == 2 * n else "<u4").astype("<u4")


def cut(sequence: int, keep_ids: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.column("n").to_numpy()
            first = batch.column("first").to_numpy()
            pieces = (first + n - 1) // sequence - first // sequence + 1
            row = np.repeat(np.arange(len(n)), pieces)
            nth = np.arange(len(row)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
            sequence_id = (first // sequence)[row] + nth
            start = np.maximum(sequence_id * sequence - first[row], 0)
            length = np.minimum((sequence_id + 1) * sequence - first[row], n[row]) - start
            ids, last, crc, blobs = None, -1, [], []
            for r, s, k in zip(row, start, length, strict=True):
                if r != last:
                    ids, last = unpacked(batch.column("ids")[int(r)].as_py(), int(n[r])), r
                blob = ids[s : s + k].tobytes()
                crc.append(zlib.crc32(blob))
                if keep_ids:
                    blobs.append(blob)
            columns = [batch.column("doc_id").take(pa.array(row)), start, length, crc, n[row], sequence_id, first[row] + start - sequence_id * sequence]
            columns = [columns[0], *(pa.array(x, pa.int64()) for x in columns[1:])]
            names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
            yield pa.RecordBatch.from_arrays(columns + [pa.array(blobs, pa.binary())] * keep_ids, names=names + ["ids"] * keep_ids)

    return run


def pack(docs: DataFrame, *, vocabulary: str, ranks: str | None = None, id_col: str = "doc_id", text_col: str = "text", sequence: int = SEQUENCE, keep_ids: bool = False) -> DataFrame:
    """One row for each piece of a document in a sequence; with keep_ids also its ids (little-endian 32-bit)."""
    place = [c for c in ("__file", "__row") if c in docs.columns]
    text = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"), *place)
    with small_batches(docs.sparkSession):
        tokens = saved(text.mapInArrow(tokenise(vocabulary, ranks), "doc_id long, pid int, run int, file string, row long, local long, n long, ids binary"), "packing-ids")
    totals = tokens.groupBy("pid", "run").agg(F.sum("n").alias("__n"), F.max("file").alias("file"), F.max("row").alias("row"))
    number = lambda pattern: F.regexp_extract("file", pattern, 1).try_cast("long")
    order = Window.orderBy(number(r"part-([0-9]+)[^/]*$"), number(r"-c([0-9]+)[^/]*$"), "file", "row", "pid", "run")
    bases = totals.select("pid", "run", (F.sum("__n").over(order) - F.col("__n")).alias("__base"))
    if tokens.select("pid", "run").distinct().count() <= BROADCAST_RUNS:
        bases = F.broadcast(bases)
    placed = tokens.join(bases, ["pid", "run"]).select("doc_id", "n", "ids", (F.col("__base") + F.col("local")).alias("first"))
    schema = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
    return placed.mapInArrow(cut(sequence, keep_ids), schema + ", ids binary" * keep_ids)


def sequences(pieces: DataFrame, *, sequence: int = SEQUENCE, pad_id: int = 0) -> DataFrame:
    """sequence_id, n (ids before padding) and ids, from pack(keep_ids=True).

    A sequence is padded to its full length unless its number of ids is a
    power of two. At most `sequence` ids meet in a group.
    """
    parts = pieces.groupBy("sequence_id").agg(F.sort_array(F.collect_list(F.struct("offset", "ids"))).alias("parts"), F.sum("length").alias("n"))
    joined = F.aggregate("parts", F.lit(b"").cast("binary"), lambda all_, x: F.concat(all_, x["ids"]))
    full = (F.bit_count("n") == 1) | (F.col("n") >= sequence)
    fill = F.unhex(F.repeat(F.lit(np.uint32(pad_id).astype("<u4").tobytes().hex()), (F.lit(sequence) - F.col("n")).cast("int")))
    return parts.select("sequence_id", "n", F.when(full, joined).otherwise(F.concat(joined, fill)).alias("ids"))
