"""The corpus pipeline: five stages over documents, each written and reread before the next.

run() applies them. The first four return the columns of documents, whatever
these are called, with their own values; the last returns the pieces of packed
sequences.
"""

from __future__ import annotations

from public_tokenizers import path as vocabulary_path
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barwright.llm import common, exact, jaccard, mixing, packing, toxicity


def _aside(docs: DataFrame, *read: str) -> DataFrame:
    """docs whose columns, but those that a stage reads, have names that no operator adds or replaces."""
    return docs.toDF(*[c if c in read else f"own {k}" for k, c in enumerate(docs.columns)])


def _back(rows: DataFrame, docs: DataFrame, *read: str) -> DataFrame:
    """The columns of docs again, of rows made from _aside(docs)."""
    return rows.select(*[F.col(c if c in read else f"`own {k}`").alias(c) for k, c in enumerate(docs.columns)])


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity chain doesn't reject; null and blank texts stay, repeated rows are judged each, without usable labels all stay."""
    chain = toxicity.train(docs, common.table(spark, sf_dir, "labels"))
    read = ("doc_id", "text")
    return _back(toxicity.score(_aside(docs, *read), chain).where(~F.col("toxic")), docs, *read)


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of equal texts (white space aside): the longest, then of least doc_id, null first, then the first
    read; null counts as empty, and ids may repeat or be null."""
    return exact.distinct(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each component of the Jaccard join: of least doc_id, null first, then the first read; and all rows without
    words, which are linked with nothing. Ids may repeat or be null."""
    return jaccard.distinct(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The copies that the mix takes, in training order; a document taken twice is there twice, null and blank texts have no
    words and are copied as their place says; a null source is a source of its own."""
    read = ("doc_id", "text", "source")
    return _back(mixing.training_order(mixing.mix(_aside(docs, *read))), docs, *read)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences of 1024 tokens, in the order of the mix, which the files that docs are read from keep; null and blank
    texts give their ids and the end id, repeated rows are packed each, no rows give no piece."""
    return packing.pack(packing.in_file_order(docs), vocabulary=vocabulary_path("byte_bpe_50k.json"), ranks=vocabulary_path("byte_bpe_50k.tiktoken"))


_made: list = []


def _staged(stage):
    """Before a stage, the scratch tables of the one before go: its result has been written by then. Tables of others stay."""

    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        common.release(_made)
        with common.collected(_made):
            return stage(spark, docs, sf_dir)

    run_stage.__name__, run_stage.__doc__ = stage.__name__, stage.__doc__
    return run_stage


STAGES = [
    ("toxicity", _staged(drop_toxic)),
    ("exact_dedup", _staged(drop_exact_copies)),
    ("ngram_jaccard_join", _staged(drop_near_copies)),
    ("source_mixing", _staged(mix_sources)),
    ("packing", _staged(pack_sequences)),
]

#: The first stage is a trained model, which SQL can't express; tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        out = stage(spark, docs, sf_dir)
        path = f"{common.shared_dir(spark)}/barwright-pipeline/{common.run_id()}-{name}"
        out.write.parquet(path)
        common.later(spark, path)
        docs = spark.read.schema(out.schema).parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
