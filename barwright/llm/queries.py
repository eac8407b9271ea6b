"""One query for each corpus operator, over its whole table with production parameters."""

from __future__ import annotations

from public_tokenizers import path as VOCABULARY
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import conversations, decontaminate, exact, htmltext, jaccard, mixing, packing, phrases, quality, secrets, tokencount, toxicity, urls
from .common import saved, table, word_count


def op1_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    known = secrets.dictionary(docs)
    return secrets.scan(docs, secrets.train(secrets.findings(spark, dictionary=known), known), path_col="source")


def op2_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    sized = saved(docs.select("doc_id", "source", word_count(F.col("text")).alias("words")), "mixing-sizes")
    mixed = mixing.mix(sized, size=F.col("words"))
    at = lambda k: F.round(F.try_element_at("positions", F.lit(k)), 6).alias(f"position_{k}")
    told = mixed.select("doc_id", "size", "source_size", F.round("target", 6).alias("target"), F.col("taken").cast("long").alias("taken"), at(1), at(2))
    return told.orderBy(F.col("position_1").asc_nulls_last(), "doc_id")


def op3_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return htmltext.extract(table(spark, sf_dir, "pages"), htmltext.train(htmltext.training_pages()))


def op4_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.join(table(spark, sf_dir, "documents"))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    chain = toxicity.train(docs, table(spark, sf_dir, "labels"))
    return toxicity.score(docs, chain).drop("text")


def op6_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact.dedup(table(spark, sf_dir, "documents"))


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), vocabulary=VOCABULARY("byte_bpe_50k.json"), ranks=VOCABULARY("byte_bpe_50k.tiktoken"))


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokencount.count(table(spark, sf_dir, "documents"), vocabulary=VOCABULARY("byte_bpe_50k.json"))


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    counted = quality.measured(table(spark, sf_dir, "documents"))
    found = quality.cutoffs(counted, table(spark, sf_dir, "labels"))
    return quality.judge(counted, found).drop("n_lines", "rule")


def op10_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    templates = urls.tree(urls.labelled_by_document(pages, table(spark, sf_dir, "labels")))
    return urls.judge(pages, templates).select("page_id", "host", "path", "rule", "verdict")


def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations")
    found = conversations.repair(conversations.damage(rows))
    counts = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")
    told = rows.select("conv_id").distinct().withColumn("key", conversations.key_of(F.col("conv_id")))
    told = told.join(found.audits.drop("conv_id"), "key", "left").join(conversations.hashed(found.rows), "key", "left")
    empty = F.sha2(F.lit("").cast("binary"), 256)
    return told.select("conv_id", *[F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in counts], F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("sha256", empty).alias("repaired_sha256"))


def op12_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    told = decontaminate.scan(table(spark, sf_dir, "documents"), decontaminate.windows(table(spark, sf_dir, "benchmark")))
    return told.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


def op13_phrase_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.mine(table(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (op1_secret_scans, op2_source_mixing, op3_html_extraction, op4_ngram_jaccard_join, op5_toxicity, op6_exact_dedup, op7_packing, op8_token_counts, op9_quality_rules, op10_url_filters, op11_conversation_repair, op12_benchmark_decontamination, op13_phrase_collocations)}
ORACLE = {"op2_source_mixing": mixing.ORACLE, "op6_exact_dedup": exact.ORACLE, "op9_quality_rules": quality.ORACLE, "op10_url_filters": urls.ORACLE, "op11_conversation_repair": conversations.ORACLE, "op12_benchmark_decontamination": decontaminate.ORACLE, "op13_phrase_collocations": phrases.ORACLE}
