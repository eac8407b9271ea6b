"""Each stage of the pipeline against brute force on its own input."""

import collections

from public_tokenizers import path
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from barwright.llm import mixing

from .test_jaccard import brute
from .test_operators import brute_dedup

DATA = "/root/testdata/sf0.001"


def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{DATA}/documents.parquet").limit(120)
    columns = docs.columns
    inputs = {}
    for name, stage in corpus_pipeline.STAGES:
        inputs[name] = docs.collect()
        out = stage(spark, docs, DATA)
        out.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        if name != "packing":
            assert docs.columns == columns
    ids = lambda name: sorted(r.doc_id for r in inputs[name])

    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{DATA}/labels.parquet").collect()}
    gone = set(ids("toxicity")) - set(ids("exact_dedup"))
    assert not [i for i in gone if labels.get(i) == 0]

    kept = [i for i, _, _, stays, _ in brute_dedup([(r.doc_id, r.text) for r in inputs["exact_dedup"]]) if stays]
    assert ids("ngram_jaccard_join") == sorted(kept)

    near = brute([(r.doc_id, r.text) for r in inputs["ngram_jaccard_join"]])
    assert ids("source_mixing") == sorted(i for i, (_, least) in near.items() if i == least)

    taken = collections.Counter(ids("packing"))
    assert set(taken) <= set(ids("source_mixing")) and max(taken.values()) <= 2

    tokenizer = Tokenizer.from_file(path("byte_bpe_50k.json"))
    want = sum(len(tokenizer.encode(r.text or "", add_special_tokens=False).ids) + 1 for r in inputs["packing"])
    assert docs.agg(F.sum("length")).first()[0] == want


def test_packing_keeps_the_order_of_the_mix(spark, tmp_path):
    rows = [(k, "w " * (1 + k % 30) + "long " * (400 * (k % 97 == 5)), f"s{k % 5}") for k in range(900)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    stages = dict(corpus_pipeline.STAGES)
    mixed = mixing.training_order(mixing.mix(docs)).select("doc_id", "copies", "position").collect()
    assert collections.Counter(r.doc_id for r in mixed) == {r.doc_id: r.copies for r in mixed} and max(r.copies for r in mixed) == 2
    want = [r.doc_id for r in mixed]

    def packed(path):
        pieces = stages["packing"](spark, spark.read.parquet(path), DATA).where("start = 0").collect()
        return [r.doc_id for r in sorted(pieces, key=lambda r: (r.sequence_id, r.offset))]

    stages["source_mixing"](spark, docs, DATA).write.parquet(str(tmp_path / "staged"))
    assert packed(str(tmp_path / "staged")) == want
    # files that grow: Spark's own order of reading is by falling size
    text = {k: (t, s) for k, t, s in rows}
    cuts = [0, 3, 20, 90, 300, len(want)]
    parts = [[(k, *text[k]) for k in want[a:b]] for a, b in zip(cuts, cuts[1:], strict=False)]
    unequal = spark.createDataFrame(spark.sparkContext.parallelize(parts, len(parts)).flatMap(lambda p: p), docs.schema)
    unequal.write.parquet(str(tmp_path / "unequal"))
    assert packed(str(tmp_path / "unequal")) == want
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "2000")
    try:
        assert packed(str(tmp_path / "unequal")) == want
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_repeated_and_null_ids_lose_no_text(spark, tmp_path):
    """Both dedup stages keep exactly one row of each text, where ids repeat, are null, or rows are wholly alike."""
    rows = [(3, "zz"), (3, "yy"), (1, "yy"), (5, "same words here"), (5, "same words here"), (None, "lone text"), (None, "lone text"), (None, None), (8, ""), (9, " \n"), (3, "a b c d e f g h"), (4, "a b c d e f g h i"), (4, "x " * 50_000)]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars int")
    stages = dict(corpus_pipeline.STAGES)
    stages["exact_dedup"](spark, docs, DATA).write.parquet(str(tmp_path / "exact"))
    left = spark.read.parquet(str(tmp_path / "exact"))
    texts = lambda df: sorted("".join((r.text or "").split()) for r in df.collect())
    want = sorted({"".join((t or "").split()) for _, t in rows})
    assert left.columns == docs.columns and texts(left) == want
    near = stages["ngram_jaccard_join"](spark, left, DATA)
    assert near.columns == docs.columns and texts(near) == sorted(set(want) - {"abcdefghi"})
    empty = docs.limit(0)
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, empty, DATA)
        assert out.count() == 0, name
        if name == "source_mixing":
            out.write.parquet(str(tmp_path / "none"))
            empty = spark.read.parquet(str(tmp_path / "none"))


def test_columns_of_the_caller_keep_their_values(spark):
    own = {"toxic": 7, "p_toxic": "mine", "size": 99, "target": "keep", "positions": "p", "copies": -1, "position": 0.5, "own 3": 4, "doc": "d"}
    rows = [(k, f"some words of text number {k}", "en", f"s{k % 3}", 5, *own.values()) for k in range(30)]
    docs = spark.createDataFrame(rows, ["doc_id", "text", "lang", "source", "n_chars", *own])
    stages = dict(corpus_pipeline.STAGES)
    labels = spark.read.parquet(f"{DATA}/labels.parquet")
    assert labels.count() > 0
    for name in ("toxicity", "source_mixing"):
        out = stages[name](spark, docs, DATA)
        assert out.columns == docs.columns and out.schema == docs.schema
        got = {tuple(r) for r in out.collect()}
        assert got <= set(rows) and (name != "toxicity" or got)
