"""Benchmark decontamination: a hash set of the benchmark's word windows, scanned over every training window.

Texts are normalised (A-Z to a-z; words are runs of letters, digits and
whatever lies beyond ASCII). A window is `n` consecutive words of a benchmark
item; an item of fewer words is one window. The windows, each once with the set
of items that hold it, are broadcast if they take at most `broadcast_bytes`, and
else joined by a shuffle: the same rows either way.

Scan: one pass over the documents. Each place of each text gives a 64-bit hash
of the window that begins there, for every window size that the benchmark has
(at most n). Hash hits are verified word for word. A document's hits are merged
into spans in its own row; only hits and one narrow row a document are shuffled.
All of it is done by built-in functions.

Items: windows that the same items hold share a set of items, so a document
names few sets however many of its windows hit.

clean() removes the spans (or the documents) and keeps all columns.

Defined results: null and blank texts have no words, no hits, and stay; items
without words have no window; a null item_id is written as an empty string, and
several items of one id count once; rows that are alike, or share an id, or
have a null id are judged each; very long texts are scanned whole, a place at a
time; an empty benchmark hits nothing and empty documents give no row; other
columns pass through clean(), whatever they are called.
"""

from __future__ import annotations

import string
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import saved

#: Words between two ASCII characters of this class; the class is given for texts whose A-Z are a-z already.
GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
GAP_CHARS = "".join(chr(c) for c in (*range(0x30), *range(0x3A, 0x61), *range(0x7B, 0x80)))
#: The words of a text in its own letters.
WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
#: Benchmarks of more bytes than this (texts of all windows and 64 bytes a window) are joined by a shuffle.
BROADCAST_BYTES = 64 << 20


def lowered(text: Column) -> Column:
    """A-Z as a-z, all else as it is; a text without other than ASCII takes the faster function."""
    text = F.coalesce(text.cast("string"), F.lit(""))
    return F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(F.translate(text, string.ascii_uppercase, string.ascii_lowercase))


def with_words(rows: DataFrame, text: Column, to: str) -> DataFrame:
    """rows with the array `to` of the words of a text, A-Z as a-z; null and wordless texts have none.

    Two steps, so that the text is lowered once.
    """
    rows = rows.withColumn("__bare", F.btrim(lowered(text), F.lit(GAP_CHARS)))
    return rows.withColumn(to, F.when(F.col("__bare") == "", F.array().cast("array<string>")).otherwise(F.split("__bare", GAP))).drop("__bare")


def _hash(words: Column, at: Column, size: int) -> Column:
    return F.xxhash64(*[F.get(words, at + k) for k in range(size)])


def _by_size(size: Column, sizes: list[int], value) -> Column:
    """value(k) for the k of sizes that `size` is; null for none."""
    out = F.lit(None).cast("long")
    for k in sizes:
        out = F.when(size == k, value(k)).otherwise(out)
    return out


@dataclass
class Windows:
    """What a benchmark is searched by: windows (size, text, hash, items_key), their sets of items (items_key, items), the sizes there are."""

    windows: DataFrame
    sets: DataFrame
    sizes: list[int]
    small: bool


def windows(benchmark: DataFrame, n: int = 10, *, id_col: str = "item_id", text_col: str = "text", broadcast_bytes: int = BROADCAST_BYTES) -> Windows:
    """The distinct windows of a benchmark, written in the shared folder."""
    items = benchmark.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("item"), F.col(text_col).alias("t"))
    items = with_words(items, F.col("t"), "w").where(F.size("w") > 0).withColumn("size", F.least(F.lit(n), F.size("w")))
    places = items.select("item", "size", "w", F.explode(F.sequence(F.lit(0), F.size("w") - F.col("size"))).alias("i"))
    texts = places.select("item", "size", F.concat_ws(" ", F.slice("w", F.col("i") + 1, F.col("size"))).alias("text"))
    held = texts.groupBy("size", "text").agg(F.array_sort(F.collect_set("item")).alias("items"))
    split = F.split("text", " ")
    held = saved(held.select("size", "text", _by_size(F.col("size"), list(range(1, n + 1)), lambda k: _hash(split, F.lit(0), k)).alias("hash"), F.sha2(F.to_json("items"), 256).alias("items_key"), "items"), "benchmark-windows")
    bytes_of = F.coalesce(F.sum(F.octet_length("text") + F.size("items") * 16 + 64), F.lit(0))
    told = held.agg(bytes_of.alias("bytes"), F.sort_array(F.collect_set("size")).alias("sizes")).first()
    return Windows(held.drop("items"), held.select("items_key", "items").dropDuplicates(["items_key"]), list(told.sizes), told.bytes <= broadcast_bytes)


def _scanned(rows: DataFrame, found: Windows) -> DataFrame:
    """rows (row, id, text) as row, id, n_words, spans (array of start, end in words) and items_keys: one row each.

    The place -1 stands for the row itself, so that one pass gives the counts
    of all rows and the hits of some.
    """
    sizes = found.sizes or [0]
    words = with_words(rows, F.col("text"), "w")
    places = words.select("row", "id", "w", F.size("w").alias("n"), F.explode(F.sequence(F.lit(-1), F.size("w") - 1)).alias("i"))
    if len(sizes) == 1:
        places = places.withColumn("s", F.lit(sizes[0]))
    else:
        places = places.withColumn("s", F.explode(F.array(*[F.lit(k) for k in sizes]))).where(f"i >= 0 or s = {sizes[0]}")
    inside = (F.col("i") >= 0) & (F.col("i") + F.col("s") <= F.col("n"))
    hashed = F.when(inside, _by_size(F.col("s"), sizes, lambda k: _hash(F.col("w"), F.col("i"), max(k, 1))))
    if not found.small:
        hashed = F.coalesce(hashed, F.xxhash64("row", "i"))  # rows without a window would else meet in one task
    places = places.withColumn("h", hashed)
    known = F.broadcast(found.windows) if found.small else found.windows
    # word for word after the join: in its condition Spark would take the texts for a key and build one at each place
    same = F.concat_ws(" ", F.slice("w", F.greatest(F.col("i"), F.lit(0)) + 1, F.col("s"))) == F.col("text")
    met = places.join(known, F.col("h") == F.col("hash"), "left")
    met = met.where((F.col("i") < 0) | (F.col("items_key").isNotNull() & (F.col("s") == F.col("size")) & same))
    hit = F.when(F.col("items_key").isNotNull(), F.struct(F.col("i").alias("start"), (F.col("i") + F.col("s")).alias("end")))
    by_row = met.groupBy("row", "id").agg(F.max("n").cast("long").alias("n_words"), F.sort_array(F.collect_list(hit)).alias("hits"), F.collect_set("items_key").alias("items_keys"))
    return _merged(by_row, max(sizes))


def _merged(rows: DataFrame, longest: int) -> DataFrame:
    """rows with spans in place of their sorted hits; hits that overlap or touch are one span.

    No hit is longer than `longest`, so of the hits, one for each start, only
    the last `longest` can reach a place: linear in the hits.
    """
    later = lambda k: F.get(F.col("hits"), k + 1)["start"]
    rows = rows.withColumn("hits", F.filter("hits", lambda x, k: later(k).isNull() | (later(k) != x["start"])))
    before = lambda column, k: F.slice(column, F.greatest(F.lit(1), k - longest + 1), F.least(k, F.lit(longest)))
    opens = lambda x, k: ~F.exists(before(F.col("hits"), k), lambda y: y["end"] >= x["start"])
    rows = rows.withColumn("begins", F.filter(F.transform("hits", lambda x, k: F.when(opens(x, k), k)), lambda k: k.isNotNull()))
    upto = lambda j: F.coalesce(F.get(F.col("begins"), j + 1), F.size("hits"))
    end = lambda j: F.array_max(F.transform(before(F.col("hits"), upto(j)), lambda y: y["end"]))
    spans = F.transform("begins", lambda k, j: F.struct(F.get(F.col("hits"), k)["start"].alias("start"), end(j).alias("end")))
    return rows.select("row", "id", "n_words", spans.alias("spans"), "items_keys")


def _numbered(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("id"), F.col(text_col).alias("text"))


def scan(docs: DataFrame, found: Windows, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """For each row of docs: doc_id, n_words, n_hit (words inside an occurrence of a window), spans and items (sorted ids)."""
    told = saved(_scanned(_numbered(docs, id_col, text_col), found), "benchmark-hits")
    named = told.where(F.size("items_keys") > 0).withColumn("items_key", F.explode("items_keys"))
    named = named.join(F.broadcast(found.sets) if found.small else found.sets, "items_key")
    named = named.groupBy("row", "id", "n_words", "spans").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"))
    others = told.where(F.size("items_keys") == 0).select("row", "id", "n_words", "spans", F.array().cast("array<string>").alias("items"))
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda a, x: a + x["end"] - x["start"])
    return named.unionByName(others).select(F.col("id").alias("doc_id"), "n_words", n_hit.alias("n_hit"), "spans", "items")


def without(text: Column, spans: Column) -> Column:
    """text less the words of spans and what stands between the words of one span."""
    own, gaps = F.regexp_extract_all(text, F.lit(f"({WORD})"), F.lit(1)), F.split(text, WORD)
    hit = lambda k: F.exists(spans, lambda s: (s["start"] <= k) & (k < s["end"]))
    after = lambda k: F.get(gaps, k + 1)
    part = lambda k: F.when(~hit(k), F.concat(F.get(own, k), after(k))).when(hit(k + 1), F.lit("")).otherwise(after(k))
    return F.concat(F.get(gaps, F.lit(0)), F.array_join(F.transform(F.sequence(F.lit(0), F.size(gaps) - 2), part), ""))


def clean(docs: DataFrame, found: Windows, *, remove: str = "spans", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs, all columns, without the benchmark: remove="spans" cuts them out of the texts, remove="documents" drops documents that hold one."""
    if remove not in ("spans", "documents"):
        raise ValueError(f"remove is 'spans' or 'documents', not {remove!r}")
    held = saved(docs.select(F.monotonically_increasing_id().alias("row"), F.struct(*docs.columns).alias("doc")), "benchmark-documents")
    rows = held.select("row", F.col(f"doc.`{id_col}`").alias("id"), F.col(f"doc.`{text_col}`").alias("text"))
    hits = _scanned(rows, found).where(F.size("spans") > 0).select("row", "spans")
    if remove == "documents":
        return held.join(hits, "row", "left_anti").select("doc.*")
    text = F.when(F.col("spans").isNull(), F.col(f"doc.`{text_col}`")).otherwise(without(F.col(f"doc.`{text_col}`"), F.col("spans")))
    return held.join(hits, "row", "left").select(*[text.alias(c) if c == text_col else F.col(f"doc.`{c}`") for c in docs.columns])


ORACLE = rf"""
WITH d AS (
  SELECT doc_id, row_number() OVER () AS r, regexp_extract_all(translate(coalesce(text, ''), '{string.ascii_uppercase}', '{string.ascii_lowercase}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents),
b AS (
  SELECT coalesce(item_id::VARCHAR, '') AS item, regexp_extract_all(translate(coalesce(text, ''), '{string.ascii_uppercase}', '{string.ascii_lowercase}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark),
v AS (SELECT DISTINCT item, least(10, len(w)) AS s, w[u.i : u.i + least(10, len(w)) - 1] AS g FROM b, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS u(i) WHERE len(w) > 0),
p AS (SELECT r, u.i AS i, z.s AS s, w[u.i : u.i + z.s - 1] AS g FROM d, (SELECT DISTINCT s FROM v) AS z, unnest(range(1, len(w) - z.s + 2)) AS u(i)),
h AS (SELECT p.r, p.i, p.s, v.item FROM p JOIN v ON v.g = p.g AND v.s = p.s),
n AS (SELECT r, count(DISTINCT u.k) AS n_hit FROM h, unnest(range(h.i, h.i + h.s)) AS u(k) GROUP BY r),
m AS (SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT r, item FROM h) GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN n ON n.r = d.r LEFT JOIN m ON m.r = d.r
"""
