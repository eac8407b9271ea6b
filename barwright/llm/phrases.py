"""Phrase collocation mining: counts of all word sequences up to a length, scored against their parts.

Texts are lower-cased (A-Z), cut into pieces at punctuation and line ends and
those into words. Everything is per language.

Count: one row for each place of each text, with the word there and the next
one, is hash-aggregated: pairs, and as their sums the single words. A sequence
of `min_count` occurrences has only pairs of at least as many, so the places
where the first two pairs are that frequent are all that longer sequences begin
at. They give a row each with the up to `max_words` words that follow, which is
hash-aggregated as well; sequences of 3 to max_words words are sums over its
beginnings. No candidate is lost, whatever min_count is, and no sequence of a
rare pair is ever moved.

The frequent pairs are held by 64-bit hashes: a hash that two pairs share only
lets a place through that the exact counts drop later. Up to `broadcast_pairs`
hashes are broadcast; more are joined by a shuffle, after the rows of all places
have been aggregated so that copies count as one.

Score: each cut of a candidate looks up the counts of its two parts
(hot parts are broadcast, the rest is shuffled), and floor(1000 a n / (l r)) is
computed in Decimal; the least counts, of equal ones the shortest first part.

Drop: a candidate inside a longer one that is as frequent is inside one that is
a word longer and as frequent, as counts only fall with length; so an anti-join
with the two shorter ends of each candidate finds all of them.

Rank: the first `top` of each language, first within 64 shares of its
candidates and then among the shares' first ones.

Defined results: null and blank texts have no words; a null language is "und",
together with texts of that name; rows that are alike, or share an id, count
each; ties of score and count go by the phrase's bytes; very long texts are
counted whole, a place at a time; an empty table gives no row; other columns are
not read.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import hot_join, saved
from .decontaminate import lowered

#: Ends of pieces, and what separates words within a piece.
ENDS, GAP, GAP_CHARS = r"[.,;:!?\x0A-\x0D]", r"[\x20\x09]+", " \t"
#: Frequent pairs whose hashes (16 bytes each) are broadcast at most.
BROADCAST_PAIRS = 1 << 21
SHARES = 64
#: Counts and their products.
PART, WHOLE = "decimal(19,0)", "decimal(38,0)"


def pieces(docs: DataFrame, *, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """lang and w (words) of each piece that has words."""
    rows = docs.select(F.coalesce(F.col(lang_col).cast("string"), F.lit("und")).alias("lang"), F.explode(F.split(lowered(F.col(text_col)), ENDS)).alias("p"))
    rows = rows.withColumn("p", F.btrim("p", F.lit(GAP_CHARS))).where("p != ''")
    return rows.select("lang", F.split("p", GAP).alias("w"))


def _word(k: int) -> Column:
    return F.get(F.col("w"), F.col("i") + k)


def _pair_hash(*words: Column) -> Column:
    return F.xxhash64(F.col("lang"), *words)


def counts(docs: DataFrame, *, max_words: int = 5, min_count: int = 100, text_col: str = "text", lang_col: str = "lang", broadcast_pairs: int = BROADCAST_PAIRS) -> tuple[DataFrame, DataFrame]:
    """Written tables: words of all occurrences by language (lang, n), and lang, words, phrase, f of all sequences with f >= min_count."""
    held = pieces(docs, text_col=text_col, lang_col=lang_col)
    at = held.select("lang", "w", F.explode(F.sequence(F.lit(0), F.size("w") - 1)).alias("i"))
    pairs = saved(at.select("lang", _word(0).alias("a"), _word(1).alias("b")).groupBy("lang", "a", "b").agg(F.count(F.lit(1)).alias("f")), "phrases-pairs")
    total = saved(pairs.groupBy("lang").agg(F.sum("f").alias("n")), "phrases-words")
    singles = pairs.groupBy("lang", F.col("a").alias("phrase")).agg(F.sum("f").alias("f")).where(F.col("f") >= min_count)
    doubles = pairs.where(F.col("b").isNotNull() & (F.col("f") >= min_count)) if max_words > 1 else pairs.limit(0)
    kept = [singles.select("lang", F.lit(1).alias("words"), "phrase", "f"), doubles.select("lang", F.lit(2).alias("words"), F.concat_ws(" ", "a", "b").alias("phrase"), "f")]
    if max_words > 2:
        known = saved(doubles.select(_pair_hash(F.col("a"), F.col("b")).alias("h")).distinct(), "phrases-pair-hashes")
        small = known.count() <= broadcast_pairs
        places = held.where(F.size("w") > 2).select("lang", "w", F.explode(F.sequence(F.lit(0), F.size("w") - 3)).alias("i"))
        hashed = places.select("lang", F.concat_ws(" ", F.slice("w", F.col("i") + 1, max_words)).alias("s"), _pair_hash(_word(0), _word(1)).alias("h1"), _pair_hash(_word(1), _word(2)).alias("h2"), F.lit(1).cast("long").alias("f"))
        if not small:
            hashed = saved(hashed.groupBy("lang", "s", "h1", "h2").agg(F.sum("f").alias("f")), "phrases-places")
        for name in ("h1", "h2"):
            keys = known.select(F.col("h").alias(name))
            hashed = hashed.join(F.broadcast(keys) if small else keys, name, "left_semi")
        runs = saved(hashed.groupBy("lang", "s").agg(F.sum("f").alias("f")), "phrases-runs")
        sized = runs.withColumn("words", F.length("s") - F.length(F.replace("s", F.lit(" "), F.lit(""))) + 1)
        sized = sized.select("lang", "s", "f", F.explode(F.sequence(F.lit(3), F.col("words"))).alias("words"))
        longer = sized.groupBy("lang", "words", _beginning_of("s", "words", max_words).alias("phrase")).agg(F.sum("f").alias("f"))
        kept.append(longer.where(F.col("f") >= min_count))
    every = kept[0]
    for more in kept[1:]:
        every = every.unionByName(more)
    return total, saved(every, "phrases-counts")


def _beginning_of(text: str, words: str, most: int) -> Column:
    out = F.col(text)
    for k in range(3, most):
        out = F.when(F.col(words) == k, F.substring_index(text, " ", k)).otherwise(out)
    return out


def _cut(words: int, k: int) -> Column:
    return F.struct(F.lit(k).alias("k"), F.substring_index("phrase", " ", k).alias("left"), F.substring_index("phrase", " ", k - words).alias("right"))


def _by_words(most: int, value) -> Column:
    """value(words) by the column words, 2 to most."""
    out = value(most)
    for n in range(2, most):
        out = F.when(F.col("words") == n, value(n)).otherwise(out)
    return out


def scored(total: DataFrame, counted: DataFrame, max_words: int = 5) -> DataFrame:
    """lang, words, phrase, a, l, r, n, score of each sequence of two words or more, written."""
    cuts = counted.where("words > 1").select("lang", "words", "phrase", F.col("f").alias("a"), F.explode(_by_words(max_words, lambda n: F.array(*[_cut(n, k) for k in range(1, n)]))).alias("c"))
    cuts = saved(cuts.select("lang", "words", "phrase", "a", "c.*"), "phrases-cuts")
    for side, to in (("left", "l"), ("right", "r")):
        cuts = hot_join(cuts, counted.select("lang", F.col("phrase").alias(side), F.col("f").alias(to)), ["lang", side])
    cuts = hot_join(cuts, total, ["lang"])
    product = lambda x, y: F.col(x).cast(PART) * F.col(y).cast(PART)
    cuts = cuts.withColumn("above", (product("a", "n") * F.lit(1000).cast("decimal(4,0)")).cast(WHOLE)).withColumn("below", product("l", "r").cast(WHOLE))
    score = F.expr("above div below")
    least = F.min(F.struct(score.alias("score"), "k", "l", "r")).alias("c")
    return saved(cuts.groupBy("lang", "words", "phrase", "a", "n").agg(least).select("lang", "words", "phrase", "a", "c.l", "c.r", "n", "c.score"), "phrases-scored")


def outermost(candidates: DataFrame) -> DataFrame:
    """candidates that no longer one as frequent holds."""
    ends = F.array(*[F.concat_ws(" ", F.slice(F.split("phrase", " "), s, F.col("words") - 1)) for s in (1, 2)])
    inner = candidates.where("words > 2").select("lang", F.explode(ends).alias("phrase"), "a").distinct()
    return candidates.join(inner, ["lang", "phrase", "a"], "left_anti")


def first(candidates: DataFrame, top: int) -> DataFrame:
    """candidates with rank from 1 within each language, the first `top`."""
    order = [F.col("score").desc(), F.col("a").desc(), F.col("phrase").asc()]
    share = candidates.withColumn("__share", F.pmod(F.xxhash64("phrase"), F.lit(SHARES)))
    share = share.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "__share").orderBy(*order))).where(F.col("rank") <= top)
    return share.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= top).drop("__share")


def mine(docs: DataFrame, *, max_words: int = 5, min_count: int = 100, top: int = 2000, text_col: str = "text", lang_col: str = "lang", broadcast_pairs: int = BROADCAST_PAIRS) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: the first `top` phrases of 2 to max_words words of each language."""
    total, counted = counts(docs, max_words=max_words, min_count=min_count, text_col=text_col, lang_col=lang_col, broadcast_pairs=broadcast_pairs)
    found = first(outermost(scored(total, counted, max_words)), top)
    return found.select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


ORACLE = rf"""
WITH p AS (
  SELECT row_number() OVER () AS p, lang, piece FROM (
    SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), '{string.ascii_uppercase}', '{string.ascii_lowercase}'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents)),
w AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM p),
g AS (
  SELECT lang, s.s AS words, array_to_string(w[u.i : u.i + s.s - 1], ' ') AS phrase, count(*) AS f
  FROM w, (VALUES (1), (2), (3), (4), (5)) AS s(s), unnest(range(1, len(w) - s.s + 2)) AS u(i) GROUP BY ALL),
n AS (SELECT lang, sum(f)::HUGEINT AS n FROM g WHERE words = 1 GROUP BY lang),
c AS (SELECT lang, words, phrase, f AS a, string_split(phrase, ' ') AS w FROM g WHERE words > 1 AND f >= 100),
k AS (
  SELECT c.lang, c.phrase, c.a, x.f AS l, y.f AS r, n.n, k.k, (1000::HUGEINT * c.a * n.n) // (x.f::HUGEINT * y.f) AS score
  FROM c, unnest(range(1, c.words)) AS k(k)
  JOIN g AS x ON x.lang = c.lang AND x.phrase = array_to_string(c.w[1 : k.k], ' ')
  JOIN g AS y ON y.lang = c.lang AND y.phrase = array_to_string(c.w[k.k + 1 :], ' ')
  JOIN n ON n.lang = c.lang),
b AS (SELECT * FROM k QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
i AS (
  SELECT DISTINCT c.lang, array_to_string(c.w[u.i : u.i + s.s - 1], ' ') AS phrase, c.a
  FROM c, (VALUES (2), (3), (4)) AS s(s), unnest(range(1, c.words - s.s + 2)) AS u(i) WHERE s.s < c.words),
o AS (SELECT * FROM b WHERE NOT EXISTS (SELECT 1 FROM i WHERE i.lang = b.lang AND i.phrase = b.phrase AND 100 * i.a >= 100 * b.a))
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n::BIGINT AS n, score::BIGINT AS score
FROM o QUALIFY rank <= 2000
"""
