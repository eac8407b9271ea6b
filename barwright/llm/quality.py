"""Quality rules whose cutoffs are certified to reject few good documents.

Base rules drop very short and very repetitive texts. Four further rules score
a text, on scales on which 0 is usual; its joint score is the greatest of them,
and it goes if that reaches its stratum's cutoff. Strata are length classes.

Cutoffs are taken from a fixed grid. For a cutoff, the good documents of a
labelled holdout that it would reject are counted, and the exact binomial tail
P[Bin(n, alpha) <= rejected] is the p-value of "it rejects more than alpha of
the good documents". In a stratum the cutoffs are tested from the most lenient
to the strictest, in that fixed order and up to the first that fails, so no
correction is needed within a stratum: the first cutoff that rejects too much
must pass its own test to do harm. Of the cutoffs that pass, the one is used
whose shares of bad and of good documents rejected differ most. Over the strata Bonferroni's correction
shares out delta. With probability 1 - delta every stratum's verdict is safe. A
stratum where no cutoff passes (with alpha 2 % and delta 5 %, one with fewer
than 217 good documents) doesn't reject.

All counts are made in the engine; what reaches the driver is one row for each
stratum (counts over the grid), so it does not grow with
the corpus. The four counts of a text are made in its own row by array
functions: no shuffle.

Three-word windows are compared by 64-bit hashes within a text.

Defined results: null and blank texts have no words and fail the base rules;
labels without a document and documents without a label don't count; of several
labels of a document the lowest counts; without labels nothing but the base
rules rejects; repeated rows are judged alike; an empty table gives no row.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE, saved, words

#: Scores by name. Weights and offsets put what good texts have near 0 (fixed values): twice the share of symbols, half the shares of
#: repeated lines and words, tenths of the characters of a mean word beyond six.
RULES = {
    "symbols": lambda: 2 * F.try_divide(F.col("n_symbols").cast("double"), F.col("word_chars")),
    "duplicate_lines": lambda: F.try_divide(F.col("n_dup_lines").cast("double"), F.col("n_lines")) / 2,
    "repeated_words": lambda: F.try_divide(F.col("n_repeat_words").cast("double"), F.col("n_words")) / 2,
    "long_words": lambda: (F.try_divide(F.col("word_chars").cast("double"), F.col("n_words")) - 6) / 10,
}
#: Cutoffs tried, strictest first.
GRID = (0.01, 0.02, 0.05, 0.08, 0.12, 0.16, 0.2, 0.25, 0.3, 0.4, 0.5, 0.6, 0.8)
#: Upper ends of the length classes in words.
STRATA = (100, 400, 1600)


def _with_repeats(rows: DataFrame) -> DataFrame:
    """rows (__w, words) with __r, the number of words in a window of three words that the text has twice or more.

    Each array is a column of its own: a lambda that named the expression
    would compute the whole array again for each element.
    """
    last = F.size("__w") - 2
    ends = F.when(last < 2, F.array().cast("array<int>")).otherwise(F.sequence(F.lit(1), last))
    word = lambda i: F.get(F.col("__h"), i)
    rows = rows.withColumn("__h", F.transform("__w", lambda x: F.xxhash64(x))).withColumn("__e", ends)
    rows = rows.withColumn("__v", F.sort_array(F.transform("__e", lambda i: F.struct(F.xxhash64(word(i - 1), word(i), word(i + 1)).alias("h"), i.alias("i")))))
    hash_at = lambda k: F.get(F.col("__v"), k)["h"]
    before = lambda x, k: F.coalesce(x["h"] == hash_at(k - 1), F.lit(False))
    after = lambda x, k: F.coalesce(x["h"] == hash_at(k + 1), F.lit(False))
    rows = rows.withColumn("__p", F.sort_array(F.transform(F.filter("__v", lambda x, k: before(x, k) | after(x, k)), lambda x: x["i"])))
    # places in order: each covers three words, less those that the one before it covers
    ahead = lambda k: F.get(F.col("__p"), k + 1)
    covers = F.transform("__p", lambda x, k: F.least(F.lit(3), F.coalesce(ahead(k) - x, F.lit(3))))
    return rows.withColumn("__r", F.aggregate(covers, F.lit(0), lambda a, x: a + x))


def measured(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and the counts of each text, as a written table.

    Written, because filters on the counts would else be pushed below them and
    compute the arrays of a text again and again.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    base = docs.select(F.col(id_col).alias("doc_id"), text.alias("__t")).select("doc_id", "__t", words(F.col("__t")).alias("__w"), F.filter(F.split("__t", "\n"), lambda x: F.btrim(x, F.lit(" \t\n\x0b\x0c\r")) != "").alias("__l"))
    counts = _with_repeats(base).select(
        "doc_id",
        F.size("__w").cast("long").alias("n_words"),
        F.length(F.regexp_replace("__t", SPACE + "+", "")).cast("long").alias("word_chars"),
        (F.length("__t") - F.length(F.regexp_replace("__t", r"[#*$%&|<>]+", ""))).cast("long").alias("n_symbols"),
        (F.size("__l") - F.size(F.array_distinct("__l"))).cast("long").alias("n_dup_lines"),
        F.col("__r").cast("long").alias("n_repeat_words"),
        F.size("__l").cast("long").alias("n_lines"),
    )
    return saved(counts, "quality-counts")


def _stratum() -> Column:
    return sum(((F.col("n_words") >= top).cast("int") for top in STRATA), F.lit(0))


def _failed() -> Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def binomial_tail(k: int, n: int, p: float) -> float:
    """P[Bin(n, p) <= k], exactly but for rounding: the incomplete beta function by its continued fraction, so n may be any size."""
    if k >= n:
        return 1.0
    a, b, x = n - k, k + 1, 1 - p
    turned = x > (a + 1) / (a + b + 2)  # the fraction converges fast on this side
    if turned:
        a, b, x = b, a, p
    front = math.exp(a * math.log(x) + b * math.log1p(-x) + math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b)) / a
    value, c, d = 1.0, 1.0, 0.0
    for i in range(10_000_000):
        m = i // 2
        if i == 0:
            step = 1.0
        elif i % 2 == 0:
            step = m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m))
        else:
            step = -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
        d = 1 / (1 + step * d)
        c = 1 + step / c
        value *= c * d
        if abs(1 - c * d) < 1e-13:
            break
    tail = min(1.0, max(0.0, front * (value - 1)))
    return 1 - tail if turned else tail


def joint() -> Column:
    """The greatest of the rules' scores, at least 0."""
    return F.greatest(F.lit(0.0), *[F.coalesce(f(), F.lit(0.0)) for f in RULES.values()])


def certify(counts: list[tuple[int, int, list[int], int, list[int]]], alpha: float, delta: float, strata: int = len(STRATA) + 1) -> dict[int, float]:
    """A certified cutoff by stratum. counts: stratum, good documents and how many of them each cutoff of GRID rejects, bad ones and how many of them.

    Of the certified ones, that with the greatest share of bad less share of good documents rejected, the most lenient on ties.
    """
    found = {}
    for stratum, n, rejected, n_bad, bad in counts:
        best = None
        for cutoff, k, b in reversed(list(zip(GRID, rejected, bad, strict=True))):
            if not n or binomial_tail(k, n, alpha) > delta / strata:
                break
            gain = (b / n_bad if n_bad else 0.0) - k / n
            if best is None or gain > best:
                best, found[stratum] = gain, cutoff
    return found


def cutoffs(counted: DataFrame, labels: DataFrame, *, alpha: float = 0.02, delta: float = 0.05) -> dict[int, float]:
    """Certified cutoffs by stratum, from the good and bad documents (quality 1 and 0) of labels."""
    known = labels.where("doc_id is not null and quality is not null").groupBy("doc_id").agg((F.min("quality") == 1).alias("good"))
    held = counted.where(~_failed()).join(known, "doc_id").select(_stratum().alias("stratum"), "good", joint().alias("score"))
    sums = [F.count_if((F.col("good") == side) & (F.col("score") >= c)).alias(f"{name}{i}") for name, side in (("g", True), ("b", False)) for i, c in enumerate(GRID)]
    rows = held.groupBy("stratum").agg(F.count_if("good").alias("n"), F.count_if(~F.col("good")).alias("m"), *sums)
    each = lambda r, name: [r[f"{name}{i}"] for i in range(len(GRID))]
    return certify([(r.stratum, r.n, each(r, "g"), r.m, each(r, "b")) for r in rows.collect()], alpha, delta)


def judge(counted: DataFrame, found: dict[int, float]) -> DataFrame:
    """counted with base_failed, kept and, of a text that the cutoff rejects, the rule of the greatest score (the first by name on ties)."""
    cutoff = F.lit(None).cast("double")
    for stratum, value in sorted(found.items()):
        cutoff = F.when(_stratum() == stratum, F.lit(value)).otherwise(cutoff)
    failed = _failed()
    worst = F.array_min(F.array(*[F.struct((-F.coalesce(f(), F.lit(0.0))).alias("s"), F.lit(k).alias("rule")) for k, f in RULES.items()]))["rule"]
    rejected = ~failed & F.coalesce(joint() >= cutoff, F.lit(False))
    return counted.withColumn("base_failed", failed).withColumn("rule", F.when(rejected, worst)).withColumn("kept", ~failed & F.col("rule").isNull())


def _oracle() -> str:
    """SQL that repeats the counts, the certification and the verdict."""
    grid = ", ".join(f"{c}::DOUBLE" for c in GRID)
    return rf"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS t FROM documents),
w AS (
  SELECT doc_id, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS w, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l FROM d),
v AS (
  SELECT doc_id, u.i AS i, w[u.i] || ' ' || w[u.i + 1] || ' ' || w[u.i + 2] AS g FROM w, unnest(range(1, len(w) - 1)) AS u(i)),
r AS (SELECT doc_id, i FROM v QUALIFY count(*) OVER (PARTITION BY doc_id, g) > 1),
y AS (SELECT doc_id, count(DISTINCT i + o) AS n FROM r, (VALUES (0), (1), (2)) AS x(o) GROUP BY doc_id),
m AS (
  SELECT w.doc_id, len(w)::BIGINT AS n_words, length(regexp_replace(t, '[\x20\x09-\x0D]+', '', 'g'))::BIGINT AS word_chars,
         (length(t) - length(regexp_replace(t, '[#*$%&|<>]+', '', 'g')))::BIGINT AS n_symbols,
         (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines, coalesce(y.n, 0)::BIGINT AS n_repeat_words, len(l) AS n_lines
  FROM w LEFT JOIN y ON y.doc_id = w.doc_id),
f AS (
  SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
         {' + '.join(f'(n_words >= {s})::INT' for s in STRATA)} AS stratum
  FROM m),
s AS (
  SELECT doc_id, stratum, base_failed, greatest(0, coalesce(2 * (n_symbols::DOUBLE / nullif(word_chars, 0)), 0), coalesce(n_dup_lines::DOUBLE / nullif(n_lines, 0) / 2, 0),
         coalesce(n_repeat_words::DOUBLE / nullif(n_words, 0) / 2, 0), coalesce((word_chars::DOUBLE / nullif(n_words, 0) - 6) / 10, 0)) AS score
  FROM f),
g AS (SELECT doc_id, min(quality) = 1 AS good FROM labels WHERE doc_id IS NOT NULL AND quality IS NOT NULL GROUP BY doc_id),
c AS (
  SELECT stratum, cut, count(*) FILTER (good) AS n, count(*) FILTER (good AND score >= cut) AS k, count(*) FILTER (NOT good) AS n_bad, count(*) FILTER (NOT good AND score >= cut) AS bad
  FROM s JOIN g ON g.doc_id = s.doc_id, unnest([{grid}]) AS q(cut) WHERE NOT base_failed GROUP BY ALL),
p AS (
  SELECT *, n > 0 AND (CASE WHEN k >= n THEN 1 ELSE list_sum(list_transform(range(0, k + 1), lambda i: exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) + i * ln(0.02::DOUBLE) + (n - i) * ln(0.98::DOUBLE)))) END) <= 0.05 / {len(STRATA) + 1} AS ok
  FROM c),
b AS (
  SELECT stratum, arg_max(cut, (coalesce(bad::DOUBLE / nullif(n_bad, 0), 0) - k::DOUBLE / n, cut)) AS cut FROM p
  WHERE ok AND cut > coalesce((SELECT max(x.cut) FROM p AS x WHERE x.stratum = p.stratum AND NOT x.ok), -1) GROUP BY stratum),
x AS (SELECT doc_id FROM s JOIN b ON s.stratum = b.stratum WHERE s.score >= b.cut)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND doc_id NOT IN (SELECT doc_id FROM x) AS kept
FROM f
"""


ORACLE = _oracle()
