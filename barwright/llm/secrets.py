"""Secret scans whose false positives a random forest removes.

Candidates are runs of key characters: all runs of 16 or more with a digit, and
all of 8 or more, digits or not, that stand right after "=" or after "=" or ":"
and a quote, however many a word of the text has. Each has features of its
length, its transitions between character classes, how much of it dictionary
words cover, the path of its document or the path it lies in, and the text
around it: the rest of its word and the words beside it, or, where its word has
more runs, what lies between them, divided at the first separator there is.

Nothing of this is a fixed word list. dictionary() takes the words of most
documents of the corpus. train() learns from labelled findings what words beside
a candidate, and what parts of a path, speak for or against a secret (smoothed
log odds of at most `known` words each, which are added up), and then fits the
forest.

findings() makes labelled findings from a seed in the engine: a bounded number
of lines with keys of several kinds and of the things that look like them
(digests, identifiers, numbers, addresses, compounds of dictionary words,
placeholders), in files of several paths. train() takes any table of texts with
one labelled candidate each.

Everything runs in the engine: candidates and features are array and string
functions on the row of the text, nothing is shuffled but the dictionary's
counts, and the forest (`trees` trees of depth at most `depth`) is the library's
own.

Defined results: null and blank texts have no finding; a text that repeats a
secret has a finding for each place; repeated rows have findings each; other
columns, of whatever names, are not read; an empty table gives no row.
"""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

from pyspark.ml.classification import RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import saved, words

KEYS = r"[A-Za-z0-9+/_=\-]"
FOUND = rf"(?:(?=[A-Za-z+/_=\-]*[0-9]){KEYS}{{16,}}|(?<=[=:][\"']){KEYS}{{8,}}|(?<==){KEYS}{{8,}})"
#: Texts without this have no candidate; assignments may have white space before the value.
SOME = rf"(?=[A-Za-z+/_=\-]*[0-9]){KEYS}{{16,}}|[=:]>?[\x20\x09-\x0D]*[\"']{KEYS}{{8,}}|=>?[\x20\x09-\x0D]*{KEYS}{{8,}}"
#: What divides fields inside a word.
FIELD = "[,;&|]"
FEATURES = ("length", "digits", "uppers", "transitions", "kinds", "distinct", "longest_run", "hexadecimal", "only_digits", "covered", "in_path", "dotted", "path_words", "near_words", "assigned", "quoted")


def candidates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", path_col: str | None = None) -> DataFrame:
    """doc_id, word_index, run_index (in the word), finding (the run), word, before, after and path, one row a candidate.

    A run that is alone in its word has the whole word, 3 words before and 2
    after. Of several runs each has the text up to its neighbours, so that all
    of them together hold no part of a word more than twice.
    """
    path = F.col(path_col).cast("string") if path_col else F.lit(None).cast("string")
    text = F.col(text_col).cast("string")
    rows = docs.where(text.rlike(SOME)).select(F.col(id_col).alias("doc_id"), path.alias("path"), words(text).alias("__w"))
    # a value after an assignment that ends the word before gets the sign back
    sign = lambda i: F.coalesce(F.regexp_extract(F.get(F.col("__w"), i - 1), r"[=:](?=>?$)", 0), F.lit(""))
    rows = rows.withColumn("__v", F.transform("__w", lambda w, i: F.concat(F.when(w.rlike("^[\"']"), sign(i)).otherwise(F.translate(sign(i), ":", "")), w)))
    at = F.filter(F.sequence(F.lit(0), F.size("__w") - 1), lambda i: F.get(F.col("__v"), i).rlike(FOUND))
    near = lambda i, lo, hi: F.concat_ws(" ", *[F.get(F.col("__w"), i + k) for k in range(lo, hi)])
    found = F.transform(at, lambda i: F.struct(i.alias("i"), F.get(F.col("__v"), i).alias("word"), near(i, -3, 0).alias("before"), near(i, 1, 3).alias("after")))
    rows = rows.select("doc_id", "path", F.explode(found).alias("__f")).select("doc_id", "path", F.col("__f.i").alias("word_index"), "__f.word", "__f.before", "__f.after")
    rows = rows.withColumn("__runs", F.regexp_extract_all("word", F.lit(FOUND), F.lit(0))).withColumn("__gaps", F.split("word", FOUND, -1))
    n = F.size("__runs")
    parts = F.transform(F.arrays_zip(F.col("__runs").alias("run"), F.slice("__gaps", F.lit(1), n).alias("left"), F.slice("__gaps", F.lit(2), n).alias("right")), lambda x, k: F.struct(x["run"].alias("run"), x["left"].alias("left"), x["right"].alias("right"), F.when(k == 0, F.col("before")).alias("before"), F.when(k == n - 1, F.col("after")).alias("after"), n.alias("n")))
    rows = rows.select("doc_id", "path", "word_index", F.posexplode(parts).alias("run_index", "__r"))
    run = F.col("__r")
    left = F.when(F.col("run_index") == 0, run["left"]).otherwise(F.regexp_replace(run["left"], f"(?s)^[^,;&|]*{FIELD}", ""))
    right = F.when(F.col("run_index") == run["n"] - 1, run["right"]).otherwise(F.regexp_extract(run["right"], "^[^,;&|]*", 0))
    before = F.when(run["n"] == 1, run["before"]).otherwise(F.concat_ws(" ", run["before"], left))
    return rows.select("doc_id", "path", "word_index", "run_index", F.concat(left, run["run"], right).alias("word"), before.alias("before"), F.coalesce(run["after"], F.lit("")).alias("after"), run["run"].alias("finding"))


def listed(items: Sequence[str]) -> Column:
    """The items, which have no spaces, as one constant array: the plan holds a literal, whatever their number."""
    return F.split(F.lit(" ".join(items)), " ") if items else F.array().cast("array<string>")


def letters(text: Column) -> Column:
    """The distinct runs of 2 or more letters, in lower case, joined words apart."""
    apart = F.regexp_replace(F.coalesce(text, F.lit("")), "([a-z])([A-Z])", "$1 $2")
    return F.array_distinct(F.regexp_extract_all(F.lower(apart), F.lit("[a-z]{2,}"), F.lit(0)))


def dictionary(docs: DataFrame, *, text_col: str = "text", size: int = 4096) -> list[str]:
    """The words of 3 to 20 letters that most documents have, at least two: counted over all documents, a bounded number kept."""
    word = F.explode(F.array_distinct(F.regexp_extract_all(F.lower(F.col(text_col).cast("string")), F.lit(r"(?<![\p{L}\d_])\p{L}{3,20}(?![\p{L}\d_])"), F.lit(0))))
    counted = docs.select(word.alias("word")).groupBy("word").count().where("count > 1")
    return sorted(r.word for r in counted.orderBy(F.desc("count"), "word").limit(size).collect())


class Knowledge(NamedTuple):
    """What features are made with: words of the corpus, and log odds of words beside findings and of parts of paths."""

    dictionary: list[str]
    near: dict[str, float]
    path: dict[str, float]


def _around(word: Column, finding: Column, before: Column, after: Column) -> Column:
    """The text around a finding without the finding."""
    at = F.instr(word, finding)
    return F.concat_ws(" ", before, F.substring(word, F.lit(1), at - 1), F.substring(word, at + F.length(finding), F.length(word)), after)


def _odds(around: Column, odds: dict[str, float]) -> Column:
    if not odds:
        return F.lit(0.0)
    table = F.str_to_map(F.lit(" ".join(f"{w}:{x!r}" for w, x in sorted(odds.items()))), F.lit(" "), F.lit(":"))
    known = F.array_intersect(letters(around), listed(sorted(odds)))
    return F.aggregate(known, F.lit(0.0), lambda a, w: a + F.coalesce(F.try_element_at(table, w).cast("double"), F.lit(0.0)))


def described(found: DataFrame, knowledge: Knowledge) -> DataFrame:
    """Candidates with the columns of FEATURES, all double."""
    core = F.col("finding")
    n = F.length(core).cast("double")
    gone = lambda pattern: F.length(core) - F.length(F.regexp_replace(core, pattern, ""))
    classes = F.regexp_replace(F.regexp_replace(F.regexp_replace(F.regexp_replace(core, "[^A-Za-z0-9]", "-"), "[0-9]", "0"), "[a-z]", "a"), "[A-Z]", "A")
    squeezed = F.length(F.regexp_replace(classes, r"(.)\1+", "$1"))
    has = lambda c, pattern: F.coalesce(c, F.lit("")).rlike(pattern).cast("double")
    runs = F.array_intersect(letters(core), listed(knowledge.dictionary))
    left = F.concat_ws(" ", "before", F.substring("word", F.lit(1), F.instr("word", core) - 1))
    out: dict[str, Column] = {
        "length": n,
        "digits": gone("[0-9]") / n,
        "uppers": gone("[A-Z]") / n,
        "transitions": (squeezed - 1) / n,
        "kinds": has(core, "[0-9]") + has(core, "[a-z]") + has(core, "[A-Z]") + has(core, "[^A-Za-z0-9]"),
        "distinct": F.size(F.array_distinct(F.split(core, ""))) / n,
        "longest_run": F.aggregate(F.split(core, "[^A-Za-z]+"), F.lit(0), lambda a, x: F.greatest(a, F.length(x))) / n,
        "hexadecimal": has(core, "^([0-9a-f]+|[0-9A-F]+)$"),
        "only_digits": has(core, "^[0-9]+$"),
        "covered": F.aggregate(runs, F.lit(0), lambda a, x: a + F.length(x)) / n,
        "in_path": has(F.col("word"), r"(://|^[./~]|/.*/|[a-z]+\.[a-z]{2,4}($|/))"),
        "dotted": has(F.col("word"), "[.@]"),
        "path_words": _odds(F.col("path"), knowledge.path),
        "near_words": _odds(_around(F.col("word"), core, F.col("before"), F.col("after")), knowledge.near),
        "assigned": has(left, r"[=:]>?\W*$"),
        "quoted": has(F.col("word"), "[\"']"),
    }
    return found.select("*", *(F.coalesce(c.cast("double"), F.lit(0.0)).alias(k) for k, c in out.items()))


def findings(spark: SparkSession, n: int = 4000, dictionary: Sequence[str] = ()) -> DataFrame:
    """doc_id, text, path and secret (0 or 1): n lines with one candidate each."""
    h = lambda salt: F.sha2(F.concat(F.col("id").cast("string"), F.lit(salt)), 256)
    base64 = lambda salt: F.translate(F.base64(F.unhex(h(salt))), "\n", "")
    r = lambda salt, k: F.pmod(F.xxhash64("id", F.lit(salt)), F.lit(k))
    made = lambda salt: F.translate(F.substring(h(salt), 1, 7), "0123456789abcdef", "etaoinshrdlucmfg")
    real = [w for w in dictionary if w.isascii() and len(w) > 3] or ["about", "entry", "model", "value"]
    known = lambda salt: F.element_at(listed(real), (r(salt, len(real)) + 1).cast("int"))
    word = lambda salt: F.when(r(salt + "k", 2) == 0, known(salt)).otherwise(made(salt))
    pick = lambda salt, *texts: F.element_at(F.array(*[F.lit(t) for t in texts]), (r(salt, len(texts)) + 1).cast("int"))
    mixed = F.concat(F.substring(base64("a"), 1, 20), F.substring(h("d"), 1, 4), F.substring(base64("b"), 1, 16))
    plain = F.regexp_replace(mixed, "[+/=0-9]", "K")
    keys = [F.substring(h("k"), 1, 40), F.substring(h("k"), 1, 32), F.concat(F.lit("AKIA"), F.upper(F.substring(h("k"), 1, 16))), F.concat(F.lit("ghp_"), F.regexp_replace(F.substring(mixed, 1, 36), "[+/=]", "x")), F.concat(F.lit("sk-"), F.regexp_replace(mixed, "[+/=]", "Q")), mixed, F.substring(plain, 1, 24), F.substring(mixed, 1, 10), F.substring(plain, 3, 12)]
    named = pick("n", "token", "secret", "api_key", "password", "auth_token", "TOKEN", "client_secret", "key")
    asked = pick("s", " = ", "=", " =", "= ")
    quote = pick("q", '"', "'", '"', "")
    key = F.element_at(F.array(*keys), (r("kind", len(keys)) + 1).cast("int"))
    secret = F.concat(named, asked, quote, key, quote, pick("z", "", "!!", "###", "&&&", ";"))
    digits = F.translate(F.substring(h("e"), 1, 16), "abcdef", "012345")
    plainly = pick("u", "title", "label", "path", "colour", "class", "lang", "name", "kind", "theme", "mode")
    other = [
        F.concat(pick("o", "commit ", "sha1 ", "digest: ", "checksum = ", "md5 ", "hash "), F.substring(h("k"), 1, 40)),
        F.concat(pick("p", "card ", "", "number ", "order "), digits, pick("z", "", "%%%", ".")),
        F.concat(pick("p", "id ", "uuid: ", ""), F.substring(h("f"), 1, 8), F.lit("-"), F.substring(h("g"), 1, 4), F.lit("-"), F.substring(h("g"), 5, 4), F.lit("-"), F.substring(h("g"), 9, 12)),
        F.concat(F.lit("https://"), made("w"), F.lit(".example.com/"), word("x"), F.lit("/"), F.substring(h("k"), 1, 24), F.lit(".html")),
        F.concat(word("w"), F.lit("_"), known("v"), F.lit("_"), known("x"), F.lit("_2"), word("y")),
        F.concat(named, asked, quote, pick("t", "EXAMPLE_TOKEN_0000000000", "xxxxxxxxxxxxxxxxxxxxxxx1", "your-api-key-goes-here-1", "0000000000000000000000000", "changeme-changeme", "placeholder"), quote),
        F.concat(word("w"), word("x"), word("y"), r("d", 90).cast("string"), F.lit("@mail"), r("e", 9).cast("string"), F.lit(".example.com")),
        F.concat(pick("p", "see ", "page ", ""), F.lit("/usr/share/"), word("w"), F.lit("/file-"), r("d", 90).cast("string"), F.lit("/"), word("x")),
        F.concat(plainly, asked, quote, known("v"), pick("t", "-", "_", ""), known("x"), pick("y", "-", "_", ""), known("w"), quote),
        F.concat(plainly, asked, quote, known("v"), pick("t", "-", "_"), known("x"), quote),
    ]
    is_secret = r("side", 2) == 1
    line = F.when(is_secret, secret).otherwise(F.element_at(F.array(*other), (r("what", len(other)) + 1).cast("int")))
    text = F.concat_ws(" ", word("1"), word("2"), word("3"), line, word("4"), word("5"))
    folder = F.when(is_secret, pick("f", "src", "config", "deploy", "src", "tests")).otherwise(pick("f", "src", "docs", "tests", "examples", "fixtures"))
    path = F.when(r("nopath", 3) > 0, F.concat(folder, F.lit("/"), word("p"), F.lit("."), pick("e", "py", "env", "yml", "md", "json")))
    return spark.range(0, n, 1, 2).select(F.col("id").alias("doc_id"), text.alias("text"), path.alias("path"), is_secret.cast("double").alias("secret"))


def learnt_odds(rows: DataFrame, text: Column, known: int) -> dict[str, float]:
    """Smoothed log odds of the words of a text of rows (secret), of those seen in 8 rows at least, the most telling first."""
    seen = rows.select("secret", F.explode(letters(text)).alias("word")).groupBy("word").agg(F.sum("secret").alias("yes"), F.count(F.lit(1)).alias("n")).where("n >= 8")
    odds = F.round(F.log((F.col("yes") + 1) / (F.col("n") - F.col("yes") + 1)), 6)
    return {r.word: r.odds for r in seen.select("word", "n", odds.alias("odds")).orderBy(F.desc(F.abs("odds") * F.sqrt("n")), "word").limit(known).collect()}


class Scanner(NamedTuple):
    forest: RandomForestClassificationModel
    knowledge: Knowledge


def _vectors(found: DataFrame, knowledge: Knowledge) -> DataFrame:
    return VectorAssembler(inputCols=list(FEATURES), outputCol="__features").transform(described(found, knowledge))


def train(labelled: DataFrame, dictionary: Sequence[str] = (), *, trees: int = 24, depth: int = 7, seed: int = 11, known: int = 128) -> Scanner:
    """The scanner of labelled (doc_id, text, secret, and path if there is one)."""
    path = "path" if "path" in labelled.columns else None
    labelled = saved(labelled.select("doc_id", "text", "secret", *([path] if path else [])), "secret-labels")
    rows = saved(candidates(labelled, path_col=path).join(labelled.select("doc_id", F.col("secret").cast("double").alias("secret")), "doc_id"), "secret-findings")
    around = _around(F.col("word"), F.col("finding"), F.col("before"), F.col("after"))
    knowledge = Knowledge(list(dictionary), learnt_odds(rows, around, known), learnt_odds(rows, F.col("path"), known))
    forest = RandomForestClassifier(featuresCol="__features", labelCol="secret", numTrees=trees, maxDepth=depth, seed=seed, maxBins=32)
    made = saved(described(rows, knowledge).select(*FEATURES, "secret"), "secret-features")
    return Scanner(forest.fit(VectorAssembler(inputCols=list(FEATURES), outputCol="__features").transform(made)), knowledge)


def scan(docs: DataFrame, scanner: Scanner, *, id_col: str = "doc_id", text_col: str = "text", path_col: str | None = None, threshold: float = 0.5) -> DataFrame:
    """doc_id, word_index, run_index, finding, probability and secret for each candidate of each text."""
    scored = scanner.forest.transform(_vectors(candidates(docs, id_col=id_col, text_col=text_col, path_col=path_col), scanner.knowledge))
    scored = scored.withColumn("probability", F.round(F.get(vector_to_array("probability"), F.lit(1)), 6))
    return scored.select("doc_id", "word_index", "run_index", "finding", "probability", (F.col("probability") >= threshold).alias("secret"))
