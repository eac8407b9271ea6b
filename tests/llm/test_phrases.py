"""Phrase mining against a loop over all sequences with Python's whole numbers."""

import collections
import random
import re

import pytest

from barwright.llm import phrases
from barwright.llm.common import hot_join

SCHEMA = "doc_id long, text string, lang string, phrase string, score int, f long, n string"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(rows, most, least, top):
    f, n = collections.Counter(), collections.Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(LOWER)):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            for size in range(1, most + 1):
                for i in range(len(w) - size + 1):
                    f[lang, tuple(w[i : i + size])] += 1
    found = collections.defaultdict(list)
    strong = {k: a for k, a in f.items() if len(k[1]) > 1 and a >= least}
    held = {(lang, w[i : i + s], a) for (lang, w), a in strong.items() for s in range(2, len(w)) for i in range(len(w) - s + 1)}
    for (lang, w), a in strong.items():
        if (lang, w, a) not in held:
            cuts = [(1000 * a * n[lang] // (f[lang, w[:k]] * f[lang, w[k:]]), k, f[lang, w[:k]], f[lang, w[k:]]) for k in range(1, len(w))]
            score, _, l, r = min(cuts)
            found[lang].append((-score, -a, " ".join(w).encode(), l, r))
    return [(lang, i + 1, p.decode(), -a, l, r, n[lang], -s) for lang, v in found.items() for i, (s, a, p, l, r) in enumerate(sorted(v)[:top])]


@pytest.mark.parametrize(("seed", "most", "least", "top", "pairs"), [(1, 5, 4, 2000, 1 << 20), (2, 4, 3, 5, 0)])
def test_mine(spark, seed, most, least, top, pairs):
    some = random.Random(seed)
    vocabulary = ["the", "The", "été", "ÉTÉ", "in", "of", "a", "new-york", "it's", " x", "zz"]
    rows = [("".join(some.choice(vocabulary) + some.choice([" ", " ", " ", "\t ", ". ", "\n", ",", "! "]) for _ in range(some.randint(0, 40))), some.choice(["en", "fr", None, "und"])) for _ in range(60)]
    rows += [("one two three four five six", "en")] * 7 + [(None, "en"), ("", None), (" .,\n", "fr"), ("a a a a a a a", "de")] + [("of the " * 500, "en")]
    docs = spark.createDataFrame([(i % 7 if i % 3 else None, t, lang, "mine", 1, 2, "n") for i, (t, lang) in enumerate(rows)], SCHEMA)
    got = [tuple(r) for r in phrases.mine(docs, max_words=most, min_count=least, top=top, broadcast_pairs=pairs).collect()]
    assert sorted(got) == sorted(brute(rows, most, least, top)) and got


def test_exact_beyond_64_bits(spark):
    total = spark.createDataFrame([("en", 9_000_000_000_000)], "lang string, n long")
    counted = spark.createDataFrame([("en", 1, "a", 4_000_000_000_001), ("en", 1, "b", 3_000_000_000_000), ("en", 2, "a b", 2_999_999_999_999)], "lang string, words int, phrase string, f long")
    assert [r.score for r in phrases.scored(total, counted).collect()] == [1000 * 2_999_999_999_999 * 9_000_000_000_000 // (4_000_000_000_001 * 3_000_000_000_000)]


def test_empty(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert phrases.mine(none).count() == 0
    assert phrases.mine(spark.createDataFrame([(1, None, None, None, None, None, None)], SCHEMA), min_count=1).count() == 0


def test_hot_join(spark):
    left = spark.range(3000).selectExpr("id", "if(id % 3 = 0, 0, id % 50) as k").persist()
    right = spark.range(0, 40).selectExpr("id as k", "id * 10 as v")
    got = {(r.id, r.k, r.v) for r in hot_join(left, right, ["k"], share=10).collect()}
    assert got == {(i, k, k * 10 if k < 40 else None) for i in range(3000) for k in [0 if i % 3 == 0 else i % 50]}
