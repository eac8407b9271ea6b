"""Benchmark decontamination against a loop over all windows, by broadcast and by shuffle, and on awkward rows."""

import hashlib
import re

import pytest

from barwright.llm import decontaminate

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SCHEMA = "doc_id long, text string, row int, hits string, n_words int, item_id string"


def words(text):
    return WORD.findall((text or "").translate(LOWER))


def brute(text, items, n):
    own = words(text)
    hit, held = set(), set()
    for item, other in items:
        w = words(other)
        size = min(n, len(w))
        for at in range(len(w) - size + 1 if size else 0):
            for i in range(len(own) - size + 1):
                if own[i : i + size] == w[at : at + size]:
                    hit |= set(range(i, i + size))
                    held.add("" if item is None else str(item))
    return len(own), sorted(hit), sorted(held)


ITEMS = [(1, "The quick brown fox jumps over the lazy dog."), (2, "Été à l'ÉTÉ, one two"), (3, None), (4, " ,.; "), (5, "jumps over the lazy dog and runs away"), (None, "lone word here"), (10, "lone word here"), (6, "a b a b a b")]
TEXTS = [None, "", " \n", "THE QUICK-BROWN fox; jumps over the lazy dog!", "x a b a b a b a b y", "été à l ÉTÉ one two Été à l'ÉTÉ one two", "He said: the quick brown fox jumps over nothing", "a\x00b a b", "lone  word\there lone word here", "nothing at all", "b a " * 3000, "wort " * 20000 + "lone word here"]


@pytest.mark.parametrize(("n", "limit"), [(4, 1 << 26), (3, 0)])
def test_scan(spark, n, limit):
    texts = [*TEXTS, *[" ".join(["fox jumps over the lazy dog and runs"][0].split()[i % 4 :] * (i % 3)) for i in range(30)]]
    docs = spark.createDataFrame([(i % 11 if i % 5 else None, t, i, "mine", 7, "x") for i, t in enumerate(texts)] * 2, SCHEMA)
    bench = spark.createDataFrame(ITEMS, "item_id long, text string")
    found = decontaminate.windows(bench, n, broadcast_bytes=limit)
    assert found.small == (limit > 0)
    told = decontaminate.scan(docs, found).collect()
    got = [(r.doc_id, r.n_words, [k for a, b in r.spans for k in range(a, b)], r["items"], r.n_hit) for r in told]
    assert all(r.spans == sorted(r.spans) and all(a.end < b.start for a, b in zip(r.spans, r.spans[1:], strict=False)) for r in told)
    want = []
    for i, t in enumerate(texts):
        count, hit, held = brute(t, ITEMS, n) if len(t or "") < 5000 else brute_long(t, n)
        want.append((i % 11 if i % 5 else None, count, hit, held, len(hit)))
    key = repr
    assert sorted(got, key=key) == sorted(want * 2, key=key)


def brute_long(text, n):
    own, hit, held = words(text), set(), set()
    at = {}
    for item, other in ITEMS:
        w = words(other)
        size = min(n, len(w))
        for k in range(len(w) - size + 1 if size else 0):
            at.setdefault((size, tuple(w[k : k + size])), set()).add("" if item is None else str(item))
    for size in {s for s, _ in at}:
        for i in range(len(own) - size + 1):
            if names := at.get((size, tuple(own[i : i + size]))):
                hit |= set(range(i, i + size))
                held |= names
    return len(own), sorted(hit), sorted(held)


def test_clean(spark):
    docs = spark.createDataFrame([(1, "Say: The quick, brown fox... then go", 1, "h", 2, "i"), (2, None, 2, None, None, None), (None, "Nothing here", 3, "h", 2, "i"), (1, "the quick brown fox", 4, "h", 2, "i")], SCHEMA)
    found = decontaminate.windows(spark.createDataFrame([(1, "the quick brown fox")], "item_id long, text string"), 4)
    cut = {r.row: r for r in decontaminate.clean(docs, found).collect()}
    assert decontaminate.clean(docs, found).columns == docs.columns
    assert [cut[k].text for k in (1, 2, 3, 4)] == ["Say: ... then go", None, "Nothing here", ""]
    assert [cut[1].hits, cut[1].n_words, cut[1].item_id, cut[1].doc_id] == ["h", 2, "i", 1]
    assert sorted(r.row for r in decontaminate.clean(docs, found, remove="documents").collect()) == [2, 3]
    with pytest.raises(ValueError, match="remove"):
        decontaminate.clean(docs, found, remove="words")


def test_empty_tables(spark):
    docs, bench = spark.createDataFrame([(1, "a b c", 1, "", 1, "")], SCHEMA), spark.createDataFrame([], "item_id long, text string")
    none = decontaminate.windows(bench)
    assert [(r.doc_id, r.n_words, r.n_hit, r["items"]) for r in decontaminate.scan(docs, none).collect()] == [(1, 3, 0, [])]
    assert decontaminate.scan(docs.limit(0), none).count() == 0 and decontaminate.clean(docs, none).collect() == docs.collect()
    assert hashlib.sha256(b"").hexdigest().startswith("e3b0")
