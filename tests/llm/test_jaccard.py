"""The Jaccard join against brute force."""

import random
import re

import numpy as np
import pytest

from barwright.llm import jaccard, shingles


def brute(rows):
    """doc_id -> (size, least doc_id of its component)."""
    sets = {}
    for doc_id, text in rows:
        words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        sets[doc_id] = {tuple(words[i : i + 5]) for i in range(len(words) - 4)} if len(words) >= 5 else {tuple(words)} if words else set()
    root = {k: k for k in sets}

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            x, y = sets[a], sets[b]
            if x and y and 4 * min(len(x), len(y)) >= 3 * max(len(x), len(y)) and 100 * len(x & y) >= 75 * len(x | y):
                p, q = find(a), find(b)
                root[max(p, q)] = min(p, q)
    return {k: (len(sets[k]), find(k)) for k in ids}


def corpus(seed=1, n=170):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdeé") for _ in range(rng.randint(1, 7)))
    passage = [word() for _ in range(60)]
    base = [word() for _ in range(120)]
    rows, bases = [], []
    for i in range(n):
        kind = rng.random()
        if kind < 0.25 or not bases:
            words = [word() for _ in range(rng.choice([1, 3, 5, 6, 9, 30, 90, 300]))]
            bases.append(words)
        elif kind < 0.5:  # near copies around the threshold
            words = list(rng.choice(bases))
            for _ in range(rng.randint(0, max(1, len(words) // 25))):
                words[rng.randrange(len(words))] = word()
        elif kind < 0.7:  # a frequent passage and little else
            words = [word() for _ in range(rng.randint(0, 20))] + passage + [word() for _ in range(rng.randint(0, 20))]
        else:  # one large family
            words = list(base)
            for _ in range(rng.randint(0, 5)):
                words[rng.randrange(len(words))] = word()
            words = words[: rng.randint(85, 120)]
        text = " ".join(words)
        rows.append((i, text.upper() if i % 17 == 0 and text.isascii() else text))
    return rows + [(n, None), (n + 1, ""), (n + 2, " \n\t "), (n + 3, rows[0][1])]


@pytest.mark.parametrize(
    ("seed", "limits"),
    [
        (1, {"small": 5}),
        (2, {"small": 2, "hot": 4, "chunk": 4, "held": 300, "seen": 3, "rounds": 2}),
        (3, {"small": 3, "hot": 200, "chunk": 8, "broadcast": 1, "block": 100, "rounds": 1}),
    ],
)
def test_join_is_exact(spark, seed, limits):
    """Small limits, so that large signatures, thin and unsafe sets, several blocks and shuffled texts appear on few rows."""
    rows = corpus(seed)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.join(spark.createDataFrame(rows, "doc_id long, text string"), limits=jaccard.Limits(**limits)).collect()}
    want = brute(rows)
    assert got == want
    assert len({c for _, c in want.values()}) < len(rows) - 20


def test_small_sets_share_a_signature():
    """All pairs of similar sets of up to 16 elements, with and without hot signatures, meet in one signature or are unsafe."""
    rng = np.random.default_rng(5)
    for n in list(range(3, 17)) * 40:
        x = rng.integers(1 << 63, size=n).astype(np.uint64)
        lost = rng.integers(0, n // 7 + 2)
        more = rng.integers(1 << 63, size=rng.integers(0, n // 3 + 1)).astype(np.uint64)
        x, y = np.unique(x), np.unique(np.concatenate([x[lost:], more]))
        both = len(np.intersect1d(x, y))
        if 100 * both < 75 * len(np.union1d(x, y)) or len(x) == len(y) == both:
            continue
        hot = np.zeros(0, np.uint64)
        for _ in range(3):
            (a, lost_a), (b, lost_b) = (jaccard.signatures(e, hot) for e in (x, y))
            assert (lost_a and lost_b) or len(np.intersect1d(a, b))
            hot = np.sort(np.concatenate([hot, rng.choice(a, len(a) // 2, replace=False)]))


def test_very_long_texts_are_read_in_windows(spark):
    """Sets of long texts and long words don't depend on where windows cut them."""
    text = "lorem ipsum " * 60_000 + "x" * 700_000 + " end of it all"
    short = " ".join(text.split())
    assert all(np.array_equal(a, b) for a, b in [list(shingles.shingle_sets([text, short]))])
    out = jaccard.join(spark.createDataFrame([(1, text), (2, short), (3, "other words than these here")], "doc_id long, text string")).collect()
    assert sorted(map(tuple, out)) == [(1, 7, 1), (2, 7, 1), (3, 1, 3)]


def test_nulls_repeats_and_clashing_columns(spark):
    rows = [(None, "a b c d e f", 1), (3, "a b c d e f", 2), (3, "a b c d e f", 2), (4, None, 3), (5, "x", 4), (6, "x", 4)]
    out = jaccard.join(spark.createDataFrame(rows, "doc_id long, text string, component_id int")).collect()
    assert sorted((r.doc_id or -1, r.component_id or -1, r.n_shingles) for r in out) == [(-1, -1, 2), (3, -1, 2), (3, -1, 2), (4, 4, 0), (5, 5, 1), (6, 5, 1)]
    assert jaccard.join(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_distinct_keeps_one_row_of_each_component(spark):
    rows = [(3, "zz", "a"), (3, "yy", "b"), (1, "yy", "c"), (5, "a b c d e f", "d"), (5, "a b c d e f", "e"), (None, "q", "f"), (None, "q", "g"), (None, "r", "h"), (7, None, "i"), (7, "", "j")]
    table = spark.createDataFrame(rows, "doc_id long, text string, first string")
    left = jaccard.distinct(table)
    assert left.columns == table.columns
    got = sorted(left.collect(), key=str)
    assert sorted((r.doc_id or 0, r.text or "") for r in got) == [(0, "q"), (0, "r"), (1, "yy"), (3, "zz"), (5, "a b c d e f"), (7, ""), (7, "")]
    assert jaccard.distinct(table.limit(0)).count() == 0


def test_sketch_is_a_lower_bound():
    texts = [t for _, t in corpus(3, 60)]
    sets = list(shingles.shingle_sets(texts))
    for x in sets:
        for y in sets:
            assert jaccard.differ_at_least(jaccard.sketch(x), jaccard.sketch(y)) <= len(set(x) ^ set(y))
