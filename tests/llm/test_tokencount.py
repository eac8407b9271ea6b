"""The automaton against greedy longest match."""

import random
import time

from public_tokenizers import path

from barwright.llm import tokencount


def greedy(pieces, word):
    start, inner = {p for s, p in pieces if s}, {p for s, p in pieces if not s}
    n, at = 0, 0
    while at < len(word):
        table = start if at == 0 else inner
        k = next((k for k in range(len(word), at, -1) if word[at:k] in table), None)
        if k is None and at == 0:
            k = next((k for k in range(len(word), at, -1) if word[at:k] in inner), None)
        n, at = n + 1, k or at + 1
    return n


def test_automaton_equals_greedy_on_small_vocabularies():
    rng = random.Random(5)
    for _ in range(150):
        pieces = {(rng.random() < 0.4, bytes(rng.choice(b"abc") for _ in range(rng.randint(1, 5)))) for _ in range(rng.randint(1, 14))}
        words = [bytes(rng.choice(b"abcd") for _ in range(rng.randint(1, 12))) for _ in range(60)]
        got = tokencount.Automaton(sorted(pieces)).count(words).tolist()
        assert got == [greedy(pieces, w) for w in words], pieces


def test_public_vocabulary(spark):
    vocabulary = path("byte_bpe_50k.json")
    pieces = tokencount.byte_level(vocabulary)
    docs = [(1, "The whole text, in words\nand Wörter 日本 12345"), (2, None), (3, " \t\n"), (4, "a" * 5000), (4, "a" * 5000)]
    out = tokencount.count(spark.createDataFrame(docs, "doc_id long, text string"), vocabulary=vocabulary).collect()
    table = set(pieces)
    want = sorted((i, len((t or "").encode().split()), sum(greedy(table, w) for w in (t or "").encode().split())) for i, t in docs)
    assert sorted(map(tuple, out)) == want


def test_long_words_run_alone(spark, monkeypatch):
    rng = random.Random(6)
    pieces = sorted({(rng.random() < 0.4, bytes(rng.choice(b"abc") for _ in range(rng.randint(1, 5)))) for _ in range(12)})
    words = [bytes(rng.choice(b"abcd") for _ in range(rng.randint(1, 40))) for _ in range(200)]
    machine = tokencount.Automaton(pieces)
    want = [greedy(pieces, w) for w in words]
    assert [machine.count_long(w) for w in words] == want
    monkeypatch.setattr(tokencount, "LONG", 9)
    assert machine.count(words).tolist() == want
    text = "".join(rng.choice("abcdefgh") for _ in range(200_000))
    begun = time.perf_counter()
    assert tokencount.automaton(path("byte_bpe_50k.json")).count_long(text.encode()) > 0
    assert time.perf_counter() - begun < 20
    out = tokencount.count(spark.createDataFrame([(1, text, 7)], "doc_id long, text string, n_tokens int"), vocabulary=path("byte_bpe_50k.json")).first()
    assert out.n_words == 1 and out.n_tokens == tokencount.automaton(path("byte_bpe_50k.json")).count_long(text.encode())
