"""Conversation repair against a search over all edits, at several sizes of piece and block, and on awkward rows."""

import collections
import hashlib
import heapq
import random
import zlib

import pytest
from pyspark.sql import functions as F

from barwright.llm import conversations, queries

SPACE = " \t\n\x0b\x0c\r"
SCHEMA = "conv_id long, turn long, role string, text string, row int, key string, piece int"


def damaged(rows):
    out = []
    for conv, turn, role, text in rows:
        named = lambda x: " " if x is None else str(x)
        kind = zlib.crc32(f"{named(conv)}:{named(turn)}".encode()) % 20
        role, text = named(role), named(text)
        if kind == 1:
            text = ""
        if kind == 2:
            text = text.translate({ord(c): None for c in ".!?"})
        if kind == 4:
            role = "user"
        out += [(conv, turn, role, text)] * (0 if kind == 0 else 2 if kind == 3 else 1)
    return out


def brute(rows):
    """Counts, cost, audit and repaired lines of one conversation: a queue of audits by cost and ASCII."""
    rows = sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, r[2], r[3][:64], hashlib.sha256(r[3].encode()).hexdigest()))
    turns = [r[1] for r in rows if r[1] is not None]
    told = collections.Counter(gaps=max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0)
    faults, seen = [], set()
    for _, _, role, text in rows:
        bare = text.rstrip(SPACE)
        fault = "blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else None
        seen.add((role, text))
        told[fault] += 1
        faults.append(fault)
    told["illegal"] = sum(a[2][:1] + b[2][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:], strict=False))
    fits = lambda s, end: (t := s.removeprefix("s")) == ("ua" * len(t))[: len(t)] and (not end or s == "" or len(t) % 2 == 0 and t)
    queue, done = [(0, "", 0, "", ())], set()
    while queue:
        cost, audit, k, roles, lines = heapq.heappop(queue)
        if k == len(rows) and fits(roles, True):
            return told, cost, audit, "\n".join(lines)
        state = (k, len(roles) % 2 if roles[:1] != "s" else 2 + len(roles) % 2, len(roles) < 2 and roles)
        if state in done:
            continue
        done.add(state)
        offer = lambda c, a, n, name, line: fits(roles + name, False) and heapq.heappush(queue, (cost + c, audit + a, k + n, roles + name, lines + line))
        for name in ("user", "assistant"):
            offer(3, "I", 0, name[0], (f"{name}:",))
        if k < len(rows):
            offer(4, "D", 1, "", ())
            if faults[k] not in ("blank", "duplicate"):
                more = 3 * (faults[k] == "truncated")
                if rows[k][2][:1] in "sua" and rows[k][2]:
                    offer(more, "K", 1, rows[k][2][0], (f"{rows[k][2]}:{rows[k][3]}",))
                for name in ("user", "assistant"):
                    offer(3 + more, "R", 1, name[0], (f"{name}:{rows[k][3]}",))
    raise AssertionError


def some_rows(seed, conversations_, longest):
    some = random.Random(seed)
    texts = ["Yes.", "Yes.", "No!", "cut off", "", " \n", "Well? ", "x" * 70 + ".", "x" * 70 + "y.", None, "ü?"]
    rows = []
    for c in range(conversations_):
        for _ in range(some.randint(0, longest)):
            rows.append((c if c else None, some.choice([None, *range(longest)]), some.choice(["user", "assistant", "user", "assistant", "system", "tool", None, ""]), some.choice(texts) if some.random() < 0.5 else f"Text {some.random()}" + some.choice(". !x")))
    return rows


@pytest.mark.parametrize(("piece", "fan", "count", "longest"), [(1024, 512, 60, 9), (2, 3, 12, 25)])
def test_repair(spark, piece, fan, count, longest):
    rows = damaged(some_rows(piece * 7 + fan, count, longest))
    random.Random(1).shuffle(rows)
    frame = spark.createDataFrame([(*r, 1, "k", 2) for r in rows], SCHEMA).repartition(3)
    found = conversations.repair(frame, piece_rows=piece, fan=fan)
    lines = collections.defaultdict(list)
    for r in sorted(found.rows.collect(), key=lambda r: (r.row, r.place)):
        lines[r.conv_id].append(f"{r.role}:{r.text}")
    by = collections.defaultdict(list)
    for r in rows:
        by[r[0]].append(r)
    hashes = {r.key: r.sha256 for r in conversations.hashed(found.rows).collect()}
    got = {r.conv_id: r for r in found.audits.collect()}
    assert set(got) == set(by)
    for c, own in by.items():
        told, cost, audit, text = brute(own)
        r = got[c]
        assert (r.cost, r.audit) == (cost, audit)
        assert "\n".join(lines[c]) == text
        assert hashes.get(r.key, hashlib.sha256(b"").hexdigest()) == hashlib.sha256(text.encode()).hexdigest()
        assert [r[k] for k in ("gaps", "blank", "duplicate", "truncated", "illegal")] == [told[k] for k in ("gaps", "blank", "duplicate", "truncated", "illegal")]


def test_damage(spark):
    rows = some_rows(5, 40, 9)
    got = conversations.damage(spark.createDataFrame([(*r, 1, "k", 2) for r in rows], SCHEMA)).select(*conversations.COLUMNS).collect()
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, damaged(rows)))


def test_query_keeps_conversations_that_lose_all_rows(spark, tmp_path):
    gone = next(c for c in range(1000) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    path = str(tmp_path / "conversations.parquet")
    spark.createDataFrame([(gone, 0, "user", "Hello."), (gone, 0, "user", "Hello.")], "conv_id long, turn long, role string, text string").write.parquet(path)
    (row,) = queries.op11_conversation_repair(spark, str(tmp_path)).collect()
    assert row.asDict() == {"conv_id": gone, **dict.fromkeys(("gaps", "blank", "duplicate", "truncated", "illegal", "cost"), 0), "audit": "", "repaired_sha256": hashlib.sha256(b"").hexdigest()}


def test_empty_and_long(spark):
    none = conversations.repair(spark.createDataFrame([], SCHEMA))
    assert none.audits.count() == 0 and none.rows.count() == 0
    one = spark.createDataFrame([(1, 1, "user", "word " * 200_000 + ".", 1, "k", 2)], SCHEMA)
    found = conversations.repair(one.union(one))
    assert [(r.cost, r.audit) for r in found.audits.collect()] == [(7, "KDI")] and found.rows.agg(F.max(F.length("text"))).first()[0] == 1_000_001
