"""Conversation structure repair by signature deduplication.

A conversation's rows are taken by turn. Each gets its first fault (blank,
duplicate, truncated) and a letter for its role and fault; the letters of up to
`piece_rows` neighbouring rows are a piece's signature. Every distinct signature
is solved once: the cheapest edits, of equal ones the least in ASCII, from each
state of the grammar `(s?(ua)+)?` to each other, by recursion over halves with a
memo of the short ones. Solutions are joined back to the pieces and replayed on
the rows.

Order: rows are range-partitioned by conversation, turn, role and text, and
numbered there; no window holds a conversation. A conversation of any length is
a list of pieces. What its later pieces cost from each state, and then the state
in which each piece begins, are carried over the pieces as products of 4 by 4
tables in blocks of `fan` pieces, level by level; one of a single piece, as
most are, needs none of that. Duplicates are told by the least row number of a
(conversation, role, digest), summed before it moves.

hashed() reads the repaired rows of a conversation in order, a batch at a time:
SHA-256 is a chain, so that pass is one task for a conversation, in constant
memory; all else splits conversations.

Defined results: null ids and turns are values of their own (a null turn comes
first), a null role or text is one space; rows of the same turn go by role, the
text's first 64 characters and its SHA-256, and rows alike in all follow each
other, all but the first duplicates; roles count by their first character, and
other than s, u and a must be edited; very long texts are hashed once and moved
whole; an empty table gives no row; other columns are not read.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE_CHARS, hot_join, saved, small_batches

COLUMNS = ["conv_id", "turn", "role", "text"]
#: States of the grammar: nothing yet, after s, after u, after a; and the state after one more role (u, u, a, u).
NEXT = (2, 2, 3, 2)
ROLE_OF = {1: "s", 2: "u", 3: "a"}
#: Steps that end a conversation in each state, with their cost.
ENDINGS = ((0, ""), (6, "IuIa"), (3, "Ia"), (0, ""))
NEVER = 1 << 40


def damage(conversations: DataFrame) -> DataFrame:
    """Rows with faults put in by the checksum of `conv_id:turn`, as the operator's query takes them."""
    text_of = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    rows = conversations.select("conv_id", "turn", text_of("role").alias("role"), text_of("text").alias("text"), (F.crc32(F.concat(text_of("conv_id"), F.lit(":"), text_of("turn")).cast("binary")) % 20).alias("kind")).where("kind != 0")
    text = F.when(F.col("kind") == 1, F.lit("")).when(F.col("kind") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    role = F.when(F.col("kind") == 4, F.lit("user")).otherwise(F.col("role"))
    return rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), F.explode(F.array_repeat(F.lit(0), F.when(F.col("kind") == 3, 2).otherwise(1))).alias("copy")).drop("copy")


def key_of(conv_id: Column) -> Column:
    return F.when(conv_id.isNull(), F.lit("null")).otherwise(F.concat(F.lit(":"), conv_id.cast("string")))


def ordered(conversations: DataFrame) -> DataFrame:
    """Rows with their conversation's key and a number `row` from 0, rising in the order that repair() takes them, written."""
    text_of = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(c)
    rows = conversations.select("conv_id", "turn", text_of("role"), text_of("text"))
    rows = rows.select(key_of(F.col("conv_id")).alias("key"), "*", F.substring("text", 1, 64).alias("head"), F.sha2(F.col("text").cast("binary"), 256).alias("digest"), F.monotonically_increasing_id().alias("tie"))
    order = ["key", "turn", "role", "head", "digest", "tie"]
    rows = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    rows = saved(rows.select("key", "conv_id", "turn", "role", "text", "digest", F.monotonically_increasing_id().alias("id")), "conversation-rows")
    # ids are gapless within a task; one count for each task makes them so over all
    part = F.shiftright("id", 33)
    counted = sorted(rows.groupBy(part.alias("part")).count().collect())
    before = np.cumsum([0] + [n for _, n in counted])
    parts = rows.sparkSession.createDataFrame([(p, int(b)) for (p, _), b in zip(counted, before, strict=False)], "part long, before long")
    return rows.withColumn("part", part).join(F.broadcast(parts), "part").select("key", *COLUMNS, "digest", (F.col("before") + F.col("id").bitwiseAND((1 << 33) - 1)).alias("row"))


def with_faults(rows: DataFrame) -> DataFrame:
    """Narrow rows: key, conv_id, turn, row, initial, fault (blank, duplicate, truncated or null) and letter."""
    firsts = rows.groupBy("key", "role", "digest").agg(F.min("row").alias("row")).select("row", F.lit(True).alias("is_first"))
    end = F.rtrim(F.col("text"), F.lit(SPACE_CHARS))
    narrow = rows.select("key", "conv_id", "turn", "row", F.substring("role", 1, 1).alias("initial"), (end == "").alias("blank"), (~F.substring(end, -1, 1).isin(".", "!", "?")).alias("truncated"))
    narrow = narrow.join(firsts, "row", "left")
    fault = F.when(F.col("blank"), "blank").when(F.col("is_first").isNull(), "duplicate").when(F.col("truncated"), "truncated")
    kind = F.when(F.col("initial").isin("s", "u", "a"), F.col("initial")).otherwise("o")
    letter = F.when(F.col("fault").isin("blank", "duplicate"), "d").when(F.col("fault") == "truncated", F.upper(kind)).otherwise(kind)
    return narrow.withColumn("fault", fault).select("key", "conv_id", "turn", "row", "initial", "fault", letter.alias("letter"))


def pieces(rows: DataFrame, piece_rows: int) -> DataFrame:
    """key, conv_id, piece, first_row, signature, and what is counted within the piece, written."""
    told = rows.groupBy("key", "conv_id", F.floor(F.col("row") / piece_rows).alias("piece")).agg(
        F.sort_array(F.collect_list(F.struct("row", "letter", "initial", "turn"))).alias("rows"),
        *[F.count_if(F.col("fault") == f).alias(f) for f in ("blank", "duplicate", "truncated")],
        F.min("turn").alias("least_turn"),
        F.max("turn").alias("most_turn"),
    )
    pair = F.transform("rows", lambda x, i: F.when(i > 0, F.concat(F.get(F.col("rows"), i - 1)["initial"], x["initial"])))
    at = lambda k, c: F.element_at("rows", k)[c]
    return saved(
        told.select(
            "key", "conv_id", "piece", "blank", "duplicate", "truncated", "least_turn", "most_turn",
            F.array_join(F.transform("rows", lambda x: x["letter"]), "").alias("signature"),
            at(1, "row").alias("first_row"), F.size("rows").alias("n_rows"),
            F.size(F.filter(pair, lambda x: ~x.isin("su", "ua", "au"))).cast("long").alias("illegal"),
            F.size(F.array_distinct(F.filter(F.transform("rows", lambda x: x["turn"]), lambda x: x.isNotNull()))).cast("long").alias("turns"),
            *[at(k, c).alias(f"{name}_{c}") for k, name in ((1, "first"), (-1, "last")) for c in ("turn", "initial")],
        ),
        "conversation-pieces",
    )


def _of_row(letter: str) -> list[tuple[int, str]]:
    """Cost and steps of one row from each state to each other (4 i + j), as `solve` has them for a signature."""
    best = [(NEVER, "")] * 16
    kind, extra = letter.lower(), 3 if letter.isupper() else 0
    for begin in range(4):
        for lead in ("", "I"):
            at = NEXT[begin] if lead else begin
            cost, steps = (3, "I" + ROLE_OF[at]) if lead else (0, "")
            offers = [(at, cost + 4, steps + "D-")]
            if letter != "d":
                to = NEXT[at]
                offers.append((to, cost + 3 + extra, steps + "R" + ROLE_OF[to]))
                if kind == ROLE_OF[to]:
                    offers.append((to, cost + extra, steps + "K" + kind))
                if kind == "s" and at == 0:
                    offers.append((1, cost + extra, steps + "Ks"))
            for to, c, s in offers:
                best[4 * begin + to] = min(best[4 * begin + to], (c, s + " "))
    return best


def _of_two(left: list[tuple[int, str]], right: list[tuple[int, str]]) -> list[tuple[int, str]]:
    out = []
    for i in range(4):
        for j in range(4):
            least = min(left[4 * i + k][0] + right[4 * k + j][0] for k in range(4))
            ways = [left[4 * i + k][1] + right[4 * k + j][1] for k in range(4) if left[4 * i + k][0] + right[4 * k + j][0] == least]
            out.append((least, min(ways)) if least < NEVER else (NEVER, ""))
    return out


@functools.lru_cache(maxsize=1 << 13)
def _short(signature: str) -> list[tuple[int, str]]:
    return _solved(signature)


def _solved(signature: str) -> list[tuple[int, str]]:
    if len(signature) == 1:
        return _of_row(signature)
    half = 1 << ((len(signature) - 1).bit_length() - 1)
    return _of_two(solve(signature[:half]), solve(signature[half:]))


def solve(signature: str) -> list[tuple[int, str]]:
    """Least cost, and of equal ones the least steps, from state i to state j (at 4 i + j). Steps: a letter of the audit and the role it
    leaves (- for none) for each edit, a space after each row. Where steps differ first their audits do, so both have one order."""
    return _short(signature) if len(signature) <= 32 else _solved(signature)


def _solve_all(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        for at in range(0, len(batch), 64):
            signatures = batch["signature"].iloc[at : at + 64].tolist()
            found = [solve(s) for s in signatures]
            yield pd.DataFrame({"signature": signatures, "costs": [[c for c, _ in f] for f in found], "ways": [[s for _, s in f] for f in found]})


def carried(spans: DataFrame, start: list[int], fan: int) -> DataFrame:
    """key, at and `before`: the vector with which the span `at` (in rising order) of its key is met, of costs of 4 states, that is start
    by all tables m (16 costs, 4 i + j) before it. No task gets more than `fan` tables of a key."""

    def meet(v: np.ndarray, m) -> np.ndarray:
        return (v[:, None] + np.asarray(m).reshape(4, 4)).min(axis=0)

    def within(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("at")
        v, out = np.asarray(pdf["start"].iloc[0]), []
        for m in pdf["m"]:
            out.append(v.tolist())
            v = np.minimum(meet(v, m), NEVER)
        return pd.DataFrame({"key": pdf["key"], "at": pdf["at"], "before": out})

    def whole(pdf: pd.DataFrame) -> pd.DataFrame:
        total = np.where(np.eye(4, dtype=bool), 0, NEVER)
        for m in pdf.sort_values("at")["m"]:
            total = np.minimum(np.stack([meet(v, m) for v in total]), NEVER)
        return pd.DataFrame({"key": [pdf["key"].iloc[0]], "at": [pdf["block"].iloc[0]], "m": [total.ravel().tolist()]})

    first = F.array(*[F.lit(x).cast("long") for x in start]).alias("start")
    block = F.floor(F.col("at") / fan).cast("long").alias("block")
    widest = spans.groupBy("key").agg((F.max(block) - F.min(block)).alias("n")).agg(F.max("n")).first()[0]
    if not widest:
        met = spans.select("key", "at", "m", first, block)
    else:
        blocks = saved(spans.select("key", "at", "m", block).groupBy("key", "block").applyInPandas(whole, "key string, at long, m array<long>"), "conversation-blocks")
        known = carried(blocks, start, fan).select("key", F.col("at").alias("block"), F.col("before").alias("start"))
        met = spans.select("key", "at", "m", block).join(known, ["key", "block"])
    return saved(met.groupBy("key", "block").applyInPandas(within, "key string, at long, before array<long>"), "conversation-carried")


def _way(enter: Column | int, after: Column) -> Column:
    """The best way through a piece from state `enter`, given what each state costs after it: cost (of both), steps, exit."""
    ways = [F.struct((F.get("costs", enter * 4 + j) + F.get(after, F.lit(j))).alias("cost"), F.get("ways", enter * 4 + j).alias("steps"), F.lit(j).alias("exit")) for j in range(4)]
    return F.array_min(F.array(*ways))


def _endings() -> Column:
    return F.array(*[F.lit(c).cast("long") for c, _ in ENDINGS])


def solved(told: DataFrame, fan: int) -> DataFrame:
    """pieces with cost, steps and exit (state after it), written."""
    signatures = told.select("signature").distinct()
    solutions = saved(signatures.mapInPandas(_solve_all, "signature string, costs array<long>, ways array<string>"), "conversation-solutions")
    known = saved(hot_join(told, solutions, ["signature"]), "conversation-known")
    # places within the conversation, from its begin and from its end, so that the levels grow with its own length
    several = known.groupBy("key").agg(F.min("piece").alias("low"), F.max("piece").alias("high")).where("low < high")
    long = known.join(several, "key").select("key", "piece", (F.col("piece") - F.col("low")).alias("at"), (F.col("high") - F.col("piece")).alias("back"), "costs", "ways")
    long = saved(long, "conversation-long")
    turned = F.array(*[F.get("costs", F.lit(4 * i + j)) for j in range(4) for i in range(4)])
    after = carried(long.select("key", F.col("back").alias("at"), turned.alias("m")), [c for c, _ in ENDINGS], fan).select("key", F.col("at").alias("back"), F.col("before").alias("after"))
    long = saved(long.join(after, ["key", "back"]).drop("back"), "conversation-after")
    lead = lambda i: F.transform(F.array(*[F.lit(j) for j in range(4)]), lambda j: F.when(j == _way(F.lit(i), F.col("after"))["exit"], F.lit(0)).otherwise(F.lit(NEVER)).cast("long"))
    steps = long.select("key", "at", F.flatten(F.array(*[lead(i) for i in range(4)])).alias("m"))
    enters = carried(saved(steps, "conversation-leads"), [0, NEVER, NEVER, NEVER], fan).select("key", F.col("at"), (F.array_position("before", F.lit(0).cast("long")) - 1).cast("int").alias("enter"))
    place = long.select("key", "at", "piece", "after").join(enters, ["key", "at"]).drop("at")
    both = known.join(place, ["key", "piece"], "left").withColumn("enter", F.coalesce("enter", F.lit(0))).withColumn("after", F.coalesce("after", _endings()))
    both = both.withColumn("way", _way(F.col("enter"), F.col("after")))
    cost = F.col("way.cost") - F.get("after", F.col("way.exit"))
    return saved(both.select(*told.columns, cost.alias("cost"), F.rtrim(F.col("way.steps")).alias("steps"), F.col("way.exit").alias("exit")), "conversation-steps")


@dataclass
class Repair:
    """audits: a row for each conversation; rows: conv_id, key, row, place, edit, role, text in the order of (row, place)."""

    audits: DataFrame
    rows: DataFrame


def _audit(steps: Column) -> Column:
    return F.translate(steps, "sua- ", "")


def repair(conversations: DataFrame, *, piece_rows: int = 1024, fan: int = 512) -> Repair:
    """The cheapest repair of every conversation: what was found, the audit of its edits, and its rows after them."""
    rows = ordered(conversations)
    steps = solved(pieces(with_faults(rows), piece_rows), fan)
    ending = lambda exit, what: F.array(*[F.lit(what(e)) for e in ENDINGS])[exit]
    of_all = F.sort_array(F.collect_list(F.struct("piece", "steps", "exit", "first_turn", "last_turn", "first_initial", "last_initial"))).alias("p")
    sums = [F.sum(c).cast("long").alias(c) for c in ("blank", "duplicate", "truncated", "illegal", "turns", "cost")]
    audits = steps.groupBy("key", "conv_id").agg(of_all, *sums, F.min("least_turn").alias("least"), F.max("most_turn").alias("most"))
    joints = lambda bad: F.size(F.filter(F.transform("p", lambda x, i: F.when(i > 0, bad(F.get(F.col("p"), i - 1), x))), lambda x: x)).cast("long")
    illegal = joints(lambda a, b: ~F.concat(a["last_initial"], b["first_initial"]).isin("su", "ua", "au"))
    shared = joints(lambda a, b: F.coalesce(a["last_turn"] == b["first_turn"], F.lit(False)))
    last = F.element_at("p", -1)["exit"]
    audits = audits.select(
        "key", "conv_id",
        F.coalesce(F.col("most") - F.col("least") + 1 - (F.col("turns") - shared), F.lit(0)).cast("long").alias("gaps"),
        "blank", "duplicate", "truncated", (F.col("illegal") + illegal).alias("illegal"),
        (F.col("cost") + ending(last, lambda e: e[0])).cast("long").alias("cost"),
        F.concat(_audit(F.array_join(F.transform("p", lambda x: x["steps"]), "")), _audit(ending(last, lambda e: e[1]))).alias("audit"),
    )
    edits = steps.select("key", "conv_id", "first_row", F.posexplode(F.split("steps", " ")).alias("at", "edits"))
    edits = edits.select("key", "conv_id", (F.col("first_row") + F.col("at")).alias("row"), "edits")
    edits = edits.select("key", "conv_id", "row", F.posexplode(F.regexp_extract_all("edits", F.lit("([DIKR][sua-])"), F.lit(1))).alias("place", "edit")).where("edit != 'D-'")
    ends = steps.groupBy("key", "conv_id").agg(F.max_by("exit", "piece").alias("exit"), F.max(F.col("first_row") + F.col("n_rows") - 1).alias("row"))
    ends = ends.select("key", "conv_id", "row", F.posexplode(F.regexp_extract_all(ending(F.col("exit"), lambda e: e[1]), F.lit("([DIKR][sua-])"), F.lit(1))).alias("place", "edit")).withColumn("place", F.col("place") + 2)
    name = F.when(F.substring("edit", 2, 1) == "u", "user").otherwise("assistant")
    inserted = edits.unionByName(ends).where("edit like 'I%'").select("key", "conv_id", "row", "place", F.lit("insert").alias("edit"), name.alias("role"), F.lit("").alias("text"))
    own = edits.where("edit not like 'I%'").select("row", "place", "edit").join(rows.select("key", "conv_id", "row", F.col("role").alias("__role"), "text"), "row")
    kept = F.col("edit").startswith("K")
    own = own.select("key", "conv_id", "row", "place", F.when(kept, "keep").otherwise("rerole").alias("edit"), F.when(kept, F.col("__role")).otherwise(name).alias("role"), "text")
    return Repair(audits, own.unionByName(inserted))


def hashed(rows: DataFrame) -> DataFrame:
    """key and the SHA-256 of the newline-joined `role:text` of its repaired rows, written."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, chain = None, None
        told = lambda: pa.RecordBatch.from_pydict({"key": [key], "sha256": [chain.hexdigest()]})
        for batch in batches:
            for k, line in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                if k == key:
                    chain.update(b"\n")
                else:
                    if chain is not None:
                        yield told()
                    key, chain = k, hashlib.sha256()
                chain.update(line.as_buffer() or b"")
        if chain is not None:
            yield told()

    lines = rows.select("key", "row", "place", F.concat("role", F.lit(":"), "text").cast("binary").alias("line"))
    lines = lines.repartition("key").sortWithinPartitions("key", "row", "place").select("key", "line")
    with small_batches(rows.sparkSession):
        return saved(lines.mapInArrow(run, "key string, sha256 string"), "conversation-hashes")


ORACLE = r"""
WITH RECURSIVE c AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
         xor(list_reduce([4294967295::BIGINT] || list_transform(string_split(coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' '), ''), lambda x: ascii(x)::BIGINT),
             lambda r, b: list_reduce([xor(r, b)] || range(8), lambda y, z: CASE WHEN y % 2 = 1 THEN xor(y // 2, 3988292384) ELSE y // 2 END)), 4294967295) % 20 AS kind
  FROM conversations),
d AS (
  SELECT conv_id, turn, CASE kind WHEN 4 THEN 'user' ELSE role END AS role, CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text
  FROM c, unnest(range(CASE kind WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END))),
o AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS k FROM d),
f AS (
  SELECT *, left(role, 1) AS ini, NOT regexp_matches(text, '[^\x20\x09-\x0D]') AS blank, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY k) > 1 AS seen,
         NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*$') AS cut, lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY k) || left(role, 1) AS pair
  FROM o),
s AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0)::BIGINT AS gaps, count(*) FILTER (blank) AS blank, count(*) FILTER (NOT blank AND seen) AS duplicate,
         count(*) FILTER (NOT blank AND NOT seen AND cut) AS truncated, count(*) FILTER (pair NOT IN ('su', 'ua', 'au')) AS illegal, max(k) AS n
  FROM f GROUP BY conv_id),
lead(st, lead, mid) AS (VALUES (0, '', 0), (1, '', 1), (2, '', 2), (3, '', 3), (0, 'I', 2), (1, 'I', 2), (2, 'I', 3), (3, 'I', 2)),
t AS (
  SELECT conv_id, 0::BIGINT AS k, 0 AS st, {'cost': 0, 'audit': '', 'lines': []::VARCHAR[]} AS b FROM s
  UNION ALL
  SELECT t.conv_id, t.k + 1, v.st, min({'cost': b.cost + 3 * len(lead) + CASE e WHEN 'D' THEN 4 WHEN 'K' THEN 0 ELSE 3 END + CASE WHEN e != 'D' AND cut THEN 3 ELSE 0 END,
      'audit': b.audit || lead || e,
      'lines': list_concat(b.lines, list_concat(CASE lead WHEN '' THEN []::VARCHAR[] ELSE [CASE mid WHEN 2 THEN 'user:' ELSE 'assistant:' END] END,
          CASE e WHEN 'D' THEN []::VARCHAR[] WHEN 'K' THEN [role || ':' || text] ELSE [CASE mid WHEN 2 THEN 'assistant:' ELSE 'user:' END || text] END))})
  FROM t JOIN f ON f.conv_id IS NOT DISTINCT FROM t.conv_id AND f.k = t.k + 1 JOIN lead ON lead.st = t.st, (VALUES ('D'), ('K'), ('R')) AS x(e),
       LATERAL (SELECT CASE WHEN e = 'D' THEN mid WHEN e = 'K' AND ini = 's' THEN 1 WHEN mid = 2 THEN 3 ELSE 2 END AS st) AS v
  WHERE e = 'D' OR NOT blank AND NOT seen AND (e = 'R' OR ini = 's' AND mid = 0 OR ini = 'u' AND mid != 2 OR ini = 'a' AND mid = 2)
  GROUP BY t.conv_id, t.k, v.st),
z AS (
  SELECT s.conv_id, min({'cost': b.cost + CASE st WHEN 1 THEN 6 WHEN 2 THEN 3 ELSE 0 END, 'audit': b.audit || CASE st WHEN 1 THEN 'II' WHEN 2 THEN 'I' ELSE '' END,
      'lines': list_concat(b.lines, CASE st WHEN 1 THEN ['user:', 'assistant:'] WHEN 2 THEN ['assistant:'] ELSE []::VARCHAR[] END)}) AS b
  FROM s JOIN t ON t.conv_id IS NOT DISTINCT FROM s.conv_id AND t.k = s.n GROUP BY s.conv_id)
SELECT i.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
       coalesce(b.cost, 0)::BIGINT AS cost, coalesce(b.audit, '') AS audit, sha256(coalesce(array_to_string(b.lines, chr(10)), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) AS i LEFT JOIN s ON s.conv_id IS NOT DISTINCT FROM i.conv_id LEFT JOIN z ON z.conv_id IS NOT DISTINCT FROM i.conv_id
"""
