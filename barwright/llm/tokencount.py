"""Token counts by a linear longest-match automaton over a word-piece vocabulary.

Greedy longest match takes the longest vocabulary entry at the start of a word
and then again at the rest. The automaton is the vocabulary's trie with, at
each node, a failure link and the number of pieces that the greedy rule has
settled when it is followed: reading a byte that the node has no edge for pops
those pieces and goes on from the link's node. Each byte is read once, and
since only the number of popped pieces is kept, no piece is built.

Pieces that start a word are marked in the vocabulary (a leading space); a
word is fed with that mark, and what follows the first piece is matched from
the root of the unmarked pieces. Bytes that no piece covers count one piece
each.

Words of a part of a batch (of bounded bytes) run through the automaton
together, one byte column at a time in NumPy, each distinct word once; words of
more than LONG bytes run alone, byte by byte. The counts of short words are
kept in a table of bounded bytes. Texts stay where they are read and nothing is
shuffled.

Defined results: null and blank texts have no tokens; repeated rows are counted
separately; other columns are not read; an empty table gives no row.
"""

from __future__ import annotations

import functools
import json
from collections import deque
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices

#: Words of more bytes run alone.
LONG = 512
#: Bytes that the table of counted words may take, and what an entry takes besides its word.
KEEP, ENTRY = 48 << 20, 130


def byte_level(path: str) -> list[tuple[bool, bytes]]:
    """(starts a word, bytes) of each entry of a byte-level vocabulary; its characters stand for bytes by a fixed rule."""
    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    byte = {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in set(shown))}
    out = []
    with open(path, encoding="utf-8") as f:
        for token in json.load(f)["model"]["vocab"]:
            raw = bytes(byte[c] for c in token)
            starts = raw[:1] == b" "
            if raw[starts:] and not any(b in b" \t\n\x0b\x0c\r" for b in raw[starts:]):
                out.append((starts, raw[starts:]))
    return out


class Automaton:
    """Node 0 is the root of pieces inside a word, node 1 the root of pieces that start one; node 2 is dead.

    failure[v] is the node after the pieces of v's string are settled and the
    rest is matched again from node 0; pops[v] is how many pieces that took. A
    node from which nothing can be settled has failure 2: the byte that comes
    is then a piece of its own, or ends one.
    """

    def __init__(self, pieces: Iterable[tuple[bool, bytes]]):
        edges: list[dict[int, int]] = [{}, {}, {}]
        final = [False, False, False]
        for starts, piece in pieces:
            v = 1 if starts else 0
            for b in piece:
                if b not in edges[v]:
                    edges[v][b] = len(edges)
                    edges.append({})
                    final.append(False)
                v = edges[v][b]
            final[v] = True
        failure, pops = [2] * len(edges), [0] * len(edges)
        # a byte that no piece starts with is a piece of its own: it settles at once
        queue = deque()
        for root in (0, 1):
            for b, v in edges[root].items():
                queue.append((root, b, v))
        while queue:
            parent, b, v = queue.popleft()
            if final[v]:
                failure[v], pops[v] = 0, 1
            else:
                # settle the parent's string, then read b from where that leads
                u, n = parent, 0
                while True:
                    if u in (0, 1):
                        failure[v], pops[v] = (0, n + 1) if b not in edges[0] or u == 0 else (edges[0][b], n)
                        break
                    n += pops[u]
                    u = failure[u]
                    if b in edges[u]:
                        failure[v], pops[v] = edges[u][b], n
                        break
            for c, w in edges[v].items():
                queue.append((v, c, w))
        self.failure, self.pops = np.array(failure, np.int32), np.array(pops, np.int32)
        self._edges: dict[int, int] | None = None
        key = np.array([v << 8 | b for v, out in enumerate(edges) for b in out], np.int64)
        to = np.array([w for out in edges for w in out.values()], np.int32)
        bits = max(4, int(4 * len(key)).bit_length())
        self.shift = np.uint64(64 - bits)
        self.slots = np.full(1 << bits, -1, np.int64)
        self.target = np.zeros(1 << bits, np.int32)
        self._fill(key, to)

    def _slot(self, key: np.ndarray) -> np.ndarray:
        return ((key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def _fill(self, key: np.ndarray, to: np.ndarray) -> None:
        at, mask = self._slot(key), len(self.slots) - 1
        while len(key):
            free = self.slots[at] < 0
            _, first = np.unique(np.where(free, at, -1 - np.arange(len(at))), return_index=True)
            won = np.zeros(len(at), bool)
            won[first] = True
            won &= free
            self.slots[at[won]], self.target[at[won]] = key[won], to[won]
            key, to, at = key[~won], to[~won], (at[~won] + 1) & mask

    def edge(self, node: np.ndarray, byte: np.ndarray) -> np.ndarray:
        """The node that an edge leads to, or -1."""
        key = node.astype(np.int64) << 8 | byte
        at, mask = self._slot(key), len(self.slots) - 1
        out, open_ = np.full(len(key), -1, np.int32), np.arange(len(key))
        while len(open_):
            found = self.slots[at]
            hit = found == key[open_]
            out[open_[hit]] = self.target[at[hit]]
            more = ~hit & (found >= 0)
            open_, at = open_[more], (at[more] + 1) & mask
        return out

    def count_long(self, word: bytes) -> int:
        """Pieces of one word."""
        edges = self._table()
        failure, pops = self._links
        v, n = 1, 0
        for b in word:
            while (to := edges.get(v << 8 | b)) is None:
                if v == 1:
                    v = 0
                elif v == 0:
                    n, to = n + 1, 0
                    break
                else:
                    n += pops[v]
                    v = failure[v]
            v = to
        while v > 2:
            n += pops[v]
            v = failure[v]
        return n

    def _table(self) -> dict[int, int]:
        if self._edges is None:
            used = self.slots >= 0
            self._edges = dict(zip(self.slots[used].tolist(), self.target[used].tolist(), strict=True))
            self._links = self.failure.tolist(), self.pops.tolist()
        return self._edges

    def count(self, words: list[bytes]) -> np.ndarray:
        """Pieces of each word."""
        long = [k for k, w in enumerate(words) if len(w) > LONG]
        if long:
            total = np.zeros(len(words), np.int64)
            short = np.ones(len(words), bool)
            short[long] = False
            total[short] = self.count([w for w in words if len(w) <= LONG])
            total[long] = [self.count_long(words[k]) for k in long]
            return total
        total = np.zeros(len(words), np.int64)
        if not words:
            return total
        length = np.fromiter(map(len, words), np.int64, len(words))
        order = np.argsort(-length, kind="stable")
        length = length[order]
        flat = np.frombuffer(b"".join(words), np.uint8)
        start = (np.cumsum(np.fromiter(map(len, words), np.int64, len(words))) - np.fromiter(map(len, words), np.int64, len(words)))[order]
        node, n = np.ones(len(words), np.int32), np.zeros(len(words), np.int64)
        for column in range(int(length[0])):
            live = int(np.searchsorted(-length, -column, side="left"))
            self._read(node, n, np.arange(live), flat[start[:live] + column])
        at = np.arange(len(words))
        while len(at := at[node[at] > 2]):  # the end of a word settles what is left
            n[at] += self.pops[node[at]]
            node[at] = self.failure[node[at]]
        total[order] = n
        return total

    def _read(self, node: np.ndarray, n: np.ndarray, at: np.ndarray, byte: np.ndarray) -> None:
        while len(at):
            to = self.edge(node[at], byte)
            ok = to >= 0
            node[at[ok]] = to[ok]
            at, byte = at[~ok], byte[~ok]
            root = node[at] < 2
            # the start root falls back to the inner one; a byte unknown there is a piece
            inner = node[at] == 0
            n[at[inner]] += 1
            now = node[at]
            deep = ~root
            n[at[deep]] += self.pops[now[deep]]
            now[deep] = self.failure[now[deep]]
            now[root] = 0
            node[at] = now
            at, byte = at[~inner], byte[~inner]


@functools.cache
def automaton(path: str) -> Automaton:
    return Automaton(byte_level(path))


def _counted(batches: Iterator[pa.RecordBatch], path: str) -> Iterator[pa.RecordBatch]:
    machine, known, held = automaton(path), {}, 0
    for batch in batches:
        for part in slices(batch, "text", rows=512):
            rows = [(t or "").encode().split() for t in part.column("text").to_pylist()]
            if held > KEEP:
                known, held = {}, 0
            new = list({w for r in rows for w in r if w not in known})
            held += sum(map(len, new)) + ENTRY * len(new)
            known.update(zip(new, machine.count(new).tolist(), strict=True))
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array([len(r) for r in rows], pa.int64()), pa.array([sum(map(known.__getitem__, r)) for r in rows], pa.int64())], names=["doc_id", "n_words", "n_tokens"])


def count(docs: DataFrame, *, vocabulary: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_words and n_tokens of each whole text."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    kind = dict(rows.dtypes)["doc_id"]
    return rows.mapInArrow(functools.partial(_counted, path=vocabulary), f"doc_id {kind}, n_words long, n_tokens long")
