"""N-gram Jaccard join by PartEnum signatures, exact, with components of the links.

Two sets of sizes a <= b with Jaccard similarity of at least 3/4 have b <= 4a/3
and differ in at most k = (a + b) / 7 elements. PartEnum partitions the feature
domain by hash and signs with subsets of the parts, such that k differences
cannot spoil all subsets. A subset of more parts holds more elements, so fewer
sets share it by chance, but there are more subsets. The rule here:

- Sets of up to TINY elements (k of 1 or 2) have a band for each size. The
  domain has k + 2 parts, and all pairs of parts are enumerated (3 or 6). k
  differences leave at least two parts alike, so one pair.
- Larger sets are in bands of a factor of 4. Enumerating pairs would double
  their signatures or more, so subsets are of one part: the domain has about
  top/2 parts, and two similar sets agree on a part that neither has empty and
  that is among the first h + 1 such parts of both, h being the largest k that
  the set's size allows; about 0.4 signatures for each shingle.

A set signs for the band of its own size and, if that differs, for those of
larger partners. A set that has not enough parts with elements (a thin one)
also signs with its first a/4 + 1 single elements, of which two similar sets
share one.

Sets that share a signature are compared by a parity sketch first (a bit for
each of as many residues as the set has elements): it bounds the number of
differences from below and drops pairs that cannot be similar. Whole sets are
fetched for the rest: first each set against one other, then pairs whose
components still differ. New links join components of the links before, so a
step costs what it adds.

Of a signature's sets each is compared with the first. Where its sets are then
not all in one component, up to `small` sets are compared across components; a
larger signature is hot, and its sets sign again, in rounds, with the first
parts whose signatures are not among the largest so far; a pair agrees on
one of those by the arguments above, as long as one of the two has enough.
What is left after the rounds, or has not even so many single elements that are not
hot, is compared in blocks of sets of near sizes, across components only. No
step loses a link.

Texts never move: sets are made where texts are read, a bounded number of bytes
of text at a time, and only sets of pairs that pass the sketch are sent. Equal
sets collapse to one node first, within each task and then for the whole
corpus; should two different sets have one 64-bit key (a second 64-bit hash
tells), keys are made anew with another salt. Signatures travel as packed
blocks for ranges of the signature space, sized so that a block fits in memory;
a signature that a block has more than `small` times sends one row of it, and
the block's own task compares and lists the others, so no key gathers.

Shingles are compared by 64-bit hashes: of n shingles of a pair, two differ and
are taken for equal with probability n^2 / 2^65 (10^-11 for 20,000 words).

Defined results: null and blank texts have the empty set and are linked with
nothing; repeated rows have equal sets and so one component; a null doc_id
counts as less than any other; an empty table gives no row; other columns are
not read.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import saved, slices, small_batches
from .graph import components
from .shingles import mixed, shingle_sets

_U = np.uint64
#: Largest set that signs with pairs of parts.
TINY = 10


class Limits(NamedTuple):
    """Sizes that bound memory or steps; results don't depend on them."""

    small: int = 48  # sets of one signature that are compared across components
    block: int = 1 << 20  # shingles for each range of signatures (7 bytes each)
    held: int = 1 << 20  # signatures that a task holds (18 bytes each)
    seen: int = 1 << 17  # keys that a task remembers
    broadcast: int = 1 << 18  # ids of sets that may be broadcast to pick texts (16 bytes each); beyond that texts' rows are shuffled
    hot: int = 1 << 19  # large signatures, the largest first, that a round adds to those that later rounds skip (8 bytes each)
    rounds: int = 3
    chunk: int = 2048  # sets in a block of the last step


#: Stands for a null doc_id.
NO_ID = -(1 << 63)
#: Salts of a set's two hashes lie this far apart; so often keys may be made anew.
OTHER, SALTS = 1 << 32, 4
POSTING = np.dtype([("sig", "<u8"), ("key", "<u8"), ("size", "u1"), ("many", "u1")])


def most_differences(a: int) -> int:
    return (a + 4 * a // 3) // 7


def band(size: int) -> int:
    return (int(size).bit_length() - 1) // 2


def size_class(n: int) -> int:
    """Steps of 6 % in size, in a byte; sets that may be similar are at most SIZE_REACH apart."""
    return min(255, int(np.log(max(n, 1)) / np.log(1.06)))


SIZE_REACH = int(np.log(4 / 3) / np.log(1.06)) + 1


def packed(rows: np.ndarray) -> bytes:
    """Postings in order of signature as planes of bytes: steps between signatures leave their high planes zero, which compress away."""
    step = np.diff(rows["sig"], prepend=_U(0))
    planes = [np.ascontiguousarray(step).view(np.uint8).reshape(-1, 8).T.tobytes(), np.ascontiguousarray(rows["key"]).tobytes(), rows["size"].tobytes(), rows["many"].tobytes()]
    return b"".join(planes)


def unpacked(block: bytes) -> np.ndarray:
    n = len(block) // POSTING.itemsize
    rows = np.empty(n, POSTING)
    rows["sig"] = np.cumsum(np.ascontiguousarray(np.frombuffer(block, np.uint8, 8 * n).reshape(8, n).T).view(np.uint64).ravel())
    rows["key"] = np.frombuffer(block, np.uint64, n, 8 * n)
    rows["size"] = np.frombuffer(block, np.uint8, n, 16 * n)
    rows["many"] = np.frombuffer(block, np.uint8, n, 17 * n)
    return rows


def cold(sig: np.ndarray, hot: np.ndarray) -> np.ndarray:
    """Signatures that are not in the sorted array hot, in their order."""
    if not len(hot):
        return sig
    at = np.searchsorted(hot, sig)
    return sig[hot[np.minimum(at, len(hot) - 1)] != sig]


def pairs_of_parts(spread: np.ndarray, b: int, hot: np.ndarray) -> tuple[np.ndarray, bool]:
    """Signatures for pairs of sets of which the larger has b elements, and whether all subsets gave one."""
    n = 2 * b // 7 + 2
    part = (spread % _U(n)).astype(np.int64)
    sums = np.zeros(n, np.uint64)
    np.add.at(sums, part, mixed(spread + _U(b)))
    p, q = np.triu_indices(n, 1)
    some = np.bincount(part, minlength=n)[p] + np.bincount(part, minlength=n)[q] > 0
    name = (b << 8 | p << 4 | q).astype(np.uint64) * _U(0xC2B2AE3D27D4EB4F)
    sig = cold(mixed(mixed(sums[p] + name) + sums[q])[some], hot)
    return sig, len(sig) == len(p)


def signatures(e: np.ndarray, hot: np.ndarray = np.zeros(0, np.uint64)) -> tuple[np.ndarray, bool]:
    """The set's signatures, and whether they don't suffice to meet every partner."""
    a = len(e)
    h, out, thin = most_differences(a), [], False
    spread = mixed(e)
    for b in range(max(a, 4), min(4 * a // 3, TINY) + 1):  # up to 3, similar sets are equal
        sig, all_ = pairs_of_parts(spread, b, hot)
        thin |= not all_
        out.append(sig)
    for j in {band(a), band(4 * a // 3)} if 4 * a // 3 > TINY else ():
        part = spread % _U(max(1, (4 << (2 * j)) // 2))
        order = np.argsort(part, kind="stable")
        part = part[order]
        first = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1]]))
        sums = np.add.reduceat(mixed(spread[order] + _U(j + 1)), first)
        sig = cold(mixed(sums + part[first] * _U(0x9E3779B97F4A7C15) + _U(j)), hot)
        thin |= len(sig) <= h
        out.append(sig[: h + 1])
    unsafe = False
    if thin:
        single = cold(np.sort(mixed(e ^ _U(0x5851F42D4C957F2D))), hot)
        unsafe = len(single) <= a // 4
        out.append(single[: a // 4 + 1])
    return np.concatenate(out) if out else np.zeros(0, np.uint64), unsafe


def node_key(e: np.ndarray, salt: int = 0) -> int:
    """The set's identity: a hash of all its elements."""
    return int(mixed(np.array([int(mixed(e + _U(1 + salt)).sum(dtype=np.uint64)) ^ (len(e) * 0x9E3779B97F4A7C15 & (1 << 64) - 1)], np.uint64))[0])


def sketch(e: np.ndarray) -> bytes:
    """For each of a power of two of residues (the size or more, at least 64), whether an odd number of elements has it."""
    bits = 1 << max(6, int(len(e) - 1).bit_length())
    odd = np.bincount((e & _U(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").tobytes()


def differ_at_least(x: bytes, y: bytes) -> int:
    """A lower bound of the number of elements in one set only."""
    a, b = (np.frombuffer(s, np.uint64) for s in ((x, y) if len(x) <= len(y) else (y, x)))
    if len(b) > len(a):
        b = np.bitwise_xor.reduce(b.reshape(-1, len(a)), axis=0)
    return int(np.bitwise_count(a ^ b).sum())


def _signed(keys: np.ndarray) -> np.ndarray:
    return keys.view(np.int64)


def _texts(batch: pa.RecordBatch) -> Iterator[tuple[pa.RecordBatch, list]]:
    """Parts of the batch with their sets."""
    for part in slices(batch, "text"):
        yield part, list(shingle_sets(part.column("text").to_pylist()))


def _describe(batches: Iterator[pa.RecordBatch], salt: int = 0) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part, sets in _texts(batch):
            keys, other = (np.array([node_key(e, k) for e in sets], np.uint64) for k in (salt, salt + OTHER))
            rest = [c for c in part.schema.names if c != "text"]
            columns = [*(part.column(c) for c in rest), pa.array([len(e) for e in sets], pa.int64()), pa.array(_signed(keys)), pa.array(_signed(other)), pa.array([sketch(e) for e in sets], pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, names=[*rest, "n", "key", "other", "sketch"])


def _ordered(held: list[np.ndarray]) -> np.ndarray:
    """Postings by signature and set, without repeats; of repeats the one that stands for many stays."""
    rows = np.concatenate(held) if held else np.zeros(0, POSTING)
    rows = rows[np.lexsort((1 - rows["many"], rows["key"], rows["sig"]))]
    same = np.concatenate([[False], (rows["sig"][1:] == rows["sig"][:-1]) & (rows["key"][1:] == rows["key"][:-1])])[: len(rows)]
    return rows[~same]


def _runs(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First place and size of each signature of postings in order."""
    first = np.flatnonzero(np.concatenate([[True], rows["sig"][1:] != rows["sig"][:-1]]))[: len(rows)]
    return first, np.diff(np.concatenate([first, [len(rows)]]))


#: Kinds of blocks: postings of a range of signatures; sets of signatures that a task has many of; sets that stay unsafe.
POST, MEMBERS, UNSAFES = 0, 1, 2


def _blocks(held: list[np.ndarray], bits: int, aside: int, small: int) -> pa.RecordBatch:
    """held as blocks for ranges of signatures, and the sets of signatures that are here more than `small` times as one more."""
    rows = np.concatenate(held)
    rows = rows[np.argsort(rows["sig"])]
    first, size = _runs(rows)
    many = np.repeat(size > small, size)
    members, lead = rows[many], np.zeros(len(rows), bool)
    lead[first] = True
    rows["many"] |= many
    rows = rows[~many | lead]
    bucket = (rows["sig"] >> _U(64 - bits)).astype(np.int64)
    cuts = np.flatnonzero(np.diff(bucket, prepend=-1))
    parts = [packed(rows[lo:hi]) for lo, hi in zip(cuts, [*cuts, len(rows)][1:], strict=True)]
    buckets, kinds = bucket[cuts].tolist(), [POST] * len(parts)
    if len(members):
        buckets, kinds, parts = [*buckets, aside], [*kinds, MEMBERS], [*parts, packed(members)]
    return _block_batch(buckets, kinds, parts)


def _block_batch(buckets: list[int], kinds: list[int], parts: list[bytes]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(buckets, pa.int32()), pa.array(kinds, pa.int32()), pa.array(parts, pa.binary())], names=["bucket", "kind", "block"])


def _posted(batches: Iterator[pa.RecordBatch], bits: int, hot: np.ndarray, salt: int, limits: Limits) -> Iterator[pa.RecordBatch]:
    """Blocks of postings by range of signatures; equal sets of a task are posted once."""
    seen: set[int] = set()
    held: list[np.ndarray] = []
    unsafe: list[int] = []
    size = 0
    aside = TaskContext.get().partitionId() % (1 << bits)
    for batch in batches:
        for _, sets in _texts(batch):
            for e in sets:
                if not len(e) or (key := node_key(e, salt)) in seen:
                    continue
                seen.add(key)
                sig, lost = signatures(e, hot)
                if lost:
                    unsafe.append(key)
                rows = np.zeros(len(sig), POSTING)
                rows["sig"], rows["key"], rows["size"] = sig, key, size_class(len(e))
                held.append(rows)
                size += len(rows) + 8
                if size > limits.held:
                    yield _blocks(held, bits, aside, limits.small)
                    held, size = [], 0
            if len(seen) > limits.seen:
                seen.clear()
            if len(unsafe) > limits.seen:
                yield _block_batch([aside], [UNSAFES], [_keys_only(unsafe)])
                unsafe = []
    if held:
        yield _blocks(held, bits, aside, limits.small)
    if unsafe:
        yield _block_batch([aside], [UNSAFES], [_keys_only(unsafe)])


def _keys_only(keys: list[int]) -> bytes:
    rows = np.zeros(len(keys), POSTING)
    rows["key"] = keys
    return packed(rows)


#: Kinds of findings: sets a and b share a signature; a signature or group a of few or of many sets has set b; set b stays unsafe.
PAIR, GROUP, LARGE, UNSAFE = 0, 1, 2, 3


def _tell(kind: int, a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.full(len(a), kind, np.int32)), pa.array(_signed(a.copy())), pa.array(_signed(b.copy()))], names=["kind", "a", "b"])


def _stars(rows: np.ndarray, first: np.ndarray, size: np.ndarray) -> pa.RecordBatch:
    """Distinct pairs of each signature's first set and another, whose sizes allow similarity."""
    lead, j = np.repeat(first, size), np.arange(len(rows))
    ok = (lead != j) & (np.abs(rows["size"][lead].astype(np.int16) - rows["size"]) <= SIZE_REACH)
    x, y = rows["key"][lead[ok]], rows["key"][j[ok]]
    x, y = np.minimum(x, y), np.maximum(x, y)
    order = np.lexsort((y, x))
    x, y = x[order], y[order]
    new = np.concatenate([[True], (x[1:] != x[:-1]) | (y[1:] != y[:-1])])[: len(x)]
    return _tell(PAIR, x[new], y[new])


def _met(rows: np.ndarray, small: int) -> Iterator[pa.RecordBatch]:
    """What the postings of a range of signatures, in order, tell. Signatures with the same few sets are told once, by a hash of those."""
    first, size = _runs(rows)
    if not len(rows):
        return
    yield _stars(rows, first, size)
    many = (size > small) | (np.maximum.reduceat(rows["many"], first) > 0)
    some = ~many & (size > 2)
    name = mixed(np.add.reduceat(mixed(rows["key"]), first) + size.astype(np.uint64))
    _, once = np.unique(name[some], return_index=True)
    chosen = np.zeros(len(first), bool)
    chosen[np.flatnonzero(some)[once]] = True
    at = np.repeat(chosen, size)
    yield _tell(GROUP, np.repeat(name, size)[at], rows["key"][at])
    at = np.repeat(many, size)
    yield _tell(LARGE, rows["sig"][at], rows["key"][at])


def _matched(batches: Iterator[pa.RecordBatch], small: int) -> Iterator[pa.RecordBatch]:
    held: dict[int, list[np.ndarray]] = {}
    for batch in batches:
        for bucket, kind, block in zip(batch.column("bucket").to_pylist(), batch.column("kind").to_pylist(), batch.column("block"), strict=True):
            rows = unpacked(block.as_py())
            if kind == POST:
                held.setdefault(bucket, []).append(rows)
            elif kind == MEMBERS:
                yield _stars(rows, *_runs(rows))
                yield _tell(LARGE, rows["sig"], rows["key"])
            else:
                yield _tell(UNSAFE, rows["sig"], rows["key"])
    while held:
        yield from _met(_ordered(held.pop(next(iter(held)))), small)


def _matches(texts: DataFrame, shingles: int, hot: np.ndarray, salt: int, limits: Limits) -> DataFrame:
    """Rows of _matched() for the signatures of texts (doc_id, text) with so many shingles in all."""
    bits = max(4, int(max(1, shingles // limits.block)).bit_length())
    blocks = texts.mapInArrow(functools.partial(_posted, bits=bits, hot=hot, salt=salt, limits=limits), "bucket int, kind int, block binary")
    dealt = blocks.repartitionById(1 << bits, "bucket")
    return saved(dealt.mapInArrow(functools.partial(_matched, small=limits.small), "kind int, a long, b long"), "jaccard-matches")


def _sketched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        na, nb, x, y = (batch.column(c).to_pylist() for c in ("na", "nb", "sa", "sb"))
        ok = [7 * differ_at_least(*two) <= p + q for p, q, *two in zip(na, nb, x, y, strict=True)]
        yield batch.select(["a", "b"]).filter(pa.array(ok, pa.bool_()))


def _whole(batches: Iterator[pa.RecordBatch], salt: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for _, sets in _texts(batch):
            yield pa.RecordBatch.from_arrays([pa.array([node_key(e, salt) for e in sets], pa.uint64()).view(pa.int64()), pa.array([e.tobytes() for e in sets], pa.binary())], names=["key", "elements"])


def _verified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ok = []
        for x, y in zip(batch.column("ea"), batch.column("eb"), strict=True):
            x, y = (np.frombuffer(s.as_py(), np.uint64) for s in (x, y))
            both = len(np.intersect1d(x, y, assume_unique=True))
            ok.append(100 * both >= 75 * (len(x) + len(y) - both))
        yield batch.select(["a", "b"]).filter(pa.array(ok, pa.bool_()))


def _of(texts: DataFrame, nodes: DataFrame, keys: DataFrame, light: bool) -> DataFrame:
    """Documents that stand for the sets; where ids repeat, also others of the same id."""
    ids = nodes.join(keys, "key", "left_semi").select("doc_id").distinct()
    return texts.join(F.broadcast(ids) if light else ids, "doc_id", "left_semi")


def _likely(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    """Distinct pairs (a, b) that their sizes and sketches allow."""
    end = lambda c: nodes.select(F.col("key").alias(c), F.col("n").alias(f"n{c}"), F.col("sketch").alias(f"s{c}"))
    told = pairs.select("a", "b").distinct().join(end("a"), "a").join(end("b"), "b").where("4 * least(na, nb) >= 3 * greatest(na, nb)")
    return saved(told.select("a", "b", "na", "nb", "sa", "sb").mapInArrow(_sketched, "a long, b long"), "jaccard-likely")


def _linked(pairs: DataFrame, sets: Sets, limits: Limits) -> DataFrame:
    """The pairs (a, b) of sets that are similar, by the whole sets. Each b's set goes to its pairs' a."""
    used = pairs.select(F.col("a").alias("key"), F.lit(True).alias("at_a")).unionByName(pairs.select(F.col("b").alias("key"), F.lit(False).alias("at_a")))
    keys = saved(used.groupBy("key").agg(F.max("at_a").alias("is_a"), F.min("at_a").alias("only_a")), "jaccard-keys")
    light = keys.count() <= limits.broadcast
    made = _of(sets.texts, sets.nodes, keys, light).select("text").mapInArrow(functools.partial(_whole, salt=sets.salt), "key long, elements binary")
    whole = saved(made.join(F.broadcast(keys) if light else keys, "key"), "jaccard-sets")
    if sets.ids_repeat:
        whole = whole.dropDuplicates(["key"])
    far = pairs.join(whole.where("not only_a").select(F.col("key").alias("b"), F.col("elements").alias("eb")), "b")
    two = far.join(whole.where("is_a").select(F.col("key").alias("a"), F.col("elements").alias("ea")), "a")
    return saved(two.select("a", "b", "ea", "eb").mapInArrow(_verified, "a long, b long"), "jaccard-links")


def _named(df: DataFrame, columns: tuple[str, ...], labels: DataFrame) -> DataFrame:
    """df with l<column>, the label of the set that each column names: its own key where it has no link."""
    for c in columns:
        df = df.join(labels.select(F.col("node").alias(c), F.col("label").alias(f"l{c}")), c, "left").withColumn(f"l{c}", F.coalesce(f"l{c}", c))
    return df


def _labelled(pairs: DataFrame, labels: DataFrame) -> DataFrame:
    """Pairs whose components differ."""
    return _named(pairs, ("a", "b"), labels).where("la <> lb").select("a", "b")


def _joined(labels: DataFrame, links: DataFrame) -> DataFrame:
    """labels (node, label) after more links between components; only those components are looked at."""
    ends = _named(links, ("a", "b"), labels).where("la <> lb").select(F.col("la").alias("u"), F.col("lb").alias("v")).distinct()
    new = components(ends)
    told = labels.join(new.select(F.col("node").alias("label"), F.col("label").alias("to")), "label", "left")
    return saved(told.select("node", F.coalesce("to", "label").alias("label")).unionByName(new), "jaccard-labels")


def _divided(groups: DataFrame, labels: DataFrame) -> DataFrame:
    """Groups (a, b) whose sets b are of several components: a, and its number of rows."""
    return _named(groups, ("b",), labels).groupBy("a").agg(F.min("lb").alias("lo"), F.max("lb").alias("hi"), F.count(F.lit(1)).alias("size")).where("lo <> hi").select("a", "size")


def _across(groups: DataFrame, labels: DataFrame) -> DataFrame:
    """Pairs of sets of one group (of `small` at most) that are of different components."""
    some = groups.select("a", "b").join(_divided(groups, labels).select("a"), "a", "left_semi").distinct()
    some = saved(_named(some, ("b",), labels), "jaccard-groups")
    pairs = some.select("a", F.col("b").alias("x"), F.col("lb").alias("lx")).join(some.select("a", F.col("b").alias("y"), F.col("lb").alias("ly")), "a")
    return pairs.where("x < y and lx <> ly").select(F.col("x").alias("a"), F.col("y").alias("b"))


def _folded(sketches: list[bytes], words: int) -> np.ndarray:
    """Sketches as rows of 64-bit words, longer ones folded to the length of the shortest."""
    return np.stack([np.bitwise_xor.reduce(np.frombuffer(s, np.uint64).reshape(-1, words), axis=0) for s in sketches])


def _blocked(rows):
    """Sets of one block against those of another, across components, by sketch."""
    import pandas as pd

    left, right = rows[rows.side == 0], rows[rows.side == 1]
    out = [np.zeros((0, 2), np.int64)]
    if len(left) and len(right):
        words = min(map(len, rows.sketch)) // 8
        theirs, n, label, key = _folded(list(right.sketch), words), right.n.to_numpy(), right.label.to_numpy(), right.key.to_numpy()
        for k, size, own, s in zip(left.key, left.n, left.label, _folded(list(left.sketch), words), strict=True):
            ok = (label != own) & (4 * np.minimum(n, size) >= 3 * np.maximum(n, size))
            at = np.flatnonzero(ok)
            at = at[7 * np.bitwise_count(theirs[at] ^ s).sum(axis=1, dtype=np.int64) <= n[at] + size]
            out.append(np.stack([np.minimum(key[at], k), np.maximum(key[at], k)], axis=1))
    return pd.DataFrame(np.unique(np.concatenate(out), axis=0), columns=["a", "b"])


def _rest(unsafe: DataFrame, nodes: DataFrame, labels: DataFrame, chunk: int) -> DataFrame:
    """Pairs of unsafe sets of near sizes (a factor of 4/3 a class, so neighbouring classes meet), in blocks.

    Only sets outside the commonest component of their class look for partners.
    """
    some = _named(nodes.join(unsafe, "key", "left_semi").select("key", "n", "sketch"), ("key",), labels).withColumnRenamed("lkey", "label")
    some = some.withColumn("size", F.floor(F.log("n") / float(np.log(4 / 3)) + 1e-9))
    some = saved(some, "jaccard-rest")
    counts = some.groupBy("size", "label").agg(F.count(F.lit(1)).alias("c")).groupBy("size").agg(F.max(F.struct("c", "label")).alias("top"), F.sum("c").alias("all"))
    counts = counts.select("size", F.col("top.label").alias("major"), F.ceil((F.col("all") - F.col("top.c") + 1) / chunk).alias("cl"), F.ceil(F.col("all") / chunk).alias("cr"))
    counts = saved(counts, "jaccard-classes")
    mine = lambda c: F.pmod(F.xxhash64("key"), F.col(c))
    every = lambda c: F.explode(F.sequence(F.lit(0).cast("long"), F.col(c) - 1))
    theirs = counts.select(F.col("size").alias("to"), F.col("cl").alias("tl"))
    right = some.join(counts, "size").withColumn("to", F.explode(F.array(F.col("size") - 1, F.col("size"), F.col("size") + 1))).join(theirs, "to")
    right = right.withColumn("side", F.lit(1)).withColumn("j", mine("cr")).withColumn("i", every("tl")).withColumn("from", F.col("size"))
    near = counts.select(F.col("size").alias("from"), F.col("cr").alias("fr"))
    left = some.join(counts, "size").where("label <> major").withColumn("to", F.col("size")).withColumn("from", F.explode(F.array(F.col("size") - 1, F.col("size"), F.col("size") + 1))).join(near, "from")
    left = left.withColumn("side", F.lit(0)).withColumn("i", mine("cl")).withColumn("j", every("fr"))
    # sets of the commonest component look among the classes beside their own, where another component may be commonest
    cross = some.join(counts, "size").where("label = major").withColumn("from", F.explode(F.array(F.col("size") - 1, F.col("size") + 1))).join(near.join(counts.select(F.col("size").alias("from"), F.col("major").alias("theirs")), "from"), "from").where("theirs <> major")
    cross = cross.withColumn("to", F.col("size")).withColumn("side", F.lit(0)).withColumn("i", mine("cl")).withColumn("j", every("fr"))
    columns = ["to", "from", "i", "j", "side", "key", "n", "label", "sketch"]
    both = left.select(columns).unionByName(right.select(columns)).unionByName(cross.select(columns))
    return both.groupBy("to", "from", "i", "j").applyInPandas(_blocked, "a long, b long")


class Sets(NamedTuple):
    """What a join knows of the distinct sets."""

    rows: DataFrame  # each row of the input with n and key
    nodes: DataFrame  # key, n, sketch, first (row) and doc_id
    texts: DataFrame  # doc_id and text
    shingles: int
    salt: int
    ids_repeat: bool


def _sets(rows: DataFrame) -> Sets:
    """rows: doc_id, text, row and others that are carried along."""
    rest = [f for f in rows.schema.fields if f.name != "text"]
    made = [T.StructField(c, T.LongType()) for c in ("n", "key", "other")] + [T.StructField("sketch", T.BinaryType())]
    for salt in range(SALTS):
        described = saved(rows.mapInArrow(functools.partial(_describe, salt=salt), T.StructType(rest + made)), "jaccard-docs")
        first = [F.min(F.struct("doc_id", "row")).alias("first"), F.min("n").alias("n"), F.max("sketch").alias("sketch"), (F.min("other") != F.max("other")).alias("clash")]
        nodes = saved(described.where("n > 0").groupBy("key").agg(*first).withColumn("doc_id", F.col("first.doc_id")), "jaccard-nodes")
        shingles, clash = nodes.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.max("clash"), F.lit(False))).first()
        if not clash:
            repeat = not described.groupBy("doc_id").count().where("count > 1").isEmpty()
            return Sets(described.drop("other", "sketch"), nodes.drop("clash"), rows.select("doc_id", "text"), shingles, salt, repeat)
    raise RuntimeError("different sets have equal keys under every salt")


def _placed(docs: DataFrame, id_col: str, text_col: str, limits: Limits, *carried: Column) -> DataFrame:
    """doc_id, row, n and first (doc_id and row of the first row of the component; null for empty sets) of each row of docs, and what is carried."""
    sets = _sets(docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID)).alias("doc_id"), F.col(text_col).cast("string").alias("text"), F.monotonically_increasing_id().alias("row"), *carried))
    nodes = sets.nodes
    labels = nodes.select(F.col("key").alias("node"), F.col("key").alias("label")).limit(0)

    def verify(pairs: DataFrame) -> None:
        nonlocal labels
        pairs = saved(pairs, "jaccard-pairs")
        if pairs.count():
            labels = _joined(labels, _linked(pairs, sets, limits))

    some, amount, hot = sets.texts, sets.shingles, np.zeros(0, np.uint64)
    unsafe = labels.select(F.col("node").alias("key"))
    for turn in range(limits.rounds):
        found = _matches(some, amount, hot, sets.salt, limits)
        of = lambda kind: found.where(F.col("kind") == kind).select("a", "b")  # noqa: B023, E731
        stars = of(PAIR).distinct()
        likely = _likely(_labelled(stars, labels) if turn else stars, nodes)
        # one link a set first, which settles most; then the rest across components
        verify(likely.groupBy("b").agg(F.min("a").alias("a")).select("a", "b"))
        verify(_labelled(likely, labels).unionByName(_likely(_across(of(GROUP), labels), nodes)).distinct())
        unsafe = unsafe.unionByName(of(UNSAFE).select(F.col("b").alias("key")))
        split = saved(_divided(of(LARGE), labels), "jaccard-large")
        if not split.count():
            break
        keys = saved(of(LARGE).join(split.select("a"), "a", "left_semi").select(F.col("b").alias("key")).distinct(), "jaccard-again")
        if turn == limits.rounds - 1:
            unsafe = unsafe.unionByName(keys)
            break
        top = split.orderBy(F.desc("size"), "a").limit(limits.hot).select("a").toPandas()["a"].to_numpy(np.int64).view(np.uint64)
        hot = np.union1d(hot, top)
        some, amount = _of(sets.texts, nodes, keys, keys.count() <= limits.broadcast), nodes.join(keys, "key", "left_semi").agg(F.sum("n")).first()[0] or 0
    unsafe = saved(unsafe.distinct(), "jaccard-unsafe")  # the last step looks at them once more
    if unsafe.count():
        likely = _likely(_rest(unsafe, nodes, labels, limits.chunk), nodes)
        verify(likely.groupBy("b").agg(F.min("a").alias("a")).select("a", "b"))
        verify(_labelled(likely, labels))
    placed = saved(_named(nodes.select("key", "first"), ("key",), labels), "jaccard-placed")
    least = saved(placed.groupBy("lkey").agg(F.min("first").alias("least")), "jaccard-least")
    of_set = saved(placed.join(least, "lkey").select("key", F.col("least").alias("first")), "jaccard-components")
    return sets.rows.join(of_set, "key", "left").drop("key")


def join(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", limits: Limits = Limits()) -> DataFrame:
    """doc_id, n_shingles and component_id: one row for each row of docs."""
    known = lambda c: F.nullif(c, F.lit(NO_ID))
    with small_batches(docs.sparkSession):
        out = _placed(docs, id_col, text_col, limits)
    return out.select(known(F.col("doc_id")).alias("doc_id"), F.col("n").alias("n_shingles"), known(F.coalesce("first.doc_id", "doc_id")).alias("component_id"))


def distinct(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", limits: Limits = Limits()) -> DataFrame:
    """One row of docs of each component, that of the least doc_id and of rows alike the first read; all rows without words."""
    with small_batches(docs.sparkSession):
        out = _placed(docs, id_col, text_col, limits, F.struct(*docs.columns).alias("doc"))
    return out.where(F.col("first").isNull() | (F.col("first.row") == F.col("row"))).select("doc.*")
