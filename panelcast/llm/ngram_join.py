"""N-gram Jaccard join by T-occurrence search with DivideSkip.

Two documents link when den * |intersection| >= num * |union| of their sets of word n-grams. Sets are exact but for
64-bit keys: documents of s distinct n-grams hold two with one key with a chance of about s*s / 2**65.

1. Of every document a quarter of the keys (by the key itself) is counted over the corpus. One that has more keys of its own than a
   link allows has no partner and is done with. Both halves of each set's digest ask for the smallest id that holds them, so that equal sets are one class,
   with its smallest id, in the same exchange.
2. For the others all keys are counted. In the order of frequency, rarest first, linked sets share one of their first
   size - need + 1 keys. Documents that share such a key, directly or through others, form a family.
3. Every link comes from a search: a document's need T of shared keys is looked for in the inverted lists of its keys. The L longest
   lists are set aside; the short ones are merged with a heap that skips what can't reach T - L; what reaches it is looked up in the long ones by binary
   search. A family of bounded size is searched in one task (families.py). What a search linked needs no search among itself: after a few pilots
   members are numbered by component and searched only in what their lists hold of later components, so that groups of near copies don't walk their own lists.
4. A larger family is dealt to parts by id, each with inverted lists of its own, and its seekers to blocks. In rounds, a few pilots are searched in all parts; the
   documents outside the largest component that remain are searched in all parts, or among the documents that share a prefix key with them, key by key.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator
from functools import partial
from hashlib import blake2b
from heapq import heapify, heappop, heappush, heapreplace
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .blocks import U64, Block, answer, bucket_bits, chain, cut_runs, expand, meet, mix, send, squeeze, staged_pack, sums
from .common import stage
from .families import FAMILY_KEYS, families_of, search, shared_keys

#: The weight of a binary search against a step of the merge (mu of DivideSkip).
PROBE = 0.003
#: Long lists that are asked at once.
PROBES = 24

SETS = "id bigint, n bigint, first bigint, keys binary"
RANKED = "id bigint, n bigint, keys binary, prefix array<bigint>"


def need(n, num: int, den: int):
    """Keys that a set of n must share with any partner."""
    return -(-num * n // den)


def pair_need(a, b, num: int, den: int):
    return -(-num * (a + b) // (num + den))


def shingle_sets(block: Block, n: int) -> list[np.ndarray]:
    """Sorted distinct keys of each document's n-grams. A document of fewer words has one for all of them; one of none, none."""
    words = block.words[block.stream] if len(block.stream) else np.zeros(0, U64)
    key = mix(words)
    grams = key
    for k in range(1, n):
        grams = chain(grams[:-1], words[k:]) if len(grams) > 1 else grams[:0]
    out = []
    for a, b in zip(block.bounds[:-1].tolist(), block.bounds[1:].tolist(), strict=True):
        if b - a >= n:
            out.append(np.unique(grams[a : b - n + 1]))
        elif b > a:
            one = key[a : a + 1]
            for k in range(a + 1, b):
                one = chain(one, words[k : k + 1])
            out.append(one)
        else:
            out.append(np.zeros(0, U64))
    return out


def sampled(keys: np.ndarray) -> np.ndarray:
    return (keys & U64(3)) == 0


def _counted(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    flat = np.concatenate(sets) if sets else np.zeros(0, U64)
    keys, n = np.unique(flat, return_counts=True)
    return keys, n.astype(np.int64)


def halves(sets: list[np.ndarray]) -> np.ndarray:
    """Of each set the two halves of its digest, as rows."""
    raw = b"".join(blake2b(s.tobytes(), digest_size=16).digest() for s in sets)
    return np.frombuffer(raw, U64).reshape(-1, 2)


def candidates(docs: DataFrame, id_col: str, text_col: str, n: int, num: int, den: int, block_words: int | None) -> DataFrame:
    """SETS of every document: `first` is the smallest id of its class, keys are only there for this one, and where it may have a partner.

    Different sets with one half of a digest would get a `first` that is too small for some; the larger answer of the two halves is right unless both collide.
    """
    size = {"block_words": block_words} if block_words else {}
    blocks, words = staged_pack(docs, id_col, text_col, name="join-blocks", **size)
    bits = bucket_bits(words // 4)
    few_bits = bucket_bits(blocks.agg(F.coalesce(F.sum(F.size("ids")), F.lit(0))).first()[0])

    def named(block: Block, sets: list[np.ndarray]) -> np.ndarray:
        """The documents with a set and an id."""
        return np.array([k for k, (i, s) in enumerate(zip(block.ids, sets, strict=True)) if i is not None and len(s)], np.int64)

    def ask(row: dict) -> Iterator[tuple]:
        block = Block(row)
        sets = shingle_sets(block, n)
        yield from cut_runs(0, block.block, *_counted([s[sampled(s)] for s in sets]), bits)
        own = named(block, sets)
        ids, digests = np.array([block.ids[k] for k in own], np.int64), halves([sets[k] for k in own])
        for half in (0, 1):
            keys, at = np.unique(digests[:, half], return_inverse=True)
            least = np.full(len(keys), np.iinfo(np.int64).max)
            np.minimum.at(least, at, ids)
            yield from cut_runs(1 + half, block.block, keys, least, few_bits)

    def put(kind: int, place: np.ndarray, vals: np.ndarray, size: int) -> np.ndarray:
        if kind == 0:
            return sums(kind, place, vals, size)
        least = np.full(size, np.iinfo(np.int64).max)
        np.minimum.at(least, place, vals)
        return least

    def sift(row: dict, got: dict[int, np.ndarray]) -> pa.Table:
        block = Block(row)
        sets = shingle_sets(block, n)
        keys, _ = _counted([s[sampled(s)] for s in sets])
        shared = keys[got[0] > 1] if 0 in got else keys
        own = named(block, sets)
        digests = halves([sets[k] for k in own])
        told = [got[1 + half][np.unique(digests[:, half], return_inverse=True)[1]] if len(own) else np.zeros(0, np.int64) for half in (0, 1)]
        firsts = dict(zip(own.tolist(), np.maximum(*told).tolist(), strict=True))
        out = []
        for k, (i, s) in enumerate(zip(block.ids, sets, strict=True)):
            keep = k in firsts and firsts[k] == i
            if keep:
                some = s[sampled(s)]
                at = np.minimum(np.searchsorted(shared, some), max(len(shared) - 1, 0))
                hits = int((shared[at] == some).sum()) if len(shared) else 0
                keep = hits >= len(some) - (len(s) - need(len(s), num, den))
            out.append((i, len(s), firsts.get(k), s.tobytes() if keep else None))
        return pa.table([pa.array(c, t) for c, t in zip(zip(*out, strict=True), [pa.int64(), pa.int64(), pa.int64(), pa.binary()], strict=True)], names=["id", "n", "first", "keys"])

    return meet(blocks, answer(send(blocks, ask), np.int64, put), sift, np.int64, SETS)


def pack_sets(sets: DataFrame, keys_in_block: int) -> DataFrame:
    """Blocks of sets: block, ids, bounds, keys."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = (TaskContext.get().partitionId() * 2**32 + k for k in count())
        ids, some, size = [], [], 0

        def flush() -> pa.RecordBatch:
            bounds = np.append(0, np.cumsum([len(x) for x in some])).astype(np.int64)
            cells = [next(names), list(ids), squeeze(bounds), b"".join(x.tobytes() for x in some)]
            ids.clear(), some.clear()
            return pa.RecordBatch.from_arrays([pa.array([c], t) for c, t in zip(cells, [pa.int64(), pa.list_(pa.int64()), pa.binary(), pa.binary()], strict=True)], names=["block", "ids", "bounds", "keys"])

        for b in batches:
            for i, raw in zip(b.column("id").to_pylist(), b.column("keys").to_pylist(), strict=True):
                ids.append(i)
                some.append(np.frombuffer(raw, U64))
                size += len(some[-1])
                if size >= keys_in_block:
                    yield flush()
                    size = 0
        if ids:
            yield flush()

    return sets.select("id", "keys").mapInArrow(work, "block bigint, ids array<bigint>, bounds binary, keys binary")


def ranked(sets: DataFrame, num: int, den: int, keys_in_block: int = 2_000_000) -> DataFrame:
    """RANKED of the sets with a key in their prefix that another has too: `keys` are those that others have, rarest first."""
    blocks = stage(pack_sets(sets, keys_in_block), "set-blocks")
    total = blocks.agg(F.coalesce(F.sum(F.length("keys")), F.lit(0))).first()[0] // 8
    bits = bucket_bits(total)

    def split(row: dict) -> list[np.ndarray]:
        bounds, flat = expand(row["bounds"], np.int64).tolist(), np.frombuffer(row["keys"], U64)
        return [flat[a:b] for a, b in zip(bounds[:-1], bounds[1:], strict=True)]

    def ask(row: dict) -> Iterator[tuple]:
        yield from cut_runs(0, row["block"], *_counted(split(row)), bits)

    def rank(row: dict, got: dict[int, np.ndarray]) -> pa.Table:
        sets = split(row)
        keys, _ = _counted(sets)
        out = []
        for i, s in zip(row["ids"], sets, strict=True):
            n = got[0][np.searchsorted(keys, s)]
            order = np.lexsort((s, n))
            first = order[: len(s) - need(len(s), num, den) + 1]
            prefix = s[first[n[first] > 1]]
            if len(prefix):
                out.append((i, len(s), s[order[n[order] > 1]].tobytes(), prefix.view(np.int64)))
        cols = list(zip(*out, strict=True)) or [[]] * 4
        return pa.table([pa.array(c, t) for c, t in zip(cols, [pa.int64(), pa.int64(), pa.binary(), pa.list_(pa.int64())], strict=True)], names=["id", "n", "keys", "prefix"])

    return meet(blocks, answer(send(blocks, ask), np.int64, sums), rank, np.int64, RANKED)


def merge_skip(lists: list[list[int]], least: int) -> Iterator[tuple[int, int]]:
    """(member, in how many lists) of the members that stand in `least` of the sorted lists or more.

    The heap holds the front of each list. Below the front that is the `least`-th of all, a member can't stand in enough lists: after a member without a
    hit, the lists before it go on to that front by binary search.
    """
    width = len(lists)
    at, ends = [0] * width, list(map(len, lists))
    heap = [x[0] * width + k for k, x in enumerate(lists)]
    heapify(heap)
    while len(heap) >= least:
        member, times = heap[0] // width, 0
        while heap and heap[0] // width == member:
            k = heap[0] % width
            at[k] = i = at[k] + 1
            if i < ends[k]:
                heapreplace(heap, lists[k][i] * width + k)
            else:
                heappop(heap)
            times += 1
        if times >= least:
            yield member, times
        elif len(heap) >= least > 1:
            out = [heappop(heap) % width for _ in range(least - 1)]
            front = heap[0] // width
            for k in out:
                at[k] = i = bisect_left(lists[k], front, at[k])
                if i < ends[k]:
                    heappush(heap, lists[k][i] * width + k)


class Lists:
    """Inverted lists of sets: for each key the numbers of the sets that hold it, in order."""

    def __init__(self, num: int, den: int, sizes: np.ndarray, payloads: list):
        sets = [np.frombuffer(x, U64) for x in payloads]
        self.num, self.den, self.sizes, self.m = num, den, sizes, len(sets)
        flat = np.concatenate(sets)
        owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
        order = np.argsort(flat, kind="stable")
        self.posting = owner[order]
        self.keys, self.start, length = np.unique(flat[order], return_index=True, return_counts=True)
        self.end = self.start + length
        #: All lists one after the other, as (number of the key, member), in order.
        self.pairs = np.repeat(np.arange(len(self.keys)), length) * self.m + self.posting

    def search(self, size: int, payload: object, after: int = 0) -> np.ndarray:
        """The members from `after` on that link to a set of so many keys. Its payload may leave out keys that no other set has."""
        keys, num, den = np.frombuffer(payload, U64), self.num, self.den
        place = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        place = place[self.keys[place] == keys]
        start = np.searchsorted(self.pairs, place * self.m + after) if after else self.start[place]
        length = self.end[place] - start
        some = np.flatnonzero(length)
        least = int(need(size, num, den))
        if len(some) < least:
            return np.zeros(0, np.int64)
        some = some[np.argsort(length[some], kind="stable")]
        place, start, length = place[some], start[some], length[some]
        n_long = min(int(least / (PROBE * np.log2(max(int(length[-1]), 2)) + 1)), least - 1)
        short, long = len(place) - n_long, place[len(place) - n_long :]
        found = list(merge_skip([self.posting[a:b].tolist() for a, b in zip(start[:short].tolist(), self.end[place[:short]].tolist(), strict=True)], least - n_long))
        if not found:
            return np.zeros(0, np.int64)
        member, times = (np.array(x) for x in zip(*found, strict=True))
        goal = pair_need(size, self.sizes[member], num, den)
        for k in range(0, n_long, PROBES):
            # who has enough, or can't have enough any more, is not looked up further
            ask = np.flatnonzero((times < goal) & (times + n_long - k >= goal))
            if not len(ask):
                break
            want = long[k : k + PROBES, None] * self.m + member[ask]
            at = np.minimum(np.searchsorted(self.pairs, want), len(self.pairs) - 1)
            times[ask] += (self.pairs[at] == want).sum(axis=0)
        return member[times >= goal]


def join(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = 5, num: int = 80, den: int = 100, block_words: int | None = None, family_keys: int = FAMILY_KEYS) -> DataFrame:
    """One row per row: id, n_shingles, component_id: the smallest id that links lead to, its own included.

    Words are lower-cased (A-Z) runs between ASCII white space. Null and blank texts have no n-grams and no links, and neither
    have rows without id, whose component is null. Ids should be unique; rows that share one don't fail, and get its smallest component.
    An empty table gives an empty one.
    """
    sets = stage(candidates(docs, id_col, text_col, n, num, den, block_words), "sets")
    rows = stage(ranked(sets.where(F.col("keys").isNotNull()).select("id", "keys"), num, den), "ranked")
    families = families_of(shared_keys(rows.select("id", F.explode("prefix").alias("key"))))
    grouped = rows.join(families.select("id", F.col("root").alias("family")), "id").select("family", "id", "n", "keys", "prefix")
    roots = search(grouped, partial(Lists, num, den), family_keys).groupBy("id").agg(F.min("root").alias("root")).select(F.col("id").alias("first"), "root")
    out = sets.select("id", "n", "first").join(roots, "first", "left")
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.coalesce("root", "first", "id").alias("component_id"))
