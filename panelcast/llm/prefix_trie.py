"""Prefix trie of conversations by vertical bitmaps.

1. A turn becomes a 128-bit key of its role and text and its number of words; texts don't leave the scan. One exchange by ranges of conversation ids puts
   turns in order, and tasks cut their range into shards of bounded size.
2. A shard holds a bitset of its conversations for every (position, turn), and one for every length. From the root a depth-first walk intersects a node's bitset with
   the postings of the next position: what is left is a child, its bits counted are its members, and the bits that no child takes are the conversations that end.
   A node is named by the chained hash of its turns.
3. Nodes that stand in several shards (the shared prefixes) are put together by name: members, ends and the smallest member. These facts go back to their shards.
4. A node belongs to the shard of its smallest member. Sums over a subtree are taken in each shard over the nodes that belong to it, and added up over shards by name:
   the smallest member of a node below p is a member of p, too, so that its shard has p and nothing is missed or counted twice. Shards are ranges of ids, so
   that a node's list of ends is its shards' lists one after the other.
"""

from __future__ import annotations

import hashlib
import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import integer_id, stage, words

#: Conversations and turns of a shard, at most (a conversation of more turns is a shard of its own), and turns of a range, about.
SHARD_CONVS, SHARD_TURNS, RANGE_TURNS = 4096, 50_000, 200_000
KEY = 16
BLOCKS = "block bigint, ids binary, lengths binary, keys binary, words binary"
PARTS = "hash binary, block bigint, n bigint, n_ends bigint, least bigint"
NODES = "hash binary, block bigint, spans boolean, conv_id bigint, depth bigint, parent_conv_id bigint, n_convs bigint, n_children bigint, n_leaves bigint, saved_tokens bigint, ends string, ends_sha256 string"
NODE_TYPES = [pa.binary(), pa.int64(), pa.bool_(), *[pa.int64()] * 7, pa.string(), pa.string()]


def turns(convs: DataFrame, conv_col: str, turn_col: str, role_col: str, text_col: str) -> DataFrame:
    """(id, turn, key, n_words) of every row with a conversation; a null role or text is empty."""
    role, text = (F.coalesce(F.col(f"`{c}`"), F.lit("")) for c in (role_col, text_col))
    key = F.unhex(F.md5(F.concat(F.length(role).cast("string"), F.lit(":"), role, text)))
    rows = integer_id(convs, conv_col).where(F.col(f"`{conv_col}`").isNotNull())
    return rows.select(F.col(f"`{conv_col}`").cast("bigint").alias("id"), F.col(f"`{turn_col}`").alias("turn"), key.alias("key"), F.size(words(text)).alias("n_words"))


def grafted(base: int, own: list[tuple[int, list]], heads: int) -> Iterator[tuple[int, list]]:
    """Each conversation of a family with the first crc32(id) % heads turns of the family's first one, if that is there, in place of its own."""
    first = own[0][1] if own[0][0] == base else []
    for i, seq in own:
        h = zlib.crc32(str(i).encode()) % heads
        yield i, first[:h] + seq[h:]


def shards(rows: DataFrame, graft: tuple[int, int] | None, shard_convs: int, shard_turns: int, range_turns: int) -> DataFrame:
    """BLOCKS of the conversations; `block` is the smallest id. Blocks are ranges of ids that don't overlap."""
    family, heads = graft or (1, 1)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[int, list]] = []  # conversations of the block
        size = 0
        now: list[tuple[int, list]] = []  # those of the family that is being read

        def flush() -> pa.RecordBatch:
            nonlocal size
            flat = [t for _, seq in held for t in seq]
            cells = [
                held[0][0], np.array([i for i, _ in held], np.int64).tobytes(), np.array([len(s) for _, s in held], np.int64).tobytes(),
                b"".join(k for k, _ in flat), np.array([w for _, w in flat], np.int64).tobytes(),
            ]
            held.clear()
            size = 0
            return pa.RecordBatch.from_arrays([pa.array([c], t) for c, t in zip(cells, [pa.int64(), *[pa.binary()] * 4], strict=True)], names=["block", "ids", "lengths", "keys", "words"])

        def close() -> Iterator[pa.RecordBatch]:
            nonlocal size
            base = now[0][0] - now[0][0] % family
            for i, seq in grafted(base, now, heads) if graft else now:
                if held and (len(held) >= shard_convs or size + len(seq) > shard_turns):
                    yield flush()
                held.append((i, seq))
                size += len(seq)
            now.clear()

        for b in batches:
            for i, key, n in zip(*(b.column(c).to_pylist() for c in ("id", "key", "n_words")), strict=True):
                if not now or now[-1][0] != i:
                    if now and now[0][0] // family != i // family:
                        yield from close()
                    now.append((i, []))
                now[-1][1].append((key, n))
        if now:
            yield from close()
        if held:
            yield flush()

    n = max(rows.sparkSession.sparkContext.defaultParallelism, math.ceil(rows.count() / range_turns))
    by = (F.col("id") - F.pmod(F.col("id"), F.lit(family))).alias("base")
    dealt = rows.withColumn("base", by).repartitionByRange(n, "base").sortWithinPartitions("id", F.asc_nulls_first("turn"), "key")
    return dealt.select("id", "key", "n_words").mapInArrow(work, BLOCKS)


class Trie:
    """The nodes of one shard in depth-first order, a parent before its children."""

    def __init__(self, row: dict):
        self.block = row["block"]
        self.ids, lengths = np.frombuffer(row["ids"], np.int64).tolist(), np.frombuffer(row["lengths"], np.int64).tolist()
        n_words, raw = np.frombuffer(row["words"], np.int64).tolist(), row["keys"]
        start = np.append(0, np.cumsum(lengths)).tolist()
        key_at = lambda j, p: raw[KEY * (start[j] + p) : KEY * (start[j] + p + 1)]
        posting: dict[tuple[int, bytes], int] = {}
        ending: dict[int, int] = {}
        for j, length in enumerate(lengths):
            bit = 1 << j
            ending[length] = ending.get(length, 0) | bit
            for p in range(length):
                at = (p, key_at(j, p))
                posting[at] = posting.get(at, 0) | bit
        self.hash, self.parent, self.depth, self.words, self.members, self.ends = [], [], [], [], [], []
        todo = [((1 << len(self.ids)) - 1, 0, -1, hashlib.blake2b(digest_size=KEY).digest(), 0)]
        while todo:
            bits, depth, parent, name, said = todo.pop()
            own = len(self.hash)
            end = bits & ending.get(depth, 0)
            for to, x in ((self.hash, name), (self.parent, parent), (self.depth, depth), (self.words, said), (self.members, bits), (self.ends, end)):
                to.append(x)
            rest = bits ^ end
            while rest:
                j = (rest & -rest).bit_length() - 1
                key = key_at(j, depth)
                child = bits & posting[depth, key]
                todo.append((child, depth + 1, own, hashlib.blake2b(name + key, digest_size=KEY).digest(), n_words[start[j] + depth]))
                rest ^= child

    def least(self, bits: int) -> int:
        return self.ids[(bits & -bits).bit_length() - 1]

    def named(self, bits: int) -> str:
        """The conversations of a bitset, in order."""
        found = []
        while bits:
            low = bits & -bits
            found.append(str(self.ids[low.bit_length() - 1]))
            bits ^= low
        return ",".join(found)

    def parts(self) -> pa.Table:
        """PARTS of the nodes."""
        cells = [self.hash, [self.block] * len(self.hash), [x.bit_count() for x in self.members], [x.bit_count() for x in self.ends], list(map(self.least, self.members))]
        return pa.table([pa.array(c, t) for c, t in zip(cells, [pa.binary(), *[pa.int64()] * 4], strict=True)], names=["hash", "block", "n", "n_ends", "least"])

    def nodes(self, facts: dict[bytes, tuple[int, int, int]]) -> pa.Table:
        """NODES of the shard. facts: (members, ends, smallest member) of those that stand in other shards, too; their sums are this shard's share."""
        n = len(self.hash)
        children, leaves, saved = [0] * n, [0] * n, [0] * n
        total, ends, first, spans = [0] * n, [0] * n, [0] * n, [False] * n
        for k, name in enumerate(self.hash):
            spans[k] = name in facts
            total[k], ends[k], first[k] = facts[name] if spans[k] else (self.members[k].bit_count(), self.ends[k].bit_count(), self.least(self.members[k]))
        for k in range(n - 1, -1, -1):
            if first[k] == self.least(self.members[k]):
                leaves[k] += total[k] == ends[k]
                saved[k] += (total[k] - 1) * self.words[k]
                if k:
                    children[self.parent[k]] += 1
            if k:
                leaves[self.parent[k]] += leaves[k]
                saved[self.parent[k]] += saved[k]
        listed = list(map(self.named, self.ends))
        cells = [
            self.hash, [self.block] * n, spans, first, self.depth, [None if p < 0 else first[p] for p in self.parent], total, children, leaves, saved,
            [x if s else None for x, s in zip(listed, spans, strict=True)], [None if s else hashlib.sha256(x.encode()).hexdigest() for x, s in zip(listed, spans, strict=True)],
        ]
        return pa.table([pa.array(c, t) for c, t in zip(cells, NODE_TYPES, strict=True)], names=[f.split()[0] for f in NODES.split(", ")])


def part_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for k in range(b.num_rows):
            yield from Trie(b.slice(k, 1).to_pylist()[0]).parts().to_batches()


def node_rows(own: pa.Table, facts: pa.Table) -> pa.Table:
    cells = (facts.column(c).to_pylist() for c in ("hash", "n", "n_ends", "least"))
    return Trie(own.to_pylist()[0]).nodes({h: rest for h, *rest in zip(*cells, strict=True)})


def end_digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(hash, sha) of lists that come in parts, in order of hash and place; no list is held whole."""
    now, sha = None, None
    for b in batches:
        done = []
        for name, part in zip(b.column("hash").to_pylist(), b.column("ends").to_pylist(), strict=True):
            if name != now:
                if sha is not None:
                    done.append((now, sha.hexdigest()))
                now, sha = name, hashlib.sha256(part.encode())
            else:
                sha.update(b"," + part.encode())
        if done:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*done, strict=True), [pa.binary(), pa.string()], strict=True)], names=["hash", "sha"])
    if sha is not None:
        yield pa.RecordBatch.from_arrays([pa.array([now], pa.binary()), pa.array([sha.hexdigest()])], names=["hash", "sha"])


def build(
    convs: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", graft: tuple[int, int] | None = None,
    shard_convs: int = SHARD_CONVS, shard_turns: int = SHARD_TURNS, range_turns: int = RANGE_TURNS,
) -> DataFrame:
    """One row per node: conv_id (its smallest member), depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256.

    Turns are ordered by `turn`, null first, and those with one `turn` by the MD5 of role and text. A null role or text is empty; an empty text is a turn like any other.
    Rows without a conversation are left out. Ids are integers; repeated rows are repeated turns. Other columns are not read. An empty table has no root and gives an
    empty result. graft (family, heads): before, each conversation c takes the first h turns of conversation c - c % family, if that is there, in place of its
    own first h, with h = crc32(decimal c) % heads. One conversation's turns (24 bytes each) stand in one shard.
    """
    rows = stage(turns(convs, conv_col, turn_col, role_col, text_col), "trie-turns")
    blocks = stage(shards(rows, graft, shard_convs, shard_turns, range_turns), "trie-shards")
    parts = stage(blocks.mapInArrow(part_rows, PARTS), "trie-parts")
    facts = parts.groupBy("hash").agg(F.count(F.lit(1)).alias("shards"), F.sum("n").alias("n"), F.sum("n_ends").alias("n_ends"), F.min("least").alias("least")).where("shards > 1")
    replies = parts.select("hash", "block").join(facts, "hash").select("block", "hash", "n", "n_ends", "least")
    nodes = stage(blocks.groupBy("block").cogroup(replies.groupBy("block")).applyInArrow(node_rows, NODES), "trie-nodes")
    shared = nodes.where("spans")
    same = ["conv_id", "depth", "parent_conv_id", "n_convs"]
    added = ["n_children", "n_leaves", "saved_tokens"]
    whole = shared.groupBy("hash").agg(*(F.first(c).alias(c) for c in same), *(F.sum(c).alias(c) for c in added))
    lists = shared.where("ends <> ''").select("hash", "block", "ends").repartition("hash").sortWithinPartitions("hash", "block")
    digests = lists.select("hash", "ends").mapInArrow(end_digests, "hash binary, sha string")
    sha = F.coalesce("sha", F.lit(hashlib.sha256().hexdigest())).alias("ends_sha256")
    return nodes.where("not spans").select(*same, *added, "ends_sha256").union(whole.join(digests, "hash", "left").select(*same, *added, sha))
