"""Documents packed into blocks of bounded size, and the exchange of counts between blocks and buckets of keys.

A task packs its documents into blocks. What a block needs to know about the whole corpus (how often a key occurs, which
document holds it first) is asked by key: the block's distinct 64-bit keys go out in sorted runs, one for each bucket of
the key space; a bucket puts together the runs of all blocks and answers each block for its own run, in order. A key of
any frequency is one entry in each block, so that no bucket is skewed, and blocks and buckets stay bounded.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterable, Iterator
from itertools import count

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import integer_id, stage

#: Words of a block, and keys of a bucket, about. Both may be larger on a cluster with larger executors.
BLOCK_WORDS, BUCKET_KEYS = 1_900_000, 1_500_000
BLOCKS = "block bigint, ids array<bigint>, flags binary, bounds binary, words binary, stream binary, n_words bigint"
RUNS = "kind int, bucket int, block bigint, keys binary, vals binary"
REPLIES = "block bigint, kind int, bucket int, vals binary"
U64 = np.uint64


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads them evenly (the finaliser of splitmix64)."""
    x = x.astype(U64)
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def chain(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Key of a sequence that goes on: a is the key so far, b the key of the next word."""
    return mix(a * U64(0x9E3779B97F4A7C15) + b)


def squeeze(a: np.ndarray) -> bytes:
    """Compressed byte place by byte place, as the upper bytes of counts and numbers are nearly all 0."""
    return zstandard.compress(np.ascontiguousarray(np.ascontiguousarray(a).view(np.uint8).reshape(-1, a.dtype.itemsize).T).tobytes(), 1)


def expand(data: bytes, kind) -> np.ndarray:
    planes = np.frombuffer(zstandard.decompress(data), np.uint8)
    return np.ascontiguousarray(planes.reshape(np.dtype(kind).itemsize, -1).T).view(kind).ravel()


def pack_keys(keys: np.ndarray) -> bytes:
    """Sorted keys as the gaps between them: their number, the lower bytes as they are, as nothing compresses them, and the upper three compressed."""
    planes = np.ascontiguousarray(np.diff(keys, prepend=U64(0)).view(np.uint8).reshape(-1, 8).T)
    return len(keys).to_bytes(4, "little") + planes[:5].tobytes() + zstandard.compress(planes[5:].tobytes(), 1)


def unpack_keys(data: bytes) -> np.ndarray:
    n = int.from_bytes(data[:4], "little")
    planes = np.frombuffer(data[4 : 4 + 5 * n] + zstandard.decompress(data[4 + 5 * n :]), np.uint8)
    return np.cumsum(np.ascontiguousarray(planes.reshape(8, n).T).view(U64).ravel(), dtype=U64)


class Block:
    """ids and flags of documents, their bounds in `stream`, and `words`: the sorted 64-bit keys that the stream's numbers stand for."""

    def __init__(self, row: dict):
        self.block, self.ids = row["block"], row["ids"]
        self.flags, self.bounds = expand(row["flags"], np.uint8), expand(row["bounds"], np.int64)
        self.words, self.stream = unpack_keys(row["words"]), expand(row["stream"], np.uint32)


def word_keys(found: Iterable[bytes]) -> np.ndarray:
    import xxhash

    return np.fromiter(map(xxhash.xxh3_64_intdigest, found), dtype=U64)


def pack(docs: DataFrame, id_col: str, text_col: str, flag=None, block_words: int = BLOCK_WORDS) -> DataFrame:
    """One row per block. Words are lower-cased (A-Z only) runs between ASCII white space; null texts have none. flag: a column of 0 and 1 to carry."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = (TaskContext.get().partitionId() * 2**32 + k for k in count())
        number: dict[bytes, int] = {}
        ids, flags, ends, parts, size = [], [], [], [], 0

        def flush() -> pa.RecordBatch:
            keys = word_keys(number)
            # two words with one key become one word
            words, at = np.unique(keys, return_inverse=True)
            stream = at.astype(np.uint32)[np.concatenate(parts)] if size else np.zeros(0, np.uint32)
            cells = [next(names), list(ids), squeeze(np.array(flags, np.uint8)), squeeze(np.array([0, *ends], np.int64)), pack_keys(words), squeeze(stream), size]
            kinds = [pa.int64(), pa.list_(pa.int64()), *[pa.binary()] * 4, pa.int64()]
            number.clear()
            ids.clear(), flags.clear(), ends.clear(), parts.clear()
            return pa.RecordBatch.from_arrays([pa.array([c], k) for c, k in zip(cells, kinds, strict=True)], names=["block", "ids", "flags", "bounds", "words", "stream", "n_words"])

        for b in batches:
            for i, text, mark in zip(*(c.to_pylist() for c in b.columns), strict=True):
                found = (text or "").encode("utf-8", "surrogatepass").lower().split()
                for w in set(found).difference(number):
                    number[w] = len(number)
                parts.append(np.fromiter(map(number.__getitem__, found), np.int64, len(found)))
                size += len(found)
                ids.append(i)
                flags.append(mark)
                ends.append(size)
                if size >= block_words or len(ids) >= block_words // 10:
                    yield flush()
                    size = 0
        if ids:
            yield flush()

    mark = F.lit(0) if flag is None else flag.cast("int")
    return integer_id(docs, id_col).select(F.col(f"`{id_col}`").cast("bigint").alias("id"), F.col(f"`{text_col}`").alias("text"), mark.alias("flag")).mapInArrow(work, BLOCKS)


def bucket_bits(keys: int) -> int:
    """Buckets are a power of two, so that the top bits of a key name its bucket."""
    return max(4, math.ceil(math.log2(max(1, keys / BUCKET_KEYS))))


def cut_runs(kind: int, block: int, keys: np.ndarray, vals: np.ndarray, bits: int) -> Iterator[tuple]:
    """Rows of RUNS for sorted keys."""
    at = np.searchsorted(keys, np.arange(1, 2**bits, dtype=U64) << U64(64 - bits)).tolist()
    for bucket, (a, b) in enumerate(zip([0, *at], [*at, len(keys)], strict=True)):
        if b > a:
            yield kind, bucket, block, pack_keys(keys[a:b]), squeeze(vals[a:b])


def send(blocks: DataFrame, runs: Callable[[dict], Iterable[tuple]]) -> DataFrame:
    """`runs` makes the RUNS rows of a block."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.int32(), pa.int32(), pa.int64(), pa.binary(), pa.binary()]
        for b in batches:
            for k in range(b.num_rows):
                rows = list(runs(b.slice(k, 1).to_pylist()[0]))
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=["kind", "bucket", "block", "keys", "vals"])

    return blocks.mapInArrow(work, RUNS)


def answer(runs: DataFrame, value_type, put: Callable[[int, np.ndarray, np.ndarray, int], np.ndarray], extra: Callable | None = None) -> DataFrame:
    """Replies to every run. put(kind, place, vals, n) gives a value for each of the n distinct keys of a bucket, from the entries'
    places among these keys and their values. extra(kind, values, keys) may give one more reply, with block -1."""

    def work(table: pa.Table) -> pa.Table:
        kind, bucket = table.column("kind")[0].as_py(), table.column("bucket")[0].as_py()
        keys = [unpack_keys(x.as_py()) for x in table.column("keys")]
        vals = np.concatenate([expand(x.as_py(), value_type) for x in table.column("vals")])
        distinct, place = np.unique(np.concatenate(keys), return_inverse=True)
        values = put(kind, place, vals, len(distinct))
        replies = values[place]
        cuts = np.append(0, np.cumsum([len(k) for k in keys])).tolist()
        out = [(b, kind, bucket, squeeze(replies[x:y])) for b, x, y in zip(table.column("block").to_pylist(), cuts[:-1], cuts[1:], strict=True)]
        if extra is not None:
            out.append((-1, kind, bucket, squeeze(extra(kind, values, distinct))))
        return pa.table([pa.array(c, t) for c, t in zip(zip(*out, strict=True), [pa.int64(), pa.int32(), pa.int32(), pa.binary()], strict=True)], names=["block", "kind", "bucket", "vals"])

    return runs.groupBy("kind", "bucket").applyInArrow(work, REPLIES)


def sums(kind: int, place: np.ndarray, vals: np.ndarray, n: int) -> np.ndarray:
    return np.bincount(place, weights=vals, minlength=n).astype(np.int64)


def meet(blocks: DataFrame, replies: DataFrame, work: Callable[[dict, dict[int, np.ndarray]], pa.Table], value_type, schema: str) -> DataFrame:
    """work(block row, {kind: replies in the order of the block's keys}) for every block; its replies come to it by one shuffle."""
    names = [c for c in blocks.columns if c != "block"]
    kinds = dict(blocks.dtypes)
    left = blocks.select("block", *names, F.lit(None).cast("int").alias("_kind"), F.lit(None).cast("int").alias("_bucket"), F.lit(None).cast("binary").alias("_vals"))
    right = replies.where("block >= 0").select("block", *(F.lit(None).cast(kinds[c]).alias(c) for c in names), F.col("kind").alias("_kind"), F.col("bucket").alias("_bucket"), F.col("vals").alias("_vals"))

    def both(table: pa.Table) -> pa.Table:
        got: dict[int, list] = {}
        own = None
        kind, bucket, vals = (table.column(c).to_pylist() for c in ("_kind", "_bucket", "_vals"))
        for k in range(table.num_rows):
            if kind[k] is None:
                own = table.slice(k, 1).select(["block", *names]).to_pylist()[0]
            else:
                got.setdefault(kind[k], []).append((bucket[k], vals[k]))
        return work(own, {k: np.concatenate([expand(v, value_type) for _, v in sorted(x)]) for k, x in got.items()})

    return left.union(right).groupBy("block").applyInArrow(both, schema)


def staged_pack(docs: DataFrame, id_col: str, text_col: str, flag=None, block_words: int = BLOCK_WORDS, name: str = "blocks") -> tuple[DataFrame, int]:
    """The blocks, written to the shared folder, and their number of words in all."""
    blocks = stage(pack(docs, id_col, text_col, flag, block_words), name)
    return blocks, blocks.agg(F.coalesce(F.sum("n_words"), F.lit(0))).first()[0]
