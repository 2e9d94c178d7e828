"""Substring dedup by content-defined chunking.

A gear rolling hash over the bytes of a text sets the chunk bounds, so that an insertion moves the bounds near it only and
a shared passage is cut alike in every text. What is compared are windows: from each chunk on, and up to each chunk, the fewest chunks in a row that have
MIN_WORDS words. Blocks of documents ask buckets of keys, for each of their distinct windows, for the smallest document that holds it, if more
than one does. So every run of chunks of MIN_WORDS words that any one earlier document holds in a row is found whole, whoever holds pieces
of it before, and pieces of several documents don't add up to a repeat.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .blocks import U64, answer, bucket_bits, cut_runs, expand, meet, mix, send, squeeze
from .common import integer_id, stage

#: Chunk bounds in bytes, the number of hash bits that must be 0 at a bound, and the bytes that the hash looks back on.
LEAST, MOST, BITS, WINDOW, SEED = 16, 96, 4, 16, 20_240_601
#: Words of a repeat at least. A passage of over 50 words keeps about 40 of them in whole chunks.
MIN_WORDS = 24
BLOCK_BYTES = 16_000_000
ALONE = np.iinfo(np.int64).max
#: Factor of the polynomial keys of windows, and its inverse modulo 2**64.
STEP = 0x9E3779B97F4A7C15
BACK = pow(STEP, -1, 2**64)
CHUNKS = "block bigint, ids array<bigint>, bounds binary, ends binary, words binary, inside binary, keys binary, n_chunks bigint"
REPEATS = "doc_id bigint, first_doc_id bigint, start bigint, end bigint, n_words bigint, n_chunks bigint"


def gear_table() -> np.ndarray:
    return np.random.default_rng(SEED).integers(0, 2**32, 256, dtype=np.uint32)


def bounds_of(data: np.ndarray, starts: np.ndarray) -> Iterator[list[int]]:
    """Chunk ends of each text; `starts` are the texts' bounds in `data`. The window is no longer than the least chunk, so that no hash looks beyond its text."""
    h = gear_table()[data]
    width = 1
    while width < WINDOW:
        h[width:] += h[:-width] << np.uint32(width)
        width *= 2
    marks = np.flatnonzero((h >> np.uint32(12)) & np.uint32(2**BITS - 1) == 0) + 1
    inside = np.append((data & 0xC0) == 0x80, False)  # bytes that go on with a character, before which no chunk ends
    marks = marks[~inside[marks]]
    at, marks = np.searchsorted(marks, starts, side="right").tolist(), marks.tolist()
    h[inside[1:]] = 0

    def forced(last: int) -> int:
        """Without a mark the chunk ends at the last of the greatest hashes in reach, so that texts that repeat a short pattern are cut alike, too."""
        reach = h[last + LEAST - 1 : last + MOST]
        return last + MOST - int(reach[::-1].argmax())

    for k, (a, b) in enumerate(zip(starts[:-1].tolist(), starts[1:].tolist(), strict=True)):
        out, last = [], a
        for m in marks[at[k] : at[k + 1]]:
            while m - last > MOST:
                last = forced(last)
                out.append(last)
            if m - last >= LEAST:
                out.append(m)
                last = m
        while b - last > MOST:
            last = forced(last)
            out.append(last)
        if b > last:
            out.append(b)
        yield out


def chunks(docs: DataFrame, id_col: str, text_col: str, block_bytes: int) -> DataFrame:
    """Blocks of documents with the bounds, the words (by their first bytes) and the 64-bit digests of their chunks, and which chunks begin inside a word."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = (TaskContext.get().partitionId() * 2**32 + k for k in count())
        ids: list[int] = []
        texts: list[bytes] = []
        size = 0

        def flush() -> pa.RecordBatch:
            whole = b"".join(texts)
            data = np.frombuffer(whole, np.uint8)
            starts = np.append(0, np.cumsum([len(t) for t in texts]))
            white = (data == 32) | ((data >= 9) & (data <= 13))
            first = ~white & np.append(True, white[:-1])
            first[starts[:-1][starts[:-1] < len(data)]] |= ~white[starts[:-1][starts[:-1] < len(data)]]
            before = np.append(0, np.cumsum(first))
            ends = list(bounds_of(data, starts))
            n = [len(e) for e in ends]
            flat = np.array([x for e in ends for x in e], np.int64)
            begin = np.append(0, flat[:-1]) if len(flat) else flat
            digest = [blake2b(whole[a:b], digest_size=8).digest() for a, b in zip(begin.tolist(), flat.tolist(), strict=True)]
            keys = np.frombuffer(b"".join(digest), U64)
            offset = np.repeat(starts[:-1], n)
            cells = [next(names), list(ids), squeeze(np.append(0, np.cumsum(n)).astype(np.int64)), squeeze(flat - offset), squeeze((before[flat] - before[begin]).astype(np.int32)), squeeze(~white[begin] & ~first[begin]), squeeze(keys), len(keys)]
            ids.clear(), texts.clear()
            return pa.RecordBatch.from_arrays([pa.array([c], k) for c, k in zip(cells, [pa.int64(), pa.list_(pa.int64()), *[pa.binary()] * 5, pa.int64()], strict=True)], names=["block", "ids", "bounds", "ends", "words", "inside", "keys", "n_chunks"])

        for b in batches:
            for i, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                if i is None or not text:
                    continue
                ids.append(i)
                texts.append(text.encode("utf-8", "surrogatepass"))
                size += len(texts[-1])
                if size >= block_bytes:
                    yield flush()
                    size = 0
        if ids:
            yield flush()

    return integer_id(docs, id_col).select(F.col(f"`{id_col}`").cast("bigint").alias("id"), F.col(f"`{text_col}`").alias("text")).mapInArrow(work, CHUNKS)


def windows(row: dict, min_words: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """First chunk, chunk after the last, number of the document in the block, and key of each window.

    A window counts the word that its first bound cuts, so that equal chunks are equal windows whatever stands before them.
    """
    bounds, keys = expand(row["bounds"], np.int64), expand(row["keys"], U64)
    upto = np.append(0, np.cumsum(expand(row["words"], np.int32), dtype=np.int64))
    at = np.arange(len(keys))
    number = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    since = upto[:-1] - expand(row["inside"], bool)  # words before a window that begins here; never falls
    on = np.maximum(np.searchsorted(upto, since + min_words), at + 1)
    fit = on <= bounds[number + 1]
    back = np.minimum(np.searchsorted(since, upto[1:] - min_words, side="right") - 1, at)
    # windows that are the shortest both ways come once
    more = (back >= bounds[number]) & ~(fit[back] & (on[back] == at + 1))
    first, last = np.append(at[fit], back[more]), np.append(on[fit], at[more] + 1)
    powers = lambda x: np.multiply.accumulate(np.append(U64(1), np.full(len(keys), x, U64)))
    sums = np.append(U64(0), np.cumsum(mix(keys) * powers(BACK)[:-1], dtype=U64))
    return first, last, np.append(number[fit], number[more]), mix((sums[last] - sums[first]) * powers(STEP)[first] + (last - first).astype(U64))


def first_holders(kind: int, place: np.ndarray, vals: np.ndarray, n: int) -> np.ndarray:
    """The smallest id of each key, or ALONE where it is also the largest. Each entry brings the smallest and the largest of its block."""
    least, most = np.full(n, ALONE), np.full(n, np.iinfo(np.int64).min)
    np.minimum.at(least, place, vals["least"])
    np.maximum.at(most, place, vals["most"])
    return np.where(least == most, ALONE, least)


def repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = MIN_WORDS, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """One row per repeat: id, first_doc_id (the smallest id that holds each of its windows), start and end in UTF-8 bytes, n_words, n_chunks.

    The first holder has no row for what it holds itself, so that all rows' spans can be cut and each chunk stays at least once, in the smallest
    document that holds it. Where parts of a passage have other first holders, each has a row, and these overlap. Repeats inside one
    document alone are none. Rows without id or text are not compared; rows with one id count as one document. Keys have 64 bits: n windows (up to two
    a chunk) hold two with one key with a chance of about n*n / 2**65. n_words counts a word that the start cuts. An empty table gives an empty one.
    """
    pair = np.dtype([("least", np.int64), ("most", np.int64)])
    blocks = stage(chunks(docs, id_col, text_col, block_bytes), "chunk-blocks")
    bits = bucket_bits(2 * blocks.agg(F.coalesce(F.sum("n_chunks"), F.lit(0))).first()[0])

    def ask(row: dict) -> Iterator[tuple]:
        _, _, number, keys = windows(row, min_words)
        doc = np.array(row["ids"], np.int64)[number]
        distinct, place = np.unique(keys, return_inverse=True)
        vals = np.empty(len(distinct), pair)
        vals["least"], vals["most"] = ALONE, np.iinfo(np.int64).min
        np.minimum.at(vals["least"], place, doc)
        np.maximum.at(vals["most"], place, doc)
        yield from cut_runs(0, row["block"], distinct, vals, bits)

    replies = stage(answer(send(blocks, ask), pair, first_holders), "chunk-holders")

    def find(row: dict, got: dict[int, np.ndarray]) -> pa.Table:
        first, last, number, keys = windows(row, min_words)
        doc = np.array(row["ids"], np.int64)[number]
        holder = got[0][np.unique(keys, return_inverse=True)[1]] if len(keys) else np.zeros(0, np.int64)
        shared = np.flatnonzero((holder != ALONE) & (holder != doc))
        shared = shared[np.lexsort((first[shared], holder[shared], number[shared]))]
        first, last, number, holder, doc = (x[shared] for x in (first, last, number, holder, doc))
        bounds, ends, inside = expand(row["bounds"], np.int64), expand(row["ends"], np.int64), expand(row["inside"], bool)
        start = np.append(0, ends[:-1]) if len(ends) else ends
        start[bounds[:-1][bounds[:-1] < len(start)]] = 0
        upto = np.append(0, np.cumsum(expand(row["words"], np.int32), dtype=np.int64))
        # windows of one document and holder that overlap are one row
        group = np.cumsum(np.append(False, (number[1:] != number[:-1]) | (holder[1:] != holder[:-1])))[: len(number)] * (len(ends) + 1)
        reach = np.maximum.accumulate(group + last)
        opens = np.flatnonzero(np.append(True, (group + first)[1:] >= reach[:-1])[: len(number)])
        x, y = first[opens], (reach - group)[np.append(opens[1:], len(number))[: len(opens)] - 1]
        cols = [doc[opens], holder[opens], start[x], ends[y - 1], upto[y] - upto[x] + inside[x], y - x]
        return pa.table([pa.array(c, pa.int64()) for c in cols], names=["doc_id", "first_doc_id", "start", "end", "n_words", "n_chunks"])

    return meet(blocks, replies, find, np.int64, REPEATS).withColumnRenamed("doc_id", id_col)


def cut_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The same rows and columns with every repeat cut out of the text; documents without repeats keep theirs. Ids must be unique."""
    spans = repeats(docs, id_col, text_col, **options).groupBy(F.col(id_col).alias("_id")).agg(F.sort_array(F.collect_list(F.struct("start", "end"))).alias("_spans"))
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("_row"), F.col(f"`{id_col}`").alias("_id"), F.encode(F.col(f"`{text_col}`"), "utf-8").alias("_data")).join(spans, "_id", "left")
    empty = F.struct(F.lit(0).cast("bigint").alias("at"), F.lit("").cast("binary").alias("kept"))
    data = F.col("_data")
    kept = F.aggregate(
        "_spans", empty,
        lambda acc, s: F.struct(F.greatest(s["end"], acc["at"]).alias("at"), F.concat(acc["kept"], F.substring(data, (acc["at"] + 1).cast("int"), F.greatest(s["start"] - acc["at"], F.lit(0)).cast("int"))).alias("kept")),
        lambda acc: F.concat(acc["kept"], F.substring(data, (acc["at"] + 1).cast("int"), F.length(data) - acc["at"].cast("int"))),
    )
    text = F.when(F.col("_spans").isNull(), F.col("_row")[text_col]).otherwise(F.decode(kept, "utf-8"))
    return rows.select(*(text.alias(c) if c == text_col else F.col("_row")[c].alias(c) for c in docs.columns))
