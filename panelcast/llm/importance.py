"""Target-distribution importance resampling over hashed word runs.

A 256-byte table lower-cases A-Z and blanks every ASCII separator of a text's UTF-8 bytes, so that bytes.split() yields its words. A feature
is a run of 1 to n words joined by one blank; its CRC-32 goes on from the CRC of the run without the last word (the seed), so no run is ever
put together. Each task counts features by bucket in Counters and sends at most one row a bucket, and the tasks' rows are summed by bucket. The
log ratio of a bucket's share in the target to its share in the documents is its gain; a document's weight is the sum of its features' gains, and the
documents with the highest weight plus Gumbel noise are drawn, which is drawing by weight without replacement.
"""

from __future__ import annotations

import hashlib
import math
import zlib
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators import ranks
from .common import stage

#: Blank for separators, the lower-case letter for A-Z, and every other byte as it is: digits, a-z and all bytes of characters beyond ASCII.
TABLE = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
#: Distinct words that a task keeps at once: counts are folded into buckets, and remembered gains are forgotten, beyond.
KEPT_WORDS = 500_000


def split(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").translate(TABLE).split()


def longer_runs(found: list[bytes], n: int) -> Iterator[int]:
    """CRC-32 of every run of 2 to n words: that of the run without its last word is the seed."""
    if n < 2:
        return
    tails = [b" " + w for w in found]
    seeds = list(map(zlib.crc32, found))
    for k in range(1, n):
        seeds = list(map(zlib.crc32, tails[k:], seeds))
        yield from seeds


def counted(n: int, buckets: int, kept: int = KEPT_WORDS) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """What a task does with its texts: Counters of words and longer runs, folded into buckets when they hold too many."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        singles, runs = Counter(), Counter()

        def fold() -> None:
            for codes, counts in ((map(zlib.crc32, singles), singles.values()), (runs, runs.values())):
                np.add.at(total, np.fromiter(codes, np.int64) % buckets, np.fromiter(counts, np.int64))
            singles.clear(), runs.clear()

        for b in batches:
            for body in b.column(0):
                found = split(body.as_py())
                singles.update(found)
                runs.update(longer_runs(found, n))
                if len(singles) + len(runs) > kept:
                    fold()
        fold()
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], names=["bucket", "count"])

    return work


def bucket_counts(texts: DataFrame, text: Column, n: int, buckets: int) -> DataFrame:
    """(bucket, count) of the features of all texts."""
    partial = texts.select(text.alias("text")).mapInArrow(counted(n, buckets), "bucket bigint, count bigint")
    return partial.groupBy("bucket").agg(F.sum("count").alias("count"))


def gains(docs: DataFrame, target: DataFrame, doc_text: Column, target_text: Column, n: int, buckets: int) -> np.ndarray:
    """The gain of each bucket, in thousandths. The one thing that comes to the driver and goes to all tasks: `buckets` numbers at any input size."""
    held = []
    for frame, text in ((docs, doc_text), (target, target_text)):
        counts = np.zeros(buckets, object)  # Python integers: products stay exact at any size
        for bucket, count in bucket_counts(frame, text, n, buckets).collect():
            counts[bucket] = count
        held.append(counts)
    (s, t), (all_s, all_t) = held, (int(x.sum()) for x in held)
    return np.array([math.floor(1000 * math.log((int(b) + 1) * (all_s + buckets) / ((int(a) + 1) * (all_t + buckets)))) for a, b in zip(s, t, strict=True)], np.int64)


def noise(seed: int, name: str) -> int:
    """Gumbel noise in thousandths from the first 32 bits of a SHA-256."""
    h = int(hashlib.sha256(f"{seed}:{name}".encode("utf-8", "surrogatepass")).hexdigest()[:8], 16)
    return math.floor(-1000 * math.log(-math.log((h + 0.5) / 2**32)))


def weigh(docs: DataFrame, gain: np.ndarray, id_col: str, text_col: str, n: int, seed: int) -> DataFrame:
    """(id, n_words, n_features, weight, score) of every row, text by text."""
    buckets, kind = len(gain), docs.select(F.col(f"`{id_col}`")).schema[0].dataType.simpleString()

    class Known(dict):
        """Gains of words seen lately."""

        def __missing__(self, word: bytes) -> int:
            if len(self) >= KEPT_WORDS:
                self.clear()
            self[word] = value = int(gain[zlib.crc32(word) % buckets])
            return value

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Known()
        for b in batches:
            out = []
            for name, text in zip(b.column("name"), b.column("text"), strict=True):
                found = split(text.as_py())
                weight = sum(map(known.__getitem__, found))
                runs = np.fromiter(longer_runs(found, n), np.int64) % buckets
                weight += int(gain[runs].sum())
                out.append((len(found), len(found) + len(runs), weight, weight + noise(seed, name.as_py())))
            cells = [pa.array(c, pa.int64()) for c in (zip(*out, strict=True) if out else [[]] * 4)]
            yield pa.RecordBatch.from_arrays([b.column("id"), *cells], names=["id", "n_words", "n_features", "weight", "score"])

    own = F.col(f"`{id_col}`")
    rows = docs.select(own.alias("id"), F.coalesce(own.cast("string"), F.lit("")).alias("name"), F.col(f"`{text_col}`").alias("text"))
    return rows.mapInArrow(work, f"id {kind}, n_words bigint, n_features bigint, weight bigint, score bigint")


def resample(
    docs: DataFrame, target: DataFrame, id_col: str = "doc_id", text_col: str = "text", target_text: str = "text", n: int = 1, buckets: int = 10_000, percent: int = 10,
    min_words: int = 20, seed: int = 2024,
) -> DataFrame:
    """One row per row of docs: id, n_features, weight, score, rank; rank is null where the row isn't drawn.

    Of the rows with min_words words or more, floor(percent / 100) of their number are drawn: the highest scores, ties to the smaller id (null ids last). Null
    and empty texts have no features and weight 0. Repeated rows each count and each have a rank; which of two with one id and score comes first is left open. An
    empty target makes every gain that of an unseen bucket. An empty table gives an empty one. Ranks are taken in ranges of the score, so that no task orders all rows.
    """
    gain = gains(docs, target, F.col(f"`{text_col}`"), F.col(f"`{target_text}`"), n, buckets)
    rows = stage(weigh(docs, gain, id_col, text_col, n, seed), "weighed")
    able = F.col("n_words") >= min_words
    drawn = rows.where(able).count() * percent // 100
    names = [F.col("id").alias(id_col), "n_features", "weight", "score"]
    ranked = ranks.ordinal(rows.where(able).withColumn("_all", F.lit(0)), ["_all"], "score", [F.asc_nulls_last("id")])
    return ranked.select(*names, F.when(F.col("rank") <= drawn, F.col("rank")).alias("rank")).union(rows.where(~able).select(*names, F.lit(None).cast("bigint")))


def select(docs: DataFrame, target: DataFrame, id_col: str = "doc_id", **how) -> DataFrame:
    """The documents drawn, with all their columns and in no order. Ids must be unique; `how` goes to resample."""
    drawn = resample(docs, target, id_col, **how).where("rank is not null").select(F.col(f"`{id_col}`").alias("_drawn"))
    return docs.join(drawn, docs[f"`{id_col}`"].eqNullSafe(F.col("_drawn")), "left_semi")
