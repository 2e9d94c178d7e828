"""Near-duplicates by HyperMinHash sketches.

1. The smallest 64-bit key of each of 256 buckets of a document's word n-grams (the first byte names the bucket) becomes a 16-bit register: the number of its leading zeros,
   and the ten bits behind the leading one. A register of 0 is an empty bucket. Equal sets (128-bit digests) are one class from here on.
2. Registers are dealt to bands, and a band with three filled registers or more gives a key. Sets of 512 n-grams or more have bands of r registers, r so that a pair
   at the threshold shares no band with a chance below 1e-8. Smaller sets leave registers empty, so that theirs are dealt in wider bands, by several dealings (LAYOUTS),
   with a chance below 1e-7 by the same count. Sets below 64 n-grams are too small for registers to tell apart: they are keyed by the first
   size - need + 1 of their keys in order, one of which two linked sets must share. A set near the bound of a layout is keyed by both.
3. Documents that share a key form families, which are searched in parts of bounded size (families.py). A member's registers are held against all others' at
   once: matches less those expected by collision of unrelated minima, over the registers that either fills, estimate the Jaccard similarity. Pairs
   six standard errors below the threshold are left, all others are confirmed on the full sets, read again from the texts of family members only.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from functools import partial
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .blocks import U64, chain, mix, word_keys
from .common import integer_id, stage
from .families import FAMILY_KEYS, families_of, search, shared_keys
from .ngram_join import need, pair_need

BUCKETS, MANTISSA = 256, 10
#: Sets of fewer n-grams are keyed by their smallest keys; others by (from n-grams, bands, dealings) up to SPARSE n-grams.
TINY, SPARSE, LAYOUTS = 64, 512, ((64, 16, 4), (128, 32, 2), (256, 64, 1))
LEAST_FILLED, MISS, ERRORS = 3, 1e-8, 6
#: Words that a task turns into sketches at once, about.
CHUNK_WORDS = 500_000
SKETCHES = "id bigint, n bigint, digest binary, registers binary, firsts binary"


def documents_keys(texts: list[str | None], n: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys of each text's n-grams, in order, and their bounds. A text of fewer words has one key for all of them; one of none, none."""
    number: dict[bytes, int] = {}
    parts, sizes = [], []
    for text in texts:
        found = (text or "").encode("utf-8", "surrogatepass").lower().split()
        for w in set(found).difference(number):
            number[w] = len(number)
        parts.append(np.fromiter(map(number.__getitem__, found), np.int64, len(found)))
        sizes.append(len(found))
    size = np.array(sizes, np.int64)
    words = word_keys(number)[np.concatenate(parts)] if len(number) else np.zeros(0, U64)
    ends = np.cumsum(size)
    # the key of a run grows word by word; a text's own run is as long as n, or as the text
    key, keys, owner = mix(words), [], []
    of = np.repeat(np.arange(len(size)), size)
    left = np.repeat(ends, size) - np.arange(len(words))  # words from here to the end of the text
    for k in range(1, n + 1):
        take = left >= n if k == n else (left == k) & (np.repeat(size, size) == k)
        at = np.flatnonzero(take[: len(key)])
        keys.append(key[at])
        owner.append(of[at])
        if k < n:
            key = chain(key[:-1], words[k:]) if len(key) > 1 else key[:0]
    keys, owner = np.concatenate(keys), np.concatenate(owner)
    order = np.lexsort((keys, owner))
    keys, owner = keys[order], owner[order]
    if len(keys):
        fresh = np.append(True, (np.diff(owner) != 0) | (keys[1:] != keys[:-1]))
        keys, owner = keys[fresh], owner[fresh]
    return keys, np.searchsorted(owner, np.arange(len(size) + 1))


def compress(minima: np.ndarray) -> np.ndarray:
    """Registers of the lower 56 bits of keys: leading zeros + 1, then the bits behind the leading one."""
    v = minima & U64(2**56 - 1)
    length = np.frexp(np.where(v >= U64(2**53), v & ~U64(7), v).astype(np.float64))[1].astype(np.int64)
    length = np.maximum(length, 1)
    bits = ((v << (U64(64) - length.astype(U64))) << U64(1)) >> U64(64 - MANTISSA)
    return (((57 - length) << MANTISSA) | bits.astype(np.int64)).astype(np.uint16)


def registers(keys: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """One row of registers for each document. In the order of keys a bucket's smallest is its first."""
    out = np.zeros((len(bounds) - 1, BUCKETS), np.uint16)
    if len(keys):
        owner = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
        bucket = (keys >> U64(56)).astype(np.int64)
        first = np.flatnonzero(np.append(True, np.diff(owner * BUCKETS + bucket) != 0))
        out[owner[first], bucket[first]] = compress(keys[first])
    return out


def chunks(batches: Iterator[pa.RecordBatch], text: str) -> Iterator[pa.RecordBatch]:
    """Pieces of batches of about CHUNK_WORDS words, so that long texts come a few at a time."""
    for b in batches:
        size = np.cumsum(np.array([len(x.as_buffer()) if x.is_valid else 0 for x in b.column(text)], np.int64)) // (CHUNK_WORDS * 6)
        cuts = [0, *(np.flatnonzero(np.diff(size)) + 1).tolist(), b.num_rows]
        yield from (b.slice(x, y - x) for x, y in zip(cuts[:-1], cuts[1:], strict=True) if y > x)


def sketch(docs: DataFrame, id_col: str, text_col: str, n: int, num: int, den: int) -> DataFrame:
    """SKETCHES of every document: digest and registers of those with a set and an id, and the first keys in order of the small ones."""
    small = math.ceil(TINY * den / num)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in chunks(batches, "text"):
            keys, bounds = documents_keys(b.column("text").to_pylist(), n)
            regs = registers(keys, bounds)
            out = []
            for k, (i, x, y) in enumerate(zip(b.column("id").to_pylist(), bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)):
                if i is None or x == y:
                    out.append((i, y - x, None, None, None))
                else:
                    own = keys[x:y]
                    firsts = own[: y - x - need(y - x, num, den) + 1].tobytes() if y - x < small else None
                    out.append((i, y - x, blake2b(own.tobytes(), digest_size=16).digest(), regs[k].tobytes(), firsts))
            kinds = [pa.int64(), pa.int64(), *[pa.binary()] * 3]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], names=[f.split()[0] for f in SKETCHES.split(", ")])

    rows = integer_id(docs, id_col).select(F.col(f"`{id_col}`").cast("bigint").alias("id"), F.col(f"`{text_col}`").alias("text"))
    return rows.mapInArrow(work, SKETCHES)


def band_rows(num: int, den: int) -> int:
    """Registers of a band of a large set: as many as keep the chance of sharing no band below MISS at the threshold."""
    fits = [r for r in range(1, 9) if (1 - (num / den) ** r) ** (BUCKETS // r) <= MISS]
    return max(fits)


def dealings(size_class: int, num: int, den: int) -> np.ndarray:
    """For each dealing of a class of sizes the band of each register, or -1."""
    if size_class == len(LAYOUTS):
        r = band_rows(num, den)
        bands = BUCKETS // r
        return np.where(np.arange(BUCKETS) < bands * r, np.arange(BUCKETS) // r, -1)[None]
    _, bands, times = LAYOUTS[size_class]
    spread = mix(np.arange(times * BUCKETS, dtype=U64) + U64(size_class << 32)).reshape(times, BUCKETS)
    # a random order cut into bands of one size
    return np.argsort(np.argsort(spread, axis=1), axis=1) * bands // BUCKETS


def classes_of(n: int, num: int, den: int) -> list[int]:
    """The classes that a set of n n-grams is keyed by: its own and, where a partner may be large enough, the next. -1: by its smallest keys."""
    lows = [x for x, *_ in LAYOUTS] + [SPARSE]
    own = sum(n >= x for x in lows) - 1
    more = own + 1 < len(lows) and n * den // num >= lows[own + 1]
    found = [own, own + 1] if more else [own]
    # a set of TINY or more meets smaller ones by the keys that those have
    return [-1, *found] if own >= 0 and n < math.ceil(TINY * den / num) else found


def band_keys(n: int, regs: np.ndarray, firsts: np.ndarray | None, deal: list[np.ndarray], num: int, den: int) -> np.ndarray:
    """Keys of which linked sets share one."""
    out = []
    for c in classes_of(n, num, den):
        if c < 0:
            out.append(firsts)
            continue
        for turn, band in enumerate(deal[c]):
            held = (band >= 0) & (regs > 0)
            filled = np.bincount(band[held], minlength=int(band.max()) + 1)
            parts = mix((np.flatnonzero(held).astype(U64) << U64(16)) | regs[held].astype(U64))
            total = np.zeros(len(filled), U64)
            np.add.at(total, band[held], parts)  # an order-free sum of mixed (place, register) pairs
            dense = np.flatnonzero(filled >= LEAST_FILLED)
            out.append(chain(total[dense], (dense + ((c * 64 + turn + 1) << 16)).astype(U64)))
    return np.concatenate(out)


def band_posting(classes: DataFrame, num: int, den: int) -> DataFrame:
    """(id, key) of each class's keys."""
    deal = [dealings(c, num, den) for c in range(len(LAYOUTS) + 1)]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, keys = [], []
            for i, n, regs, firsts in zip(*(b.column(c).to_pylist() for c in ("id", "n", "registers", "firsts")), strict=True):
                found = np.unique(band_keys(n, np.frombuffer(regs, np.uint16), None if firsts is None else np.frombuffer(firsts, U64), deal, num, den))
                ids.append(np.full(len(found), i))
                keys.append(found.view(np.int64))
            if ids:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c).astype(np.int64)) for c in (ids, keys)], names=["id", "key"])

    return classes.select("id", "n", "registers", "firsts").mapInArrow(work, "id bigint, key bigint")


def octave_chances(n: np.ndarray) -> np.ndarray:
    """For sets of n n-grams how likely a bucket's minimum lies in each octave."""
    octave = 0.5 ** np.arange(0, 57)
    rest = np.exp(-np.multiply.outer(np.asarray(n, np.float32) / BUCKETS, octave.astype(np.float32)))
    return np.diff(rest, axis=-1)


def expected_collisions(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Registers in which unrelated sets agree, about: both minima lie in one octave, and their mantissas are equal. a: chances of one set; b: of others."""
    return BUCKETS * (b @ a) / 2**MANTISSA


def estimate(chances: np.ndarray, regs: np.ndarray, other_chances: np.ndarray, others: np.ndarray, filled: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Jaccard similarity of a set to others by their registers, less expected collisions, and the registers that either fills. filled: those that each of the others fills."""
    own = np.flatnonzero(regs)
    theirs = others[:, own]
    same = np.count_nonzero(theirs == regs[own], axis=1)
    either = len(own) + filled - np.count_nonzero(theirs, axis=1)
    return np.maximum(same - expected_collisions(chances, other_chances) * (1 - same / either), 0) / either, either


class Sketches:
    """Members of a family or part; a payload is a member's registers and then its keys in order."""

    def __init__(self, num: int, den: int, sizes: np.ndarray, payloads: list):
        self.num, self.den, self.sizes = num, den, sizes
        self.regs = np.stack([np.frombuffer(x, np.uint16, BUCKETS) for x in payloads])
        self.filled = np.count_nonzero(self.regs, axis=1)
        self.chances = octave_chances(sizes)
        self.sets = [np.frombuffer(x, U64, offset=2 * BUCKETS) for x in payloads]

    def search(self, size: int, payload: object, after: int = 0) -> np.ndarray:
        """The members from `after` on that link to a set of so many keys."""
        num, den = self.num, self.den
        sizes = self.sizes[after:]
        near = after + np.flatnonzero((den * sizes >= num * size) & (num * sizes <= den * size))
        if not len(near):
            return near
        told, either = estimate(octave_chances(np.array(size)), np.frombuffer(payload, np.uint16, BUCKETS), self.chances[near], self.regs[near], self.filled[near])
        t = num / den
        near = near[told >= t - ERRORS * np.sqrt(t * (1 - t) / either)]
        own = np.frombuffer(payload, U64, offset=2 * BUCKETS)
        out = []
        for a in range(0, len(near), 1024):
            some = near[a : a + 1024]
            flat = np.concatenate([self.sets[k] for k in some])
            hit = own[np.minimum(np.searchsorted(own, flat), len(own) - 1)] == flat
            shared = np.add.reduceat(hit, np.append(0, np.cumsum(self.sizes[some])[:-1]), dtype=np.int64)
            out.append(some[shared >= pair_need(size, self.sizes[some], num, den)])
        return np.concatenate(out) if out else near


def payloads(docs: DataFrame, wanted: DataFrame, id_col: str, text_col: str, n: int) -> DataFrame:
    """family, id, n, prefix, keys (payload) of the wanted classes, whose sets are made again from their texts. wanted: id, digest, family, prefix, registers."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in chunks(batches, "text"):
            keys, bounds = documents_keys(b.column("text").to_pylist(), n)
            raw = [keys[x:y].tobytes() for x, y in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)]
            # ids may be there for other texts, too
            own = [blake2b(r, digest_size=16).digest() == d for r, d in zip(raw, b.column("digest").to_pylist(), strict=True)]
            made = pa.array([g + r for r, g in zip(raw, b.column("registers").to_pylist(), strict=True)], pa.binary())
            cells = [b.column("family"), b.column("id"), pa.array(np.diff(bounds)), b.column("prefix"), made]
            yield pa.RecordBatch.from_arrays(cells, names=["family", "id", "n", "prefix", "keys"]).filter(pa.array(own))

    texts = docs.select(F.col(f"`{id_col}`").cast("bigint").alias("id"), F.col(f"`{text_col}`").alias("text"))
    return texts.join(wanted, "id").select("id", "family", "digest", "prefix", "registers", "text").mapInArrow(work, "family bigint, id bigint, n bigint, prefix array<bigint>, keys binary")


def join(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = 5, num: int = 80, den: int = 100, family_keys: int = FAMILY_KEYS) -> DataFrame:
    """One row per row: id, n_shingles, component_id (the smallest id that links lead to, its own included), kept (it is its component's smallest).

    Two documents link when den * |intersection| >= num * |union| of their sets of word n-grams, confirmed on the full sets; num / den is 0.8 or more. Words are lower-cased (A-Z)
    runs between ASCII white space. Null and blank texts have no n-grams and no links, and are kept; so are rows without id, whose component is null. Ids are integers and
    should be unique: rows that share one don't fail, and get its smallest component; copies under one id are all kept. Other columns are not read. An
    empty table gives an empty one. Pairs whose smaller set has 64 n-grams or more are found but for chances below 1e-7, smaller ones always.
    """
    if num < 0.8 * den or num > den:
        raise ValueError("the bands are laid out for similarities from 0.8 to 1")
    rows = stage(sketch(docs, id_col, text_col, n, num, den), "sketches")
    of_set = rows.where(F.col("digest").isNotNull()).groupBy("digest")
    classes = stage(of_set.agg(F.min("id").alias("id"), *(F.first(c).alias(c) for c in ("n", "registers", "firsts"))), "sketch-classes")
    posting = stage(band_posting(classes, num, den), "bands")
    shared = shared_keys(posting)
    families = families_of(shared).select("id", F.col("root").alias("family"))
    bands = shared.groupBy("id").agg(F.collect_set("key").alias("prefix"))  # 64 and a few, at most
    wanted = classes.join(families, "id").join(bands, "id").select("id", "digest", "family", "prefix", "registers")
    grouped = stage(payloads(docs, wanted, id_col, text_col, n), "family-sets")
    index: Callable = partial(Sketches, num, den)
    roots = search(grouped, index, family_keys).groupBy("id").agg(F.min("root").alias("root"))
    named = classes.select("digest", "id").join(roots, "id", "left").select("digest", F.coalesce("root", "id").alias("root"))
    out = rows.select("id", "n", "digest").join(named, "digest", "left").withColumn("component_id", F.coalesce("root", "id"))
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), "component_id", F.coalesce(F.col("id") == F.col("component_id"), F.lit(True)).alias("kept"))
