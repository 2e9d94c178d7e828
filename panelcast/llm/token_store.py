"""Content-addressed store of token-id streams.

Layout under a store's path:
  blobs/kind=chunk     packs of chunks: names (their digests), sizes and payload, one after the other; every distinct chunk of ids once, under its own
                       digest; a pack's key is the digest of its names
  blobs/kind=recipe    one row per document: the digests and sizes of its chunks, and their root, in no order
  manifest             the recipes in ascending id order, each with the number of ids before it in its shard, and a row for each shard: documents,
                       ids and root
A gear-like rolling hash over the last WINDOW ids cuts each document's stream, so that equal passages give equal
chunks wherever they stand. Chunks are short, as documents share passages of a hundred ids; so that they cost no row each, tasks send them in
parts by bucket of their digests, and a bucket stores them in packs.

The Merkle tree has FAN children a node: chunk digests are the leaves of a recipe, whose root also covers their sizes, and recipes with
their ids and places are the leaves of a shard. Every reader computes the roots anew from the digests, sizes, ids and places that it reads, and each
chunk's digest from its payload, and fails where one differs from what is recorded.
"""

from __future__ import annotations

import math
import os
import re
import unicodedata
import zlib
from collections.abc import Iterator
from hashlib import blake2b
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .blocks import U64, bucket_bits, expand, meet, squeeze
from .common import integer_id, stage

#: Chunk lengths in ids (48 on average), and the window of the rolling hash (no larger than the least length).
LEAST, MOST, MEAN_BITS, WINDOW, SEED = 16, 512, 5, 16, 20_240_601
#: Bytes of text for a bucket of the store, of a part that a task sends and of a pack, and chunks of a block of recipes, about.
BUCKET_BYTES, PART_BYTES, PACK_BYTES, BLOCK_CHUNKS = 8_000_000, 4_000_000, 500_000, 200_000
BATCH_CHARS, CACHE_WORDS = 2_000_000, 700_000
#: New matches that reach the library in one row.
ROW_WORDS = 100
#: Places of matches that are looked at before all others are searched: 2 ** SLOT_BITS, named by the top bits of the key.
SLOT_BITS = 20
#: Fixed value: the pattern of byte-level vocabularies of this kind.
MATCH = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: The same for re, in texts without the characters that \w and \s of re see otherwise: numbers other than digits, and four control characters; texts with
#: characters beyond 16 bits are taken for such, too.
PLAIN_MATCH = r"""'(?:[stmd]|re|ve|ll)| ?[^\W\d_]+| ?\d+| ?(?:[^\s\w]|_)+|\s+(?!\S)|\s+"""
#: The character of each byte in vocabularies of this kind: itself where Latin-1 prints it, else the next one from 256 on.
PRINTED = [*range(33, 127), *range(161, 173), *range(174, 256)]
BYTE_CHARS = {b: chr(b) for b in PRINTED} | {b: chr(256 + k) for k, b in enumerate(sorted(set(range(256)) - set(PRINTED)))}
BYTE_UNITS = np.array([ord(BYTE_CHARS[b]) for b in range(256)], "<u2")
DIGEST, FAN = 16, 64
#: Matches of up to SHORT bytes are told apart by words of eight bytes; MASKS keeps the first bytes of a word, STEP mixes words.
SHORT, STEP = 32, np.uint64(0x9E3779B97F4A7C15)
MASKS = np.array([2 ** (8 * n) - 1 for n in range(9)], np.uint64)
#: Kinds of bytes: letters (with all bytes beyond ASCII), digits, other signs, the blank, other white space, and what stands between texts.
LETTER, NUMBER, OTHER, BLANK, WHITE, TEXT_END = range(6)
KIND = np.array([LETTER if b > 127 or chr(b).isalpha() else NUMBER if chr(b).isdigit() else BLANK if b == 32 else WHITE if 9 <= b <= 13 else OTHER for b in range(256)], np.uint8)
KIND[255] = TEXT_END
KIND_TABLE = KIND.tobytes()
#: Fixed value: zlib's polynomial, reflected.
POLY = 0xEDB88320
BLOBS = "kind string, key binary, names binary, sizes binary, payload binary, id bigint, n_tokens bigint, root binary"
#: Rows of kind recipe have id to root; rows of kind shard have shard, docs, n_tokens (of all of them) and root.
MANIFEST = "kind string, shard int, id bigint, within bigint, n_tokens bigint, sizes binary, digests binary, root binary, docs bigint"
HEADS = "block bigint, shard int, ids array<bigint>, within binary, bounds binary, sizes binary, names binary, leaves binary, n_ids bigint, n_chunks bigint"
#: What a document needs to know of a chunk: its ids and their CRC.
FACT = np.dtype([("n", np.uint32), ("crc", np.uint32)])


def digest(data: bytes) -> bytes:
    return blake2b(data, digest_size=DIGEST).digest()


def merkle_root(leaves: bytes, kind: bytes) -> bytes:
    """Root over digests one after the other; nodes of different kinds, and of chunks, have different digests of the same data."""
    while True:
        leaves = b"".join([blake2b(leaves[k : k + DIGEST * FAN], digest_size=DIGEST, person=kind).digest() for k in range(0, max(len(leaves), 1), DIGEST * FAN)])
        if len(leaves) == DIGEST:
            return leaves


def recipe_root(digests: bytes, sizes: bytes) -> bytes:
    return digest(merkle_root(digests, b"recipe") + sizes)


def leaf(id_, within: int, n_tokens: int, root: bytes) -> bytes:
    """A document's leaf in its shard."""
    return digest(repr((id_, within, n_tokens)).encode() + root)


class PieceEncoder:
    """tokenizers over the distinct matches of the vocabulary's pattern, each of which encodes on its own as it does in its text."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        special = {t.content: i for i, t in self.tokenizer.get_added_tokens_decoder().items()}
        self.special = re.compile("(" + "|".join(map(re.escape, special)) + ")") if special else re.compile(r"(?!)")
        self.special_ids = {t: i.to_bytes(4, "little") for t, i in special.items()}
        vocabulary = self.tokenizer.get_vocab()
        self.after_blank = np.zeros(max(vocabulary.values()) + 1, bool)
        self.after_blank[[i for t, i in vocabulary.items() if t.startswith(BYTE_CHARS[32])]] = True
        # a byte that UTF-8 never has, if its character is a token and in no other one: it ends matches that stand in one row
        all_chars = "".join(vocabulary)
        self.stop = next((b for b in (0xC0, 0xC1, *range(0xF5, 0x100)) if BYTE_CHARS[b] in vocabulary and all_chars.count(BYTE_CHARS[b]) == 1), None)
        self.stop_id = None if self.stop is None else vocabulary[BYTE_CHARS[self.stop]]
        # what reaches the library is cut by the pattern already, and in the vocabulary's own characters
        self.tokenizer.pre_tokenizer = pre_tokenizers.Sequence([])
        self.forget()
        self.match, self.plain_match = regex.compile(MATCH), re.compile(PLAIN_MATCH)
        numbers = "".join(re.escape(c) for c in map(chr, range(65_536)) if unicodedata.category(c) in ("No", "Nl"))
        self.odd, self.far = re.compile(f"[{numbers}\x1c-\x1f]"), re.compile("[\U00010000-\U0010ffff]")

    def forget(self) -> None:
        """`known` holds matches of texts that are taken one by one. Those that arrays cut have a place each, found by their sorted keys or, beyond SHORT bytes, by name; place 0 has no ids."""
        self.known: dict[bytes, bytes] = {b"": b""} | {t.encode(): i for t, i in self.special_ids.items()}
        self.longer: dict[bytes, int] = {}
        self.keys, self.places = np.empty(0, U64), np.empty(0, np.int32)
        self.used, self.filled = 1, 0
        self.size, self.words = np.zeros(1, np.int32), np.zeros((1, SHORT // 8), U64)
        self.count, self.offset, self.ids = np.zeros(1, np.int64), np.zeros(1, np.int64), np.empty(1, "<u4")
        self.uses, self.slots = np.zeros(1, np.int32), np.zeros(2**SLOT_BITS, np.int32)

    def thin(self) -> None:
        """Keeps what several calls had, the most used first and at most half of CACHE_WORDS, at half its uses; the rest is forgotten."""
        uses, was = self.uses[: self.used], {k: getattr(self, k) for k in ("size", "words", "count", "offset", "ids", "keys", "places", "longer")}
        stay = np.flatnonzero(uses[1:] > 1) + 1
        if len(stay) > CACHE_WORDS // 2:
            stay = np.sort(stay[np.argpartition(-uses[stay], CACHE_WORDS // 2)[: CACHE_WORDS // 2]])
        self.forget()
        n = was["count"][stay]
        ids = was["ids"][np.repeat(was["offset"][stay] - (np.cumsum(n) - n), n) + np.arange(n.sum())]
        moved = np.zeros(len(uses), np.int32)
        moved[stay] = self._keep(ids, n, was["size"][stay], was["words"][stay])
        self.uses[1 : self.used] = uses[stay] // 2
        places = moved[was["places"]]
        self.keys, self.places = was["keys"][places > 0], places[places > 0]
        self.longer = {x: int(moved[at]) for x, at in was["longer"].items() if moved[at]}

    def _matches(self, text: str) -> list[str]:
        if self.special.search(text):
            return [m for part in self.special.split(text) for m in ([part] if part in self.special_ids else self._parts(part))]
        return self._parts(text)

    def _parts(self, text: str) -> list[str]:
        return (self.match if self.odd.search(text) or self.far.search(text) else self.plain_match).findall(text)

    def _encode_rows(self, rows: list[bytes]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast([BYTE_UNITS[np.frombuffer(x, np.uint8)].tobytes().decode("utf-16-le") for x in rows], add_special_tokens=False)]

    def _learn(self, spaced: list[bytes], others: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of new matches one after the other, and the number of each; `spaced` are letters after a blank.

        Many stand in a row, as a row costs more than a match. Merges of one leave the others' alone, unless a token goes beyond a match. None holds the
        stop with more; one with a blank inside can join two of `spaced`, which leaves fewer ids that begin with a blank: then these have stops, too.
        """
        ids = np.fromiter(chain.from_iterable(self._encode_rows([b"".join(spaced[k : k + ROW_WORDS]) for k in range(0, len(spaced), ROW_WORDS)])), "<u4")
        counts = np.diff(np.flatnonzero(self.after_blank[ids]), append=len(ids))
        if len(counts) != len(spaced):
            ids, counts, others = ids[:0], counts[:0], spaced + others
        if self.stop is None:
            lists = self._encode_rows(others)
            return np.append(ids, np.fromiter(chain.from_iterable(lists), "<u4")), np.append(counts, np.fromiter(map(len, lists), np.int64, len(lists)))
        stop = bytes([self.stop])
        found = np.fromiter(chain.from_iterable(self._encode_rows([stop.join([*others[k : k + ROW_WORDS], b""]) for k in range(0, len(others), ROW_WORDS)])), "<u4")
        ended = found == self.stop_id
        return np.append(ids, found[~ended]), np.append(counts, np.diff(np.flatnonzero(ended), prepend=-1) - 1)

    def _keep(self, ids: np.ndarray, counts: np.ndarray, size: np.ndarray, words: np.ndarray) -> np.ndarray:
        """New places with these ids."""
        begin, self.used = self.used, self.used + len(counts)
        start, self.filled = self.filled, self.filled + len(ids)
        for name, values, at, end in (
            ("size", size, begin, self.used), ("words", words, begin, self.used), ("count", counts, begin, self.used), ("offset", start + np.cumsum(counts) - counts, begin, self.used), ("uses", 0, begin, self.used), ("ids", ids, start, self.filled),
        ):
            held = getattr(self, name)
            if end > len(held):
                more = np.empty((max(end, len(held) * 3 // 2), *held.shape[1:]), held.dtype)
                more[:at] = held[:at]
                setattr(self, name, held := more)
            held[at:end] = values
        return np.arange(begin, self.used)

    def _find(self, raw: bytes, kind: np.ndarray, begin: np.ndarray, size: np.ndarray) -> np.ndarray:
        """Places of distinct matches, of which new ones are learnt; those of texts' ends are 0. A match whose key another one has is kept for this call alone."""
        keys, parts = spelled(raw, begin, size)
        words = columns(parts, len(size))
        place, taken = np.zeros(len(size), np.int64), np.zeros(len(size), bool)
        if len(self.keys):
            order, near = np.argsort(keys), np.empty(len(keys), np.int64)
            near[order] = np.minimum(np.searchsorted(self.keys, keys[order]), len(self.keys) - 1)
            at = self.places[near]
            taken = self.keys[near] == keys
            same = taken & (self.size[at] == size) & (self.words[at] == words).all(axis=1)
            place[same] = at[same]
        piece = lambda rows: list(map(raw.__getitem__, map(slice, begin[rows].tolist(), (begin + size)[rows].tolist())))
        longer = np.flatnonzero(size > SHORT)
        place[longer] = [self.longer.get(x, 0) for x in piece(longer)]
        new = np.flatnonzero((place == 0) & (kind[begin] != TEXT_END))
        if len(new):
            letters = (kind[begin[new]] == BLANK) & (kind[begin[new] + 1] == LETTER)
            spaced, others = new[letters], new[~letters]
            new = np.append(spaced, others)
            place[new] = self._keep(*self._learn(piece(spaced), piece(others)), size[new], words[new])
            far = new[size[new] > SHORT]
            self.longer.update(zip(piece(far), place[far].tolist(), strict=True))
            added = new[(size[new] <= SHORT) & ~taken[new]]
            added = added[np.argsort(keys[added])]
            at = np.searchsorted(self.keys, keys[added])
            self.keys, self.places = np.insert(self.keys, at, keys[added]), np.insert(self.places, at, place[added])
        self.slots[keys >> U64(64 - SLOT_BITS)] = place
        return place

    def _place(self, raw: bytes, kind: np.ndarray, begin: np.ndarray, size: np.ndarray) -> np.ndarray | None:
        """Places of all matches; None if two that differ have one key. The slot of a match's key holds its place or that of another match or 0, which its bytes show; only the rest is told apart and searched."""
        keys, parts = spelled(raw, begin, size)
        place = self.slots[keys >> U64(64 - SLOT_BITS)]
        there = (self.size[place] == size) & (size <= SHORT)
        for k, (rows, part) in enumerate(parts):
            there[rows] &= self.words[place[rows], k] == part
        rest = np.flatnonzero(~there)
        told = tell_apart(raw, begin[rest], size[rest])
        if told is None:
            return None
        which, first = told
        place[rest] = self._find(raw, kind, begin[rest[first]], size[rest[first]])[which]
        used = np.zeros(self.used, bool)
        used[place] = True
        self.uses[: self.used] += used
        return place

    def encode(self, texts: list[str]) -> Iterator[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers. Texts that the arrays can't cut are matched by the pattern."""
        if len(self.known) + self.used > CACHE_WORDS:
            self.thin()
        there = np.zeros(0x110000, bool)
        there[np.frombuffer("".join([t for t in texts if not t.isascii()]).encode("utf-32-le"), "<u4")] = True
        odd = {c for c in map(chr, (128 + np.flatnonzero(there[128:])).tolist()) if not c.isalpha()}
        marks = [*self.special_ids, *"\x1c\x1d\x1e\x1f"]
        easy = [not any(m in t for m in marks) and (not odd or t.isascii() or odd.isdisjoint(t)) for t in texts]
        cut = self._encode_arrays([t for t, e in zip(texts, easy, strict=True) if e])
        for text, plain in zip(texts, easy, strict=True):
            yield next(cut) if plain else self._encode_one(text)

    def _encode_one(self, text: str) -> bytes:
        ms = list(map(str.encode, self._matches(text)))
        new = list(set(ms).difference(self.known))
        ids, counts = self._learn([], new)
        raw, ends = ids.tobytes(), (4 * np.cumsum(counts)).tolist()
        self.known.update(zip(new, map(raw.__getitem__, map(slice, [0, *ends[:-1]], ends)), strict=True))
        return b"".join(map(self.known.__getitem__, ms))

    def _encode_arrays(self, texts: list[str]) -> Iterator[bytes]:
        """All texts' matches are cut and told apart in arrays of bytes; only new ones become strings."""
        if not texts:
            return
        raw = b"\xff".join([t.encode() for t in texts]) + b"\xff" + bytes(SHORT)
        data = np.frombuffer(raw, np.uint8, len(raw) - SHORT)
        kind = np.frombuffer(raw.translate(KIND_TABLE), np.uint8, len(data))
        begin = np.flatnonzero(match_starts(data, kind)).astype(np.int32)
        size = np.diff(begin, append=np.int32(len(data)))
        place = self._place(raw, kind, begin, size)
        if place is None:
            yield from map(self._encode_one, texts)
            return
        n = self.count[place]
        upto = np.cumsum(n)
        flat = self.ids[np.repeat(self.offset[place] - (upto - n), n) + np.arange(upto[-1])].tobytes()
        stops = (4 * upto[place == 0]).tolist()
        for x, y in zip([0, *stops], stops, strict=False):
            yield flat[x:y]


def match_starts(data: np.ndarray, kind: np.ndarray) -> np.ndarray:
    """Where matches of the pattern begin, in texts of ASCII and other letters that end with a byte of kind TEXT_END.

    A run of letters, digits or other signs is a match with the blank before it. White space is a match up to its last character,
    which stands alone or with the run that follows; at a text's end it is one match. An apostrophe that begins a match
    takes one of the endings s, t, m, d, re, ve, ll with it.
    """
    before, after = np.append(np.uint8(TEXT_END), kind[:-1]), np.append(kind[1:], np.uint8(TEXT_END))
    white = kind - np.uint8(BLANK) <= WHITE - BLANK  # unsigned: what is less than BLANK wraps around
    white_before = np.append(False, white[:-1])
    start = np.where(white, ~white_before | (after < BLANK), (kind != before) & (before != BLANK)) | (kind == TEXT_END)
    quote = np.flatnonzero((data == 39) & (before != BLANK) & (before != OTHER))
    get = lambda k: data[np.minimum(quote + k, len(data) - 1)]
    one, two = get(1), get(2)
    short = np.isin(one, np.frombuffer(b"stmd", np.uint8))
    long = ((one == 114) | (one == 118)) & (two == 101) | (one == 108) & (two == 108)
    start[quote[short | long] + 1] = False
    start[quote[short] + 2] = True
    start[quote[long] + 3] = True
    # what follows a blank doesn't begin a match, whatever ended before the blank
    start[1:] &= ~((kind[:-1] == BLANK) & (kind[1:] < BLANK))
    return start


def spelled(raw: bytes, begin: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, list[tuple]]:
    """Keys of matches by their sizes and first SHORT bytes; and, for each eight of these bytes, the matches that have any of them, and the bytes as numbers. SHORT bytes follow the last match."""
    words = np.ndarray((len(raw) - 7,), "<u8", buffer=raw, strides=(1,))
    keys, parts = size.astype(U64) * STEP, []  # apart from the bytes also where null bytes follow them
    for k in range(0, SHORT, 8):
        rows = np.flatnonzero(size > k) if k else slice(None)
        part = words[begin[rows] + k] & MASKS[np.minimum(size[rows] - k, 8)]
        mixed = (keys[rows] ^ part) * STEP
        keys[rows] = mixed ^ (mixed >> np.uint64(29))
        parts.append((rows, part))
    return keys, parts


def columns(parts: list[tuple], n: int) -> np.ndarray:
    out = np.zeros((n, len(parts)), U64)
    for k, (rows, part) in enumerate(parts):
        out[rows, k] = part
    return out


def tell_apart(raw: bytes, begin: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray] | None:
    """Which of the distinct matches each match is, and where each of these stands first; None if two that differ have one key."""
    keys, parts = spelled(raw, begin, size)
    longer = np.flatnonzero(size > SHORT)
    long = [raw[x:y] for x, y in zip(begin[longer].tolist(), (begin + size)[longer].tolist(), strict=True)]
    keys[longer] = np.array([hash(x) for x in long], np.int64).view(np.uint64)
    coded = pa.array(keys).dictionary_encode()
    which = coded.indices.to_numpy()
    first = np.empty(len(coded.dictionary), np.int64)
    first[which[::-1]] = np.arange(len(which) - 1, -1, -1)
    words = columns(spelled(raw, begin[first], size[first])[1], len(first))
    same = np.array_equal(size[first][which], size) and all(np.array_equal(words[which[rows], k], part) for k, (rows, part) in enumerate(parts))
    starts = begin[first[which[longer]]].tolist()
    return (which, first) if same and all(raw.startswith(x, at) for x, at in zip(long, starts, strict=True)) else None


_LOADED: dict[str, PieceEncoder] = {}


def encoder(path: str) -> PieceEncoder:
    if path not in _LOADED:
        _LOADED[path] = PieceEncoder(path)
    return _LOADED[path]


def cuts(ids: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ends of all chunks, and the number of chunks of each stream; `starts` are the streams' bounds in ids."""
    gear = np.random.default_rng(SEED).integers(0, 2**63, 65_536, dtype=np.uint64)
    h = gear[ids & 0xFFFF] ^ (ids.astype(np.uint64) >> np.uint64(16))
    width = 1
    while width < WINDOW:
        h[width:] += h[:-width] << np.uint64(width)  # numpy takes the right side's values from before the change
        width *= 2
    marks = np.flatnonzero((h >> np.uint64(40)) & np.uint64(2**MEAN_BITS - 1) == 0) + 1
    bounds = np.searchsorted(marks, starts).tolist()
    marks = marks.tolist()
    out, counts = [], []
    put = out.append
    for k, (a, b) in enumerate(zip(starts[:-1].tolist(), starts[1:].tolist(), strict=True)):
        last, before = a, len(out)
        for m in marks[bounds[k] : bounds[k + 1]]:
            while m - last > MOST:
                last += MOST
                put(last)
            if m - last >= LEAST:
                put(m)
                last = m
        while b - last > MOST:
            last += MOST
            put(last)
        if b > last:
            put(b)
        counts.append(len(out) - before)
    return np.array(out, np.int64), np.array(counts, np.int64)


def _slices(ids: pa.Array, texts: pa.Array) -> Iterator[tuple[list, list[str]]]:
    some, chars, which = [], 0, []
    for i, t in zip(ids, texts, strict=True):
        which.append(i.as_py())
        some.append(t.as_py() or "")
        chars += len(some[-1])
        if chars >= BATCH_CHARS:
            yield which, some
            some, chars, which = [], 0, []
    if some:
        yield which, some


def ranked(names: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The distinct digests in order as pairs of numbers, the place of each digest among them, and one of the places where each stands."""
    pair = np.frombuffer(names, ">u8").astype(U64).reshape(-1, 2)
    order = np.argsort(pair[:, 0])
    ordered = pair[order]
    equal = ordered[1:] == ordered[:-1]
    if not np.array_equal(equal[:, 0], equal.all(axis=1)):  # two digests share their first half
        order = np.lexsort((pair[:, 1], pair[:, 0]))
        ordered = pair[order]
        equal = ordered[1:] == ordered[:-1]
    new = np.append(True, ~equal.all(axis=1))[: len(order)]
    place = np.empty(len(order), np.int64)
    place[order] = np.cumsum(new) - 1
    return ordered[new], place, order[new]


def bucket_ends(high: np.ndarray, bits: int) -> list[int]:
    """Ends of the buckets in sorted first halves of digests; the top bits name the bucket."""
    return [*np.searchsorted(high, np.arange(1, 2**bits, dtype=U64) << U64(64 - bits)).tolist(), len(high)]


def blobs(docs: DataFrame, tokenizer: str, end_id: int, bits: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Recipe rows of every document, and parts of chunks by bucket; a chunk is there once in a task, as long as the task remembers it."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, end = encoder(tokenizer), int(end_id).to_bytes(4, "little")
        seen: set[bytes] = set()
        fresh: list[bytes] = []
        payloads: list[bytes] = []
        held, done = 0, TaskContext.get().partitionId()
        kinds = [pa.int32(), pa.string(), *[pa.binary()] * 4, pa.int64(), pa.int64(), pa.binary()]
        columns = ["bucket", "kind", "key", "names", "sizes", "payload", "id", "n_tokens", "root"]
        wide = 2 if len(enc.after_blank) <= 65_536 else 4

        def batch(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=columns)

        def parts() -> Iterator[pa.RecordBatch]:
            distinct, _, first = ranked(b"".join(fresh))
            ends, at = bucket_ends(distinct[:, 0], bits), first.tolist()
            rows = []
            for k, (x, y) in enumerate(zip([0, *ends], ends, strict=False)):
                if y > x:
                    own = [payloads[j] for j in at[x:y]]
                    rows.append((k, "chunk", None, b"".join([fresh[j] for j in at[x:y]]), (np.fromiter(map(len, own), np.int64, len(own)) // wide).astype("<u2").tobytes(), b"".join(own), None, None, None))
            fresh.clear(), payloads.clear()
            if rows:
                yield batch(rows)

        for b in batches:
            for which, texts in _slices(b.column(0), b.column(1)):
                streams = [x + end for x in enc.encode(texts)]
                flat = np.frombuffer(b"".join(streams), "<u4")
                starts = np.append(0, np.cumsum([len(x) // 4 for x in streams]))
                raw = flat.astype(f"<u{wide}").tobytes()
                ends, counts = cuts(flat, starts)
                chunks = list(map(raw.__getitem__, map(slice, (wide * np.append(0, ends[:-1])).tolist(), (wide * ends).tolist())))
                names = [blake2b(x, digest_size=DIGEST).digest() for x in chunks]
                new = [k for k, name in enumerate(names) if name not in seen and not seen.add(name)]
                fresh += [names[k] for k in new]
                payloads += (own := [chunks[k] for k in new])
                held += sum(map(len, own))
                sizes, listed = np.diff(ends, prepend=0).astype("<u2").tobytes(), b"".join(names)
                upto, rows = np.append(0, np.cumsum(counts)).tolist(), []
                for i, n, x, y in zip(which, np.diff(starts).tolist(), upto, upto[1:], strict=False):
                    # recipes are dealt in turn, so that many equal documents make no large bucket
                    done += 1
                    own_names, own_sizes = listed[DIGEST * x : DIGEST * y], sizes[2 * x : 2 * y]
                    rows.append((done % 2**bits, "recipe", None, own_names, own_sizes, None, i, n, recipe_root(own_names, own_sizes)))
                for k in range(0, len(rows), 5_000):
                    yield batch(rows[k : k + 5_000])
                if held >= PART_BYTES:
                    yield from parts()
                    held = 0
                if len(seen) > 500_000:
                    seen.clear()
        yield from parts()

    return integer_id(docs, id_col).select(F.col(f"`{id_col}`").cast("bigint").alias("id"), F.col(f"`{text_col}`").alias("text")).mapInArrow(work, f"bucket int, {BLOBS}")


def packs(table: pa.Table) -> pa.Table:
    """The rows of a bucket: its recipes as they are, and its distinct chunks in packs. A pack's payload begins with the bytes of an id."""
    table = table.drop_columns(["bucket"])
    chunk = pc.equal(table.column("kind"), "chunk")
    recipes, parts = table.filter(pc.invert(chunk)), table.filter(chunk)
    names, raw = (b"".join(parts.column(c).to_pylist()) for c in ("names", "payload"))
    sizes = np.frombuffer(b"".join(parts.column("sizes").to_pylist()), "<u2").astype(np.int64)
    wide = len(raw) // max(1, int(sizes.sum()))
    _, _, first = ranked(names)
    ends = wide * np.cumsum(sizes)
    pack = np.cumsum(wide * sizes[first]) // PACK_BYTES
    cut = [0, *(np.flatnonzero(pack[1:] != pack[:-1]) + 1).tolist(), len(first)] if len(first) else []
    rows = []
    for x, y in zip(cut[:-1], cut[1:], strict=True):
        own = first[x:y]
        listed = b"".join(map(names.__getitem__, map(slice, (DIGEST * own).tolist(), (DIGEST * own + DIGEST).tolist())))
        payload = b"".join(map(raw.__getitem__, map(slice, (ends - wide * sizes)[own].tolist(), ends[own].tolist())))
        rows.append({"kind": "chunk", "key": digest(listed), "names": listed, "sizes": sizes[own].astype("<u2").tobytes(), "payload": bytes([wide]) + payload})
    return pa.concat_tables([recipes, pa.Table.from_pylist(rows, schema=recipes.schema)])


def write(docs: DataFrame, path: str, tokenizer: str, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text", shard_docs: int = 50_000) -> None:
    """Writes the store. One shuffle moves each distinct chunk of a task once, in parts by bucket; rows of recipes travel with them.

    Null texts count as empty and hold the end id alone. Rows with null ids come first in order; rows of one id stand in the order of their
    roots. Ids are integers. Of an empty table the store has no rows. Other columns are not read.
    """
    spark = docs.sparkSession
    size = docs.agg(F.coalesce(F.sum(F.octet_length(f"`{text_col}`")), F.lit(0))).first()[0]
    bits = max(5, math.ceil(math.log2(max(1, size / BUCKET_BYTES))))
    made = blobs(docs, tokenizer, end_id, bits, id_col, text_col)
    made.groupBy("bucket").applyInArrow(packs, BLOBS).write.partitionBy("kind").option("compression", "zstd").parquet(f"{path}/blobs")
    stored = spark.read.schema(BLOBS).parquet(f"{path}/blobs").where("kind = 'recipe'")
    # the place in its file parts rows of equal id and text, so that any number of them make several shards
    recipes = stored.select("id", "n_tokens", "sizes", F.col("names").alias("digests"), "root", F.xxhash64("_metadata.file_name", "_metadata.row_index").alias("tie"))
    shards = max(1, -(-stored.count() // shard_docs))
    ordered = recipes.repartitionByRange(shards, "id", "root", "tie").sortWithinPartitions("id", "root", "tie").drop("tie")
    ordered.mapInArrow(_shard, MANIFEST).write.option("compression", "zstd").parquet(f"{path}/manifest")


def _shard(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A partition's recipes with their places, and a row for it as a shard."""
    number, within, leaves = TaskContext.get().partitionId(), 0, []
    for b in batches:
        n = b.column("n_tokens").to_numpy()
        places = within + np.cumsum(n) - n
        within += int(n.sum())
        leaves += map(leaf, b.column("id").to_pylist(), places.tolist(), n.tolist(), b.column("root").to_pylist())
        same = lambda x, t, k=b.num_rows: pa.array([x] * k, t)
        cells = [same("recipe", pa.string()), same(number, pa.int32()), b.column("id"), pa.array(places, pa.int64()), b.column("n_tokens"), b.column("sizes"), b.column("digests"), b.column("root"), same(None, pa.int64())]
        yield pa.RecordBatch.from_arrays(cells, names=["kind", "shard", "id", "within", "n_tokens", "sizes", "digests", "root", "docs"])
    if leaves:
        row = {"kind": "shard", "shard": number, "n_tokens": within, "root": merkle_root(b"".join(leaves), b"shard"), "docs": len(leaves)}
        kinds = [("kind", pa.string()), ("shard", pa.int32()), ("id", pa.int64()), ("within", pa.int64()), ("n_tokens", pa.int64()), ("sizes", pa.binary()), ("digests", pa.binary()), ("root", pa.binary()), ("docs", pa.int64())]
        yield pa.RecordBatch.from_pylist([row], schema=pa.schema(kinds))


def zero_tables() -> np.ndarray:
    """[n, k, b]: what 4 * n zero bytes after a message make of byte k of its CRC, if it is b. The CRC of a whole is this of its first part, and the second part's own, by xor."""
    table = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        table = np.where(table & 1, (table >> 1) ^ np.uint32(POLY), table >> 1)
    out = np.empty((MOST + 1, 4, 256), np.uint32)
    out[0] = np.arange(256, dtype=np.uint32) << np.array([[0], [8], [16], [24]], np.uint32)
    for n in range(1, MOST + 1):
        now = out[n - 1]
        for _ in range(4):
            now = (now >> 8) ^ table[now & 255]
        out[n] = now
    return out


def joined_crc(sizes: np.ndarray, crcs: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """CRC of each document from those of its chunks: the first chunks of all documents, then the second ones, and so on."""
    tables, count = zero_tables(), np.diff(bounds)
    order = np.argsort(-count, kind="stable")
    first, remain = bounds[:-1][order], np.searchsorted(-count[order], -np.arange(count.max(initial=0)), side="left")
    whole = np.zeros(len(order), np.uint32)
    for k, n in enumerate(remain.tolist()):
        at, was = first[:n] + k, whole[:n]
        size = sizes[at]
        whole[:n] = tables[size, 0, was & 255] ^ tables[size, 1, (was >> 8) & 255] ^ tables[size, 2, (was >> 16) & 255] ^ tables[size, 3, was >> 24] ^ crcs[at]
    out = np.empty(len(order), np.uint32)
    out[order] = whole
    return out


def stored_chunks(spark: SparkSession, path: str, bits: int = 0, payloads: bool = False) -> DataFrame:
    """bucket, names, facts of all stored chunks, a row for each pack and bucket, checked against their digests. facts: FACT of each chunk, and with `payloads` its ids as well."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for row in range(b.num_rows):  # one pack at a time
                key, names, sizes, payload = (c[row].as_py() for c in b.columns)
                size, wide = np.frombuffer(sizes, "<u2").astype(np.int64), payload[0]
                if digest(names) != key or len(names) != DIGEST * len(size) or wide * size.sum() != len(payload) - 1:
                    raise ValueError(f"pack {key.hex()} doesn't hold what its digest says")
                ends = np.cumsum(size)
                cut = lambda raw, w: map(raw.__getitem__, map(slice, (w * (ends - size)).tolist(), (w * ends).tolist()))  # noqa: B023, E731
                if b"".join([blake2b(x, digest_size=DIGEST).digest() for x in cut(payload[1:], wide)]) != names:
                    raise ValueError(f"a chunk of pack {key.hex()} doesn't hold what its digest says")
                ids = np.frombuffer(payload, f"<u{wide}", offset=1).astype("<u4")
                facts = np.empty(len(size), FACT)
                facts["n"], facts["crc"] = size, np.fromiter(map(zlib.crc32, cut(ids.tobytes(), 4)), np.uint32, len(size))
                high = np.frombuffer(names, ">u8")[::2].astype(U64)
                edges = bucket_ends(high, bits)
                upto = np.append(0, ends)
                rows += [(k, names[DIGEST * x : DIGEST * y], facts[x:y].tobytes(), ids[upto[x] : upto[y]].tobytes() if payloads else None) for k, (x, y) in enumerate(zip([0, *edges], edges, strict=False)) if y > x]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), [pa.int32(), *[pa.binary()] * 3], strict=True)], names=["bucket", "names", "facts", "ids"])

    return spark.read.schema(BLOBS).parquet(f"{path}/blobs").where("kind = 'chunk'").select("key", "names", "sizes", "payload").mapInArrow(work, "bucket int, names binary, facts binary, ids binary")


def heads(spark: SparkSession, path: str) -> DataFrame:
    """Blocks of a shard's recipes: ids and places of documents, their bounds in chunks, sizes and digests of chunks, leaves. Fails where a recipe's root isn't that of its digests and sizes."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        named = TaskContext.get().partitionId() * 2**32
        for b in batches:
            if not b.num_rows:
                continue
            digests, sizes, ids, total, roots = (b.column(c).to_pylist() for c in ("digests", "sizes", "id", "n_tokens", "root"))
            within, shard = b.column("within").to_numpy(), b.column("shard").to_numpy()
            n = np.array([len(x) // DIGEST for x in digests], np.int64)
            flat = np.frombuffer(b"".join(sizes), "<u2").astype(np.int64)
            bounds = np.append(0, np.cumsum(n))
            of_size = np.array([len(x) // 2 for x in sizes], np.int64)
            # no document is without its end id, so that each has a chunk
            if roots != list(map(recipe_root, digests, sizes)) or (n == 0).any() or (of_size != n).any() or np.add.reduceat(flat, bounds[:-1]).tolist() != total:
                raise ValueError("a recipe doesn't hold what its root says")
            leaves = list(map(leaf, ids, within.tolist(), total, roots))
            group = np.cumsum(n) // BLOCK_CHUNKS
            cut = [0, *(np.flatnonzero((group[1:] != group[:-1]) | (shard[1:] != shard[:-1])) + 1).tolist(), b.num_rows]
            for x, y in zip(cut[:-1], cut[1:], strict=True):
                p, q = int(bounds[x]), int(bounds[y])
                cells = [named, int(shard[x]), ids[x:y], squeeze(within[x:y]), squeeze(bounds[x : y + 1] - p), squeeze(flat[p:q].astype("<u2")), b"".join(digests[x:y]), b"".join(leaves[x:y]), sum(total[x:y]), q - p]
                named += 1
                yield pa.RecordBatch.from_arrays([pa.array([c], t) for c, t in zip(cells, [pa.int64(), pa.int32(), pa.list_(pa.int64()), *[pa.binary()] * 5, pa.int64(), pa.int64()], strict=True)], names=["block", "shard", "ids", "within", "bounds", "sizes", "names", "leaves", "n_ids", "n_chunks"])

    rows = spark.read.schema(MANIFEST).parquet(f"{path}/manifest").where("kind = 'recipe'")
    return rows.select("shard", "id", "within", "n_tokens", "sizes", "digests", "root").mapInArrow(work, HEADS)


def unsound(spark: SparkSession, path: str, blocks: DataFrame) -> DataFrame:
    """shard of each shard whose recorded root, documents or ids differ from those of the recipes read. A shard has a bounded number of documents."""

    def work(table: pa.Table) -> pa.Table:
        pieces = sorted(zip((expand(x, np.int64)[0] for x in table.column("within").to_pylist()), table.column("leaves").to_pylist(), strict=True))
        leaves = b"".join(x for _, x in pieces)
        return pa.table({"shard": table.column("shard")[:1], "now": pa.array([merkle_root(leaves, b"shard")], pa.binary()), "now_docs": pa.array([len(leaves) // DIGEST], pa.int64()), "now_ids": pa.array([sum(table.column("n_ids").to_pylist())], pa.int64())})

    now = blocks.select("shard", "within", "leaves", "n_ids").groupBy("shard").applyInArrow(work, "shard int, now binary, now_docs bigint, now_ids bigint")
    was = spark.read.schema(MANIFEST).parquet(f"{path}/manifest").where("kind = 'shard'").select("shard", "root", "docs", "n_tokens")
    same = F.col("now").eqNullSafe(F.col("root")) & F.col("now_docs").eqNullSafe(F.col("docs")) & F.col("now_ids").eqNullSafe(F.col("n_tokens"))
    return now.join(was, "shard", "full").where(~same).select("shard")


def verify(spark: SparkSession, path: str) -> DataFrame:
    """shard of each shard whose root isn't that of its recipes; none in a sound store. Fails where a recipe itself doesn't hold what its root says."""
    return unsound(spark, path, heads(spark, path))


def _assembled(spark: SparkSession, path: str, assemble, value_type, schema: str, payloads: bool) -> DataFrame:
    """assemble(block row, replies on its distinct chunks, place of each of its chunks among them) for every block of recipes, once all roots are checked.

    Blocks ask buckets of digests for the facts (or ids) of their distinct chunks. A chunk that is missing or altered fails the read.
    """
    blocks = stage(heads(spark, path), "store-recipes")
    bad = unsound(spark, path, blocks).first()
    if bad is not None:
        raise ValueError(f"shard {bad[0]} doesn't hold what its root says")
    bits = bucket_bits(blocks.agg(F.coalesce(F.sum("n_chunks"), F.lit(0))).first()[0])

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for block, names in zip(b.column("block").to_pylist(), b.column("names").to_pylist(), strict=True):
                distinct, _, _ = ranked(names)
                cut, listed = bucket_ends(distinct[:, 0], bits), distinct.astype(">u8").tobytes()
                rows = [(k, listed[DIGEST * x : DIGEST * y], None, None, block) for k, (x, y) in enumerate(zip([0, *cut], cut, strict=False)) if y > x]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), [pa.int32(), *[pa.binary()] * 3, pa.int64()], strict=True)], names=["bucket", "names", "facts", "ids", "block"])

    def look_up(table: pa.Table) -> pa.Table:
        names, facts, ids, block = (table.column(c).to_pylist() for c in ("names", "facts", "ids", "block"))
        distinct, place, _ = ranked(b"".join(names))
        known = np.zeros(len(distinct), FACT)
        where = np.zeros(len(distinct), np.int64)
        ends = np.cumsum([len(x) // DIGEST for x in names]).tolist()
        runs = list(zip([0, *ends], ends, facts, block, strict=False))
        offset, kept = 0, []
        for (x, y, f, _), raw in zip(runs, ids, strict=True):
            if f is not None:
                known[place[x:y]] = fact = np.frombuffer(f, FACT)
                where[place[x:y]] = offset + np.cumsum(fact["n"]) - fact["n"]
                if payloads:
                    kept.append(raw)
                    offset += len(raw) // 4
        flat = np.frombuffer(b"".join(kept), "<u4")
        out = []
        for x, y, f, k in runs:
            if f is None:
                own = known[place[x:y]]
                if (own["n"] == 0).any():
                    raise ValueError("a recipe names a chunk that is missing")
                n = own["n"].astype(np.int64)
                out.append((k, squeeze(flat[np.repeat(where[place[x:y]] - (np.cumsum(n) - n), n) + np.arange(n.sum())] if payloads else own)))
        n = len(out)
        cols = [pa.array([k for k, _ in out], pa.int64()), pa.array([0] * n, pa.int32()), pa.array([table.column("bucket")[0].as_py()] * n, pa.int32()), pa.array([v for _, v in out], pa.binary())]
        return pa.table(cols, names=["block", "kind", "bucket", "vals"])

    def put_together(row: dict, got: dict[int, np.ndarray]) -> pa.Table:
        return assemble(row, got[0], ranked(row["names"])[1])

    asked = blocks.select("block", "names").mapInArrow(ask, "bucket int, names binary, facts binary, ids binary, block bigint")
    runs = stored_chunks(spark, path, bits, payloads).withColumn("block", F.lit(None).cast("bigint")).union(asked)
    replies = runs.groupBy("bucket").applyInArrow(look_up, "block bigint, kind int, bucket int, vals binary")
    found = meet(blocks.drop("leaves"), replies, put_together, value_type, f"shard int, {schema}")
    # one row a shard: a window over a few rows, not over the documents
    shards = spark.read.schema(MANIFEST).parquet(f"{path}/manifest").where("kind = 'shard'").select("shard", "n_tokens")
    before = shards.select("shard", F.coalesce(F.sum("n_tokens").over(Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    return found.join(before, "shard").withColumn("start", F.col("start") + F.col("before")).drop("shard", "before")


def documents(spark: SparkSession, path: str, id_col: str = "doc_id") -> DataFrame:
    """Per document, from the files alone: id, start, n_tokens, ids_crc32: the chunks' CRCs, computed from their stored ids, put together."""

    def assemble(row: dict, facts: np.ndarray, place: np.ndarray) -> pa.Table:
        bounds, size, facts = expand(row["bounds"], np.int64), expand(row["sizes"], "<u2").astype(np.int64), facts[place]
        if not np.array_equal(facts["n"], size):
            raise ValueError("a recipe names a chunk of another length")
        crc = joined_crc(size, facts["crc"], bounds).astype(np.int64)
        n = len(row["ids"])
        return pa.table([pa.array([row["shard"]] * n, pa.int32()), pa.array(row["ids"], pa.int64()), pa.array(expand(row["within"], np.int64)), pa.array(np.add.reduceat(size, bounds[:-1])), pa.array(crc)], names=["shard", "id", "start", "n_tokens", "ids_crc32"])

    out = _assembled(spark, path, assemble, FACT, "id bigint, start bigint, n_tokens bigint, ids_crc32 bigint", False)
    return out.select(F.col("id").alias(id_col), "start", "n_tokens", "ids_crc32")


def read_ids(spark: SparkSession, path: str, id_col: str = "doc_id") -> DataFrame:
    """Per document: id, start, ids: its whole stream, put together from the stored chunks, which travel to the blocks of recipes."""

    def assemble(row: dict, flat: np.ndarray, place: np.ndarray) -> pa.Table:
        bounds, size = expand(row["bounds"], np.int64), expand(row["sizes"], "<u2").astype(np.int64)
        # sizes of the distinct chunks, in the order in which the replies hold them
        of = np.zeros(place.max() + 1, np.int64)
        of[place] = size
        if of.sum() != len(flat) or not np.array_equal(of[place], size):
            raise ValueError("a recipe names a chunk of another length")
        begin = (np.cumsum(of) - of)[place]
        ids = flat[np.repeat(begin - (np.cumsum(size) - size), size) + np.arange(size.sum())]
        ends = np.append(0, np.cumsum(size))[bounds]
        lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(ids.astype(np.int64)))
        n = len(row["ids"])
        return pa.table([pa.array([row["shard"]] * n, pa.int32()), pa.array(row["ids"], pa.int64()), pa.array(expand(row["within"], np.int64)), lists], names=["shard", "id", "start", "ids"])

    out = _assembled(spark, path, assemble, "<u4", "id bigint, start bigint, ids array<bigint>", True)
    return out.select(F.col("id").alias(id_col), "start", "ids")
