"""BPE encoding and decoding with batched merge rounds in numpy.

The distinct words of a batch of texts become one flat array of symbols. In each round the rank of
every neighbouring pair is looked up by binary search over the sorted pair keys, the lowest-ranked pair of each word is
merged wherever it stands in that word, and words without a known pair leave the array. Texts are then put together from the ids
of their words. Tasks work on their own rows only; nothing is shuffled or gathered.
"""

from __future__ import annotations

import hashlib
import json
import re
import unicodedata
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Unicode white space, as the regular expressions of the vocabulary files see it.
SPACE = r"[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"
#: Bytes that stand for themselves in byte-level vocabularies; the others take the next free code points from 256.
PLAIN_BYTES = (*range(33, 127), *range(161, 173), *range(174, 256))
#: Characters of text that are worked on at once, and words that a task remembers.
BATCH_CHARS, CACHE_WORDS = 4_000_000, 400_000


def byte_symbols() -> list[str]:
    rest = iter(range(256, 512))
    return [chr(b) if b in set(PLAIN_BYTES) else chr(next(rest)) for b in range(256)]


class WordBpe:
    """A vocabulary file of lower-cased words with an end-of-word suffix, for encoding and decoding."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, vocab = spec["model"], spec["model"]["vocab"]
        suffix = model["end_of_word_suffix"]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.names: dict[int, str] = {i: t for t, i in vocab.items()} | {i: t for t, i in self.special.items()}
        self.size = max(self.names) + 1
        signs = byte_symbols()
        self.inner = np.array([vocab[s] for s in signs], dtype=np.int64)
        self.final = np.array([vocab[s + suffix] for s in signs], dtype=np.int64)
        pairs = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        keys = np.array([vocab[a] * self.size + vocab[b] for a, b in pairs], dtype=np.int64)
        order = np.argsort(keys, kind="stable")
        self.keys, self.ranks = keys[order], order.astype(np.int64)
        self.merged = np.array([vocab[a + b] for a, b in pairs], dtype=np.int64)[order]
        steps = spec["pre_tokenizer"]["pretokenizers"]
        self.piece = regex.compile(steps[0]["pattern"]["Regex"])
        self.split_special = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.white = re.compile(SPACE + "+")
        self.cache: dict[str, bytes] = {}
        self.known: dict[str | int, bytes] = {}
        self.forget()

    def forget(self) -> None:
        self.cache.clear()
        self.known = {i: int(i).to_bytes(4, "little") for i in self.special.values()}

    def words(self, text: str) -> list[str]:
        """Pieces between white space. str.split() also splits at four control characters that aren't white space here."""
        if any(c in text for c in "\x1c\x1d\x1e\x1f"):
            return [w for w in self.white.split(text) if w]
        return text.split()

    def pieces(self, word: str) -> list[str | int]:
        """Normalised pieces of a word, and the ids of special tokens in it."""
        if word.isascii() and word.isalpha():
            return [word.lower()]
        parts = self.split_special.split(word) if self.split_special and "<" in word else [word]
        out: list[str | int] = []
        for part in parts:
            if part in self.special:
                out.append(self.special[part])
            elif part:
                part = unicodedata.normalize("NFC", part)
                # letter by letter: str.lower() alone maps a sigma by its place in the word
                out += self.piece.findall(part.replace("Σ", "σ").lower())
        return out

    def _rank(self, symbol: np.ndarray, word: np.ndarray, at: np.ndarray, rank: np.ndarray, where: np.ndarray) -> None:
        """Looks up the pairs that start at `where`; the rank of an unknown pair, or of a word's last symbol, is the number of pairs."""
        inner = where[where < len(symbol) - 1]
        rank[where[where >= len(symbol) - 1]] = len(self.keys)
        key = symbol[inner] * self.size + symbol[inner + 1]
        at[inner] = found = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        rank[inner] = np.where((self.keys[found] == key) & (word[inner] == word[inner + 1]), self.ranks[found], len(self.keys))

    def merge(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all pieces in one array, and the number of ids of each."""
        raw = [p.encode("utf-8", "surrogatepass") for p in pieces]
        size = np.fromiter(map(len, raw), dtype=np.int64, count=len(raw))
        flat = np.frombuffer(b"".join(raw), dtype=np.uint8)
        word = np.repeat(np.arange(len(raw)), size)
        symbol = self.inner[flat]
        ends = np.cumsum(size)[size > 0] - 1
        symbol[ends] = self.final[flat[ends]]
        done: list[tuple[np.ndarray, np.ndarray]] = []
        at, rank = np.zeros(len(symbol), np.int64), np.full(len(symbol), len(self.keys))
        self._rank(symbol, word, at, rank, np.arange(len(symbol)))
        while len(symbol):
            starts = np.flatnonzero(np.append(True, word[1:] != word[:-1]))
            best = np.repeat(np.minimum.reduceat(rank, starts), np.diff(np.append(starts, len(word))))
            over = best == len(self.keys)
            if over.any():
                done.append((word[over], symbol[over]))
            hit = (rank == best) & ~over
            # of a run of equal pairs that overlap (a a a), every second one from the left is merged
            place = np.arange(len(hit))
            run = np.maximum.accumulate(np.where(hit & ~np.append(False, hit[:-1]), place, 0))
            first = np.flatnonzero(hit & ((place - run) % 2 == 0))
            symbol[first] = self.merged[at[first]]
            keep = ~over
            keep[first + 1] = False
            touched = (np.cumsum(keep) - 1)[first]
            word, symbol, at, rank = word[keep], symbol[keep], at[keep], rank[keep]
            self._rank(symbol, word, at, rank, np.append(touched, touched[touched > 0] - 1))
        if not done:
            return np.zeros(0, np.int64), np.zeros(len(raw), np.int64)
        word, symbol = (np.concatenate(x) for x in zip(*done, strict=True))
        order = np.argsort(word, kind="stable")
        return symbol[order], np.bincount(word, minlength=len(raw))

    def learn(self, new: list[str]) -> None:
        """Puts the ids of words into the cache, as unsigned 32-bit integers; words that differ in case or punctuation share pieces."""
        parts = [self.pieces(w) for w in new]
        fresh = [p for p in {p for ps in parts for p in ps}.difference(self.known) if isinstance(p, str)]
        ids, counts = self.merge(fresh)
        raw, end = ids.astype("<u4").tobytes(), (4 * np.cumsum(counts)).tolist()
        self.known.update(zip(fresh, map(raw.__getitem__, map(slice, [0, *end], end)), strict=False))
        of = self.known
        for w, ps in zip(new, parts, strict=True):
            self.cache[w] = of[ps[0]] if len(ps) == 1 else b"".join([of[p] for p in ps])

    def encode(self, texts: Iterable[str | None]) -> Iterator[bytes]:
        """For each text its ids as little-endian unsigned 32-bit integers; null counts as empty."""
        batch: list[list[str]] = []
        chars = 0
        for text in texts:
            batch.append(self.words(text or ""))
            chars += len(text or "")
            if chars >= BATCH_CHARS:
                yield from self._encode(batch)
                batch, chars = [], 0
        yield from self._encode(batch)

    def _encode(self, batch: list[list[str]]) -> Iterator[bytes]:
        if len(self.cache) > CACHE_WORDS:
            self.forget()
        new = set().union(*batch).difference(self.cache)
        self.learn(list(new))
        of = self.cache.__getitem__
        for ws in batch:
            yield b"".join(map(of, ws))

    def decode(self, ids: np.ndarray) -> str:
        """The tokens' strings with a blank between two of them, as the vocabulary file has no decoder."""
        return " ".join(map(self.names.__getitem__, ids.tolist()))


_LOADED: dict[str, WordBpe] = {}


def load(path: str) -> WordBpe:
    """One for each Python worker and file."""
    if path not in _LOADED:
        _LOADED[path] = WordBpe(path)
    return _LOADED[path]


def _added(rows: DataFrame, source: str, column: str, kind: str, work: Callable[[list], pa.Array]) -> DataFrame:
    """The rows with one column more, worked out from column `source`; a column of its name is replaced. Columns go by number, so that any names will do."""
    fields = [f for f in rows.schema if f.name != column]
    held = rows.select(*(F.col(f"`{f.name}`").alias(f"c{k}") for k, f in enumerate(fields)), F.col(f"`{source}`").alias("source"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], work(b.column(len(fields)).to_pylist())], names=[f"c{k}" for k in range(len(fields) + 1)])

    schema = ", ".join([*(f"c{k} {f.dataType.simpleString()}" for k, f in enumerate(fields)), f"c{len(fields)} {kind}"])
    return held.mapInArrow(run, schema).toDF(*(f.name for f in fields), column)


def _lists(raws: list[bytes]) -> pa.ListArray:
    """Each text's ids as one entry of array<int>, over one flat array."""
    ends = np.cumsum([0, *(len(x) // 4 for x in raws)])
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.frombuffer(b"".join(raws), "<u4").astype(np.int32)))


def encode(docs: DataFrame, path: str, text_col: str = "text", ids_col: str = "ids") -> DataFrame:
    """Every row with its ids as array<int>; null text gives an empty array. A column named as ids_col is replaced."""
    return _added(docs, text_col, ids_col, "array<int>", lambda texts: _lists(list(load(path).encode(texts))))


def decode(rows: DataFrame, path: str, ids_col: str = "ids", text_col: str = "decoded") -> DataFrame:
    """Every row with the text of its ids; null ids give an empty text. A column named as text_col is replaced."""
    return _added(rows, ids_col, text_col, "string", lambda ids: pa.array([load(path).decode(np.array(x or [], np.int64)) for x in ids], pa.string()))


def _decoded_sha(bpe: WordBpe, raw: bytes) -> str:
    return hashlib.sha256(bpe.decode(np.frombuffer(raw, "<u4")).encode()).hexdigest()


def encode_digests(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, n_tokens and SHA-256 of the ids and of the text that they decode to. Null text counts as empty."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(path)
        for b in batches:
            n, ids_sha, text_sha = [], [], []
            for raw in bpe.encode(b.column(1).to_pylist()):
                n.append(len(raw) // 4)
                ids_sha.append(hashlib.sha256(raw).hexdigest())
                text_sha.append(_decoded_sha(bpe, raw))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(ids_sha, pa.string()), pa.array(text_sha, pa.string())], names=[id_col, "n_tokens", "ids_sha256", "decoded_sha256"])

    rows = docs.select(f"`{id_col}`", f"`{text_col}`")
    kind = rows.schema[0].dataType.simpleString()
    return rows.mapInArrow(work, f"`{id_col}` {kind}, n_tokens bigint, ids_sha256 string, decoded_sha256 string")


#: Rows that round_trip works on at once, so that a task holds the ids and decoded texts of no more.
ROUND_TRIP_ROWS = 1_000


def round_trip(docs: DataFrame, path: str, text_col: str = "text") -> DataFrame:
    """Every row without its text, with ids array<int> and decoded_sha256, the SHA-256 of the text that they decode to.

    Both ways in one pass, so that a task has one Python worker and the ids don't leave it in between. Null text counts as empty. Columns
    named ids or decoded_sha256 are replaced; other columns come out whole, whatever their names.
    """
    fields = [f for f in docs.schema if f.name not in (text_col, "ids", "decoded_sha256")]
    held = docs.select(*(F.col(f"`{f.name}`").alias(f"c{k}") for k, f in enumerate(fields)), F.col(f"`{text_col}`").alias("source"))
    names = [*(f"c{k}" for k in range(len(fields))), "ids", "decoded_sha256"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(path)
        for b in (x.slice(k, ROUND_TRIP_ROWS) for x in batches for k in range(0, x.num_rows, ROUND_TRIP_ROWS)):
            raws = list(bpe.encode(b.column(len(fields)).to_pylist()))
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], _lists(raws), pa.array([_decoded_sha(bpe, x) for x in raws], pa.string())], names=names)

    schema = ", ".join([*(f"c{k} {f.dataType.simpleString()}" for k, f in enumerate(fields)), "ids array<int>, decoded_sha256 string"])
    return held.mapInArrow(run, schema).toDF(*(f.name for f in fields), "ids", "decoded_sha256")
