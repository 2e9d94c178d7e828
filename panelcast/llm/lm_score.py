"""LM scoring with a weighted backoff automaton of word n-grams, smoothed with Dirichlet priors.

States are contexts of up to order - 1 words that occur in training; the root stands for none. The arc of word w from state h carries
log10 p(w|h) with p(w|h) = (c(h,w) + mu p(w|h')) / (c(h) + mu), for each n-gram (h, w) seen in training; h' is h without its first word. Every
other word leaves h by its failure arc, of weight log10(mu / (c(h) + mu)), to the state h', and so on until a state has an arc; the root has arcs with
p(w) = (c(w) + 1) / (N + V + 1) and one for all words unseen. Weights of a state sum to 1. The end of a text is a word of its own, and a state
of that one word is where the next text starts.

Counts cover all training documents: blocks of documents ask buckets of keys for the counts of their n-grams, which make the states and arcs that their own texts
can reach. An arc leads to the longest suffix of its n-gram that is a state. Texts are then traversed once from left to right, those of a block in lockstep: each has one state, which every
word moves on. Long texts are cut into stretches that start at the root order - 1 words earlier, after which the state is the one that the whole text before leads to.

`fit` writes the counts of a training table once, as a model; `score` with a model scores any other texts. Without one it fits on the table's own training rows and scores all of its rows
with one exchange of keys.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .blocks import REPLIES, U64, Block, answer, bucket_bits, chain, cut_runs, expand, meet, pack_keys, send, squeeze, staged_pack, sums, unpack_keys
from .common import new_path, stage

#: Weights of the priors in states of one word, two words and so on, in words. There is one order more than weights.
MUS = (500.0, 50.0)
#: Words of a stretch of a text that is traversed on its own.
STRETCH = 1000
#: Key of the end of a text.
END = U64(0x5AFE_C0DE_0000_0E0D)
COUNTS = "kind int, bucket int, keys binary, vals binary"
SCORES = "id bigint, held_out boolean, n_tokens bigint, n_known bigint, base_score double, score double"


def held_out(id_col) -> object:
    return F.crc32(F.coalesce(id_col.cast("string"), F.lit(""))) % 7 == 2


class Stream:
    """A block's words and ends in one array, and the n-grams that end at each of them.

    grams[k - 1]: keys of the distinct n-grams of k words; gram[k - 1]: number of the n-gram that ends at each token, or -1 where the text doesn't reach
    back so far. The end before a text counts as its word before the first.
    """

    def __init__(self, block: Block, order: int):
        words = np.union1d(block.words, np.array([END], U64))
        end = np.searchsorted(words, END)
        moved = np.searchsorted(words, block.words)[block.stream] if len(block.stream) else np.zeros(0, np.int64)
        word = np.insert(moved, block.bounds[1:], end)
        self.end, self.sizes = int(end), np.diff(block.bounds) + 1
        self.starts = np.append(0, np.cumsum(self.sizes))[:-1]
        self.trained = np.repeat(block.flags == 0, self.sizes)
        self.grams, self.gram = [words], [word.astype(np.int32)]
        place = np.arange(len(word)) - np.repeat(self.starts, self.sizes)
        last = words[word]
        key = chain(words[np.append(end, word[:-1])], last)
        for k in range(2, order + 1):
            whole = np.flatnonzero(place >= k - 2)
            grams, which = np.unique(key[whole], return_inverse=True)
            number = np.full(len(word), -1, np.int32)
            number[whole] = which
            self.grams.append(grams)
            self.gram.append(number)
            key = np.append(U64(0), chain(key[:-1], last[1:]))

    def counts(self, k: int) -> np.ndarray:
        """How often each n-gram of k words ends at a token of a training text."""
        number = self.gram[k - 1]
        return np.bincount(number[self.trained & (number >= 0)], minlength=len(self.grams[k - 1])).astype(np.uint32)


class Automaton:
    """The part of the automaton that a block's texts can reach.

    State 0 is the root; the state of an n-gram of k words is first[k - 1] + its number, if training has it. `fail` and `weight` are each state's failure arc, and `code`,
    `gain` and `target` the arcs of the states of k words, sorted by (state, word); the root has an arc for every word.
    """

    def __init__(self, stream: Stream, seen: list[np.ndarray], tokens: int, kinds: int, mus: tuple[float, ...]):
        self.stream, self.order, self.words = stream, len(mus) + 1, len(seen[0])
        order = self.order
        self.first = np.cumsum([1, *map(len, seen)])  # number of the first state of each length
        self.fail, self.weight = np.zeros(self.first[order - 1], np.int32), np.zeros(self.first[order - 1])
        p = (seen[0] + 1) / (tokens + kinds + 1)
        self.root_gain, self.root_target = np.log10(p), np.where(seen[0] > 0, 1 + np.arange(self.words), 0) if order > 1 else np.zeros(self.words, np.int64)
        self.code, self.gain, self.target = [None], [None], [None]
        for k in range(1, order):
            own = slice(self.first[k - 1], self.first[k])
            self.weight[own] = np.log10(mus[k - 1] / (seen[k - 1] + mus[k - 1]))
            # one place of each n-gram of k + 1 words: its context, its suffix and its last word
            at = self._places(k)
            context = stream.gram[k - 1][at - 1]
            if k == 1:  # the word before a text's first is the end
                context[np.isin(at, stream.starts)] = stream.end
            suffix = stream.gram[k - 1][at]
            p = p[suffix]
            p *= mus[k - 1]
            p += seen[k]
            p /= seen[k - 1][context] + mus[k - 1]
            if k > 1:  # the longest suffix of a state of k words is the n-gram without its first word
                self.fail[own] = self.first[k - 2] + stream.gram[k - 2][self._places(k - 1)]
            arcs = np.flatnonzero(seen[k] > 0).astype(np.int32)
            code = (context[arcs] + self.first[k - 1]) * self.words + stream.gram[0][at[arcs]]
            del at, context
            to = (self.first[k] + arcs if k + 1 < order else self.first[k - 1] + suffix[arcs]).astype(np.int32)
            del suffix
            turn = np.argsort(code)
            self.code.append(code[turn])
            self.gain.append(np.log10(p[arcs])[turn])
            self.target.append(to[turn])
        self.begin = int(1 + stream.end) if order > 1 and seen[0][stream.end] else 0

    def _places(self, k: int) -> np.ndarray:
        """A place in the stream where each n-gram of k + 1 words ends."""
        number = self.stream.gram[k]
        whole = np.flatnonzero(number >= 0).astype(np.int32)
        at = np.empty(self.first[k + 1] - self.first[k], np.int32)
        at[number[whole]] = whole
        return at

    def step(self, state: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The states that words lead to, and the weights of the arcs taken."""
        total, after = np.zeros(len(state)), np.zeros(len(state), np.int64)
        left, now = np.arange(len(state)), state.copy()
        for k in range(self.order - 1, 0, -1):
            here = left[now[left] >= self.first[k - 1]]
            if not len(here) or not len(self.code[k]):
                hit = np.zeros(len(here), bool)
            else:
                want = now[here] * self.words + word[here]
                at = np.minimum(np.searchsorted(self.code[k], want), len(self.code[k]) - 1)
                hit = self.code[k][at] == want
                total[here[hit]] += self.gain[k][at[hit]]
                after[here[hit]] = self.target[k][at[hit]]
            miss = here[~hit]
            total[miss] += self.weight[now[miss]]
            now[miss] = self.fail[now[miss]]
            done = np.zeros(len(state), bool)
            done[here[hit]] = True
            left = left[~done[left]]
        total[left] += self.root_gain[word[left]]
        after[left] = self.root_target[word[left]]
        return after, total

    def traverse(self, stretch: int = STRETCH) -> np.ndarray:
        """Log-probability of each text: one pass over its words, from state to state."""
        s, back = self.stream, self.order - 1
        stretch = max(stretch, self.order)
        n = -(-s.sizes // stretch)
        text = np.repeat(np.arange(len(s.sizes)), n)
        nth = np.arange(len(text)) - np.repeat(np.cumsum(n) - n, n)
        low, high = s.starts[text] + nth * stretch, np.minimum(s.starts[text] + (nth + 1) * stretch, s.starts[text] + s.sizes[text])
        begin = np.where(nth > 0, low - back, low)
        order = np.argsort(begin - high, kind="stable")  # the longest first, so that those still under way are the first ones
        begin, low, high, text = begin[order], low[order], high[order], text[order]
        state = np.where(begin == low, np.where(nth[order] > 0, 0, self.begin), 0)
        total = np.zeros(len(text))
        for t in range(int((high - begin).max()) if len(text) else 0):
            going = int(np.searchsorted(begin - high, -t))
            at = begin[:going] + t
            state[:going], told = self.step(state[:going], s.gram[0][at])
            total[:going] += np.where(at >= low[:going], told, 0.0)
        return np.bincount(text, total, len(s.sizes))


class Model(NamedTuple):
    """Counts of all n-grams of a training table, in the shared folder: COUNTS by kind (words of an n-gram) and bucket, and what goes with them."""

    path: str
    mus: tuple[float, ...]
    bits: int
    tokens: int
    kinds: int


def _asks(order: int, bits: int):
    """The runs of a block: all its n-grams, and how often each stands in its training texts."""

    def ask(row: dict) -> Iterator[tuple]:
        block = Block(row)
        s = Stream(block, order)
        for k in range(1, order + 1):
            yield from cut_runs(k, block.block, s.grams[k - 1], s.counts(k), bits)

    return ask


def fit(docs: DataFrame, path: str | None = None, id_col: str = "doc_id", text_col: str = "text", mus: tuple[float, ...] = MUS, block_words: int | None = None) -> Model:
    """The model of all rows, written to `path` (a new one in the shared folder if none is given). `open_model` finds it again."""
    size = {"block_words": block_words} if block_words else {}
    blocks, words = staged_pack(docs, id_col, text_col, name="lm-train", **size)
    path, bits = path or new_path(docs.sparkSession, "lm-model"), bucket_bits(words)

    def count(table: pa.Table) -> pa.Table:
        keys = [unpack_keys(x.as_py()) for x in table.column("keys")]
        vals = np.concatenate([expand(x.as_py(), np.uint32) for x in table.column("vals")])
        distinct, place = np.unique(np.concatenate(keys), return_inverse=True)
        total = sums(0, place, vals, len(distinct))
        cells = [table.column("kind")[0].as_py(), table.column("bucket")[0].as_py(), pack_keys(distinct), squeeze(total), int(total.sum()), len(distinct)]
        kinds = [pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.int64(), pa.int64()]
        return pa.table([pa.array([c], t) for c, t in zip(cells, kinds, strict=True)], names=["kind", "bucket", "keys", "vals", "total", "size"])

    counted = send(blocks, _asks(len(mus) + 1, bits)).groupBy("kind", "bucket").applyInArrow(count, f"{COUNTS}, total bigint, size bigint")
    counted.write.parquet(f"{path}/counts")
    spark = docs.sparkSession
    told = spark.read.parquet(f"{path}/counts").where("kind = 1").agg(F.coalesce(F.sum("total"), F.lit(0)), F.coalesce(F.sum("size"), F.lit(0))).first()
    model = Model(path, tuple(mus), bits, told[0], told[1])
    spark.createDataFrame([(list(map(float, mus)), bits, *told)], "mus array<double>, bits int, tokens bigint, kinds bigint").coalesce(1).write.parquet(f"{path}/model")
    return model


def open_model(spark: SparkSession, path: str) -> Model:
    one = spark.read.parquet(f"{path}/model").first()
    return Model(path, tuple(one["mus"]), one["bits"], one["tokens"], one["kinds"])


def told_by(model: Model, runs: DataFrame) -> DataFrame:
    """Replies of a model's buckets to runs; n-grams that it doesn't have count 0."""
    counts = runs.sparkSession.read.parquet(f"{model.path}/counts").select("kind", "bucket", "keys", "vals")

    def work(asked: pa.Table, held: pa.Table) -> pa.Table:
        out = []
        if held.num_rows:
            known, n = unpack_keys(held.column("keys")[0].as_py()), expand(held.column("vals")[0].as_py(), np.int64)
        else:
            known, n = np.zeros(0, U64), np.zeros(0, np.int64)
        for block, kind, bucket, raw in zip(*(asked.column(c).to_pylist() for c in ("block", "kind", "bucket", "keys")), strict=True):
            keys = unpack_keys(raw)
            at = np.minimum(np.searchsorted(known, keys), max(len(known) - 1, 0))
            out.append((block, kind, bucket, squeeze(np.where(known[at] == keys, n[at], 0) if len(known) else np.zeros(len(keys), np.int64))))
        cells = list(zip(*out, strict=True)) or [[]] * 4
        return pa.table([pa.array(c, t) for c, t in zip(cells, [pa.int64(), pa.int32(), pa.int32(), pa.binary()], strict=True)], names=["block", "kind", "bucket", "vals"])

    return runs.groupBy("kind", "bucket").cogroup(counts.groupBy("kind", "bucket")).applyInArrow(work, REPLIES)


def score(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", mus: tuple[float, ...] = MUS, block_words: int | None = None, model: Model | None = None) -> DataFrame:
    """Per row: id, held_out, n_tokens, n_known, train_tokens, base_score, score. The order of the model is len(mus) + 1.

    With a model all rows are scored by it (and its mus), and held_out still tells which rows the split leaves out. A null text is empty and has one token, its end. A null id counts as the empty string
    for the split. Repeated rows each count and are each scored.
    Ids are integers. Words and n-grams are told apart by 64-bit keys; n of them hold two with one key with a chance of about n*n / 2**65. An empty
    table gives an empty one.
    """
    mus = mus if model is None else model.mus
    order = len(mus) + 1
    size = {"block_words": block_words} if block_words else {}
    blocks, words = staged_pack(docs, id_col, text_col, held_out(F.col(f"`{id_col}`")), name="lm-blocks", **size)

    def totals(kind: int, values: np.ndarray, keys: np.ndarray) -> np.ndarray:
        return np.array([values.sum(), (values > 0).sum()], np.int64) * (kind == 1)

    def read_totals(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            pairs = [expand(x, np.int64) for x in b.column("vals").to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array([int(x[j]) for x in pairs], pa.int64()) for j in (0, 1)], names=["tokens", "kinds"])

    if model is None:
        # staged, so that the runs' shuffle files are gone before the replies move
        replies = stage(answer(send(blocks, _asks(order, bucket_bits(words))), np.uint32, sums, totals), "lm-counts")
        sums_of = replies.where("block = -1 and kind = 1").select("vals").mapInArrow(read_totals, "tokens bigint, kinds bigint")
        tokens, kinds = sums_of.agg(F.coalesce(F.sum("tokens"), F.lit(0)), F.coalesce(F.sum("kinds"), F.lit(0))).first()
    else:
        replies, tokens, kinds = told_by(model, send(blocks, _asks(order, model.bits))), model.tokens, model.kinds

    def run(row: dict, got: dict[int, np.ndarray]) -> pa.Table:
        block = Block(row)
        s = Stream(block, order)
        s.grams, block.words, block.stream = [], None, None  # the replies are in their order; the keys themselves have done their part
        fsa = Automaton(s, [got.get(k, np.zeros(0, np.int64)) for k in range(1, order + 1)], tokens, kinds, mus)
        total = lambda x: np.add.reduceat(x, s.starts)  # noqa: E731  no text is without its end
        word = s.gram[0]
        cells = [
            pa.array(block.ids, pa.int64()), pa.array(block.flags != 0), pa.array(s.sizes, pa.int64()), pa.array(total((got[1][word] > 0).astype(np.int64)), pa.int64()),
            pa.array(total(fsa.root_gain[word]), pa.float64()), pa.array(fsa.traverse(), pa.float64()),
        ]
        return pa.table(cells, names=["id", "held_out", "n_tokens", "n_known", "base_score", "score"])

    out = meet(blocks, replies, run, np.int64, SCORES)
    return out.select(F.col("id").alias(id_col), "held_out", "n_tokens", "n_known", F.lit(tokens).cast("bigint").alias("train_tokens"), "base_score", "score")
