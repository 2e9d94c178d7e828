"""An additive model by boosting: one step function a feature, and one for each of some pairs of features, grown in rounds on what is left over.

Features are cut into bins once (a value that is missing has a bin of its own), and rows are packed as bin numbers. In a round one pass gives the sums of the residuals by
(feature, bin), whose means are each feature's direction, and a second one tells how far to go along all directions together (a small least-squares system, a number a
feature). Every bag leaves out another part of the rows, by hash, which judges its rounds; the bags go through the same passes side by side, and
the model is their mean. Sums, not rows, come to the driver: bins x features x bags numbers.
"""

from __future__ import annotations

from collections.abc import Sequence
from itertools import combinations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .models import bin_edges
from .packed import Packed, pack, summed

#: Parts of a feature's range in a pair; the share of a direction that a round goes; rounds without a better validation error before a bag stops.
PAIR_BINS, RATE, PATIENCE = 8, 0.5, 4
#: The parts of the residuals' square sums that weigh directions down, so that features that say the same share a step.
RIDGE = 1e-3


def _bag(t: np.ndarray, bag: int, validation: float, seed: int) -> np.ndarray:
    """Which rows a bag trains on, by a hash of the row's own hash."""
    x = (t.astype(np.uint64) + np.uint64(((bag + 1) * 0x9E3779B97F4A7C15 + seed) % 2**64)) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x94D049BB133111EB)
    return (x >> np.uint64(11)).astype(np.float64) / 2**53 >= validation


class _Layout:
    """Where each term's bins stand in one flat table, and a row's places in it."""

    def __init__(self, n_features: int, bins: int, pairs: Sequence[tuple[int, int]]):
        self.p, self.bins, self.pairs = n_features, bins, list(pairs)
        sizes = [bins + 1] * n_features + [(PAIR_BINS + 1) ** 2] * len(self.pairs)
        self.start = np.append(0, np.cumsum(sizes))

    def places(self, x: np.ndarray) -> np.ndarray:
        """(rows, terms): a coarse bin of a pair is a run of bins; missing values have the last."""
        x = x.astype(np.int64)
        coarse = np.where(x == self.bins, PAIR_BINS, x * PAIR_BINS // self.bins)
        cells = [coarse[:, a] * (PAIR_BINS + 1) + coarse[:, b] for a, b in self.pairs]
        return np.column_stack([x, *cells]) + self.start[:-1]


def _rounds(packed: Packed, layout: _Layout, tables: np.ndarray, intercepts: np.ndarray, rounds: int, least: int, validation: float, seed: int) -> np.ndarray:
    """Tables (bags, places) after boosting from those given. A bag keeps those of its best round."""
    bags, size = tables.shape
    terms = len(layout.start) - 1
    best, score, bad = tables.copy(), np.full(bags, np.inf), np.zeros(bags, int)
    for turn in range(rounds + 1):

        def sums(x, y, t, tables=tables):
            at = layout.places(x)
            out = []
            for b in range(bags):
                own = _bag(t, b, validation, seed)
                r = y - intercepts[b] - tables[b][at].sum(axis=1)
                flat = at[own].ravel()
                out += [np.bincount(flat, np.repeat(r[own], terms), size), np.bincount(flat, minlength=size), [(r[~own] ** 2).sum(), (r[own] ** 2).sum()]]
            return np.concatenate(out)

        got = summed(packed, sums, bags * (2 * size + 2)).reshape(bags, 2 * size + 2)
        error = got[:, -2] if validation else got[:, -1]
        better = error < score * (1 - 1e-6)
        best[better], score[better] = tables[better], error[better]
        bad = np.where(better, 0, bad + 1)
        if turn == rounds or (bad >= PATIENCE).all():
            return best
        total, n = got[:, :size], got[:, size : 2 * size]
        way = np.where(n >= least, total / np.maximum(n, 1), 0.0)

        def grams(x, y, t, tables=tables, way=way):
            at = layout.places(x)
            out = []
            for b in range(bags):
                own = _bag(t, b, validation, seed)
                r = (y - intercepts[b] - tables[b][at].sum(axis=1))[own]
                d = way[b][at[own]]
                out += [(d.T @ d).ravel(), d.T @ r]
            return np.concatenate(out)

        both = summed(packed, grams, bags * (terms * terms + terms)).reshape(bags, -1)
        for b in range(bags):
            gram, pull = both[b, : terms * terms].reshape(terms, terms), both[b, terms * terms :]
            far = np.linalg.lstsq(gram + RIDGE * np.trace(gram) / terms * np.eye(terms), pull, rcond=None)[0]
            tables[b] = tables[b] + RATE * np.repeat(far, np.diff(layout.start)) * way[b]
    return best


class Boosted:
    """`fit` gives a BoostedModel. bins: of each feature; pairs: terms of two features; bags: models of which the mean is taken; validation: the rows that a bag leaves out."""

    def __init__(self, features: Sequence[str], target: str, bins: int = 32, rounds: int = 30, bags: int = 4, pairs: int = 0, validation: float = 0.15, least: int = 4, seed: int = 42):
        self.features, self.target, self.bins, self.rounds, self.bags, self.pairs = list(features), target, bins, rounds, bags, pairs
        self.validation, self.least, self.seed = validation, least, seed

    def fit(self, frame: DataFrame) -> BoostedModel:
        rows = frame.where(F.col(f"`{self.target}`").isNotNull())
        edges = bin_edges(rows, self.features, self.bins)
        mark = F.pmod(F.xxhash64(*(F.col(f"`{c}`") for c in [*self.features, self.target])), F.lit(2**40))
        packed = pack(rows, [binned(f, edges[f], self.bins) for f in self.features], F.col(f"`{self.target}`"), mark, np.uint16)
        p, bags = len(self.features), self.bags

        def totals(x, y, t):
            return np.concatenate([[m.sum(), y[m].sum()] for m in (_bag(t, b, self.validation, self.seed) for b in range(bags))])

        n = summed(packed, totals, 2 * bags).reshape(bags, 2)
        if not n[:, 0].all():
            raise ValueError("a bag has no rows to train on")
        intercepts = n[:, 1] / n[:, 0]
        layout = _Layout(p, self.bins, [])
        tables = _rounds(packed, layout, np.zeros((bags, layout.start[-1])), intercepts, self.rounds, self.least, self.validation, self.seed)
        if self.pairs and p > 1:
            layout = _Layout(p, self.bins, self._pairs(packed, layout, tables.mean(axis=0), intercepts.mean()))
            wide = np.zeros((bags, layout.start[-1]))
            wide[:, : tables.shape[1]] = tables
            tables = _rounds(packed, layout, wide, intercepts, self.rounds, self.least, self.validation, self.seed)
        return self._centred(packed, layout, tables.mean(axis=0), float(intercepts.mean()), edges)

    def _pairs(self, packed: Packed, layout: _Layout, table: np.ndarray, intercept: float) -> list[tuple[int, int]]:
        """The pairs whose cells explain most of what the single features leave over, from one pass over the sums of all cells."""
        every = list(combinations(range(layout.p), 2))
        wide, cells = _Layout(layout.p, self.bins, every), (PAIR_BINS + 1) ** 2

        def sums(x, y, t):
            at = wide.places(x)
            r = y - intercept - table[at[:, : layout.p]].sum(axis=1)
            flat = (at[:, layout.p :] - wide.start[layout.p]).ravel()
            size = len(every) * cells
            return np.concatenate([np.bincount(flat, np.repeat(r, len(every)), size), np.bincount(flat, minlength=size)])

        total, n = summed(packed, sums, 2 * len(every) * cells).reshape(2, len(every), cells)
        gain = np.where(n >= self.least, total * total / np.maximum(n, 1), 0).sum(axis=1)
        return [every[k] for k in np.argsort(-gain, kind="stable")[: self.pairs]]

    def _centred(self, packed: Packed, layout: _Layout, table: np.ndarray, intercept: float, edges: dict[str, list[float]]) -> BoostedModel:
        """Each term with a mean of 0 over the rows; what is taken off goes to the intercept."""
        size = len(table)
        n = summed(packed, lambda x, y, t: np.bincount(layout.places(x).ravel(), minlength=size).astype(float), size)
        terms = [*self.features, *(f"{self.features[a]} & {self.features[b]}" for a, b in layout.pairs)]
        weights = {}
        for name, a, b in zip(terms, layout.start[:-1], layout.start[1:], strict=True):
            mean = (table[a:b] * n[a:b]).sum() / max(n[a:b].sum(), 1)
            weights[name], intercept = table[a:b] - mean, intercept + mean
        return BoostedModel(self.features, edges, self.bins, {terms[layout.p + k]: (self.features[a], self.features[b]) for k, (a, b) in enumerate(layout.pairs)}, weights, float(intercept))


def binned(feature: str, edges: Sequence[float], bins: int) -> Column:
    """A value's bin: the edges below it; `bins` for null and NaN."""
    v = F.col(f"`{feature}`").cast("double")
    below = F.size(F.filter(F.array(*map(F.lit, edges)), lambda e: e < v)) if edges else F.lit(0)
    return F.when(v.isNull() | F.isnan(v), F.lit(bins)).otherwise(below).cast("int")


class BoostedModel:
    """terms: the features, then the pairs; `transform` adds each term's `_bin_<term>` and `prediction`, the sum of the intercept and the terms' weights."""

    def __init__(self, features: list[str], edges: dict[str, list[float]], bins: int, pairs: dict[str, tuple[str, str]], weights: dict[str, np.ndarray], intercept: float):
        self.features, self.edges, self.bins, self.pairs, self.weights, self.intercept = features, edges, bins, pairs, weights, intercept
        self.terms = list(weights)

    def transform(self, frame: DataFrame) -> DataFrame:
        rows = frame.withColumns({f"_bin_{f}": binned(f, self.edges[f], self.bins) for f in self.features})

        def coarse(f: str) -> Column:
            b = F.col(f"`_bin_{f}`")
            return F.when(b == self.bins, PAIR_BINS).otherwise(F.floor(b * PAIR_BINS / self.bins)).cast("int")

        if self.pairs:
            rows = rows.withColumns({f"_bin_{t}": coarse(a) * (PAIR_BINS + 1) + coarse(b) for t, (a, b) in self.pairs.items()})
        weight = lambda t: F.get(F.array(*(F.lit(float(w)) for w in self.weights[t])), F.col(f"`_bin_{t}`"))
        return rows.withColumn("prediction", sum((weight(t) for t in self.terms), F.lit(self.intercept)))

    def coefficients(self, frame: DataFrame) -> list[tuple[str, int, float]]:
        """(term, bin, weight)."""
        return [(t, b, float(w)) for t in self.terms for b, w in enumerate(self.weights[t])]
