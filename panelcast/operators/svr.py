"""Support-vector regression with kernels: primal fits with the epsilon-insensitive loss on explicit feature maps.

A point (c, epsilon, kernel, width, degree) asks for the least of |w|^2 / 2 + c * sum(max(0, |y - w.z(x) - b| - epsilon)) over standardised features, where z(x) . z(x') is
the kernel: the features themselves (linear), random Fourier features (rbf), all monomials of the degree (poly), and a Nystroem map on a bounded seeded sample
(sigmoid, of which the part with positive eigenvalues counts, and poly with too many monomials).

Rows are staged once as packed blocks. A step of the solver is one Spark job over them: every block gives the losses and gradients of all points and folds at
once, they are summed in two levels, and the driver holds a weight vector for each point and fold and no more. The corner of the loss is rounded, less so
from stage to stage; within a stage the solver is L-BFGS, all points and folds in lockstep, each with its own memory and step length.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from hashlib import blake2b
from itertools import combinations_with_replacement

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .evaluate import with_fold
from .packed import Packed, pack, summed
from .panel import PERIOD

#: Random Fourier features; landmarks of a Nystroem map; monomials up to which a polynomial is written out.
FOURIER, LANDMARKS, MONOMIALS = 256, 128, 1000
#: Widths of the rounded corner by stage, as parts of the target's deviation, and steps of a stage at most.
ROUNDING, STEPS, MEMORY = (0.3, 0.03, 0.003), 40, 10
#: Step lengths that are tried in one job.
TRIES = np.array([1.0, 0.5, 0.2, 0.05, 0.01, 0.001])


@dataclass(frozen=True)
class Point:
    """Penalty, half width of the tube, and kernel. gamma None: 1 / (features * variance of the standardised features), which is 1 / features."""

    c: float = 0.25
    epsilon: float = 0.25
    kernel: str = "linear"
    gamma: float | None = None
    degree: int = 3

    @property
    def map_key(self) -> tuple:
        return (self.kernel, None if self.kernel == "linear" else self.gamma, self.degree if self.kernel == "poly" else None)


class Map:
    """A feature map of standardised rows. landmarks: standardised rows that a Nystroem map rests on."""

    def __init__(self, kernel: str, gamma: float | None, degree: int | None, n_features: int, landmarks: np.ndarray, seed: int = 42):
        self.kernel, self.degree, self.gamma = kernel, degree, 1 / n_features if gamma is None else gamma
        if kernel == "rbf":
            rng = np.random.default_rng(seed)
            self.waves, self.shifts = rng.normal(0, math.sqrt(2 * self.gamma), (n_features, FOURIER)), rng.uniform(0, 2 * math.pi, FOURIER)
        elif kernel == "poly" and math.comb(n_features + degree - 1, degree) <= MONOMIALS:
            self.terms = [list(t) for t in combinations_with_replacement(range(n_features), degree)]
            ways = [math.factorial(degree) / math.prod(math.factorial(t.count(f)) for f in set(t)) for t in self.terms]
            self.scale = np.sqrt(np.array(ways) * self.gamma**degree)
        elif kernel in ("poly", "sigmoid"):
            self.landmarks = landmarks
            values, vectors = np.linalg.eigh(self._kernel(landmarks, landmarks))
            keep = values > 1e-8 * max(values.max(), 1e-300)
            self.basis = vectors[:, keep] / np.sqrt(values[keep])
        elif kernel != "linear":
            raise ValueError(f"no kernel {kernel}")

    def _kernel(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        dot = self.gamma * (a @ b.T)
        return np.tanh(dot) if self.kernel == "sigmoid" else dot**self.degree

    def __call__(self, x: np.ndarray) -> np.ndarray:
        if self.kernel == "linear":
            return x
        if self.kernel == "rbf":
            return np.cos(x @ self.waves + self.shifts) * math.sqrt(2 / FOURIER)
        if hasattr(self, "terms"):
            return np.prod(x[:, self.terms], axis=2) * self.scale
        return self._kernel(x, self.landmarks) @ self.basis

    def size(self, n_features: int) -> int:
        return self(np.zeros((1, n_features))).shape[1]


@dataclass
class Scaler:
    """Means and deviations of the features; a constant feature keeps its scale."""

    mean: np.ndarray
    deviation: np.ndarray

    def __call__(self, x: np.ndarray) -> np.ndarray:
        return (x - self.mean) / self.deviation


@dataclass
class Group:
    """Fits that share training rows (those with t below `before`), scaler and map."""

    before: float
    until: float
    scaler: Scaler
    map: Map
    c: np.ndarray
    epsilon: np.ndarray


def scalers(blocks: Packed, n_features: int, befores: Sequence[float]) -> list[tuple[int, Scaler, float, float]]:
    """For each bound of time the rows before it: their number, scaler, and the mean and deviation of the target. Two jobs: means, then squares around them."""
    p, g = n_features, len(befores)

    def sums(x, y, t):
        return np.concatenate([np.concatenate([[m.sum()], x[m].sum(axis=0), [y[m].sum()]]) for m in (t < b for b in befores)])

    first = summed(blocks, sums, g * (p + 2)).reshape(g, p + 2)
    n = np.maximum(first[:, 0], 1)[:, None]
    mean = first[:, 1:] / n

    def squares(x, y, t):
        both = np.column_stack([x, y])
        return np.concatenate([((both[t < b] - mean[k]) ** 2).sum(axis=0) for k, b in enumerate(befores)])

    deviation = np.sqrt(summed(blocks, squares, g * (p + 1)).reshape(g, p + 1) / n)
    safe = np.where(deviation > 0, deviation, 1.0)
    return [(int(first[k, 0]), Scaler(mean[k, :p], safe[k, :p]), float(mean[k, p]), float(safe[k, p])) for k in range(g)]


def losses(z: np.ndarray, y: np.ndarray, w: np.ndarray, c: np.ndarray, epsilon: np.ndarray, corner: float) -> tuple[np.ndarray, np.ndarray]:
    """For each column of w (the last row is the intercept) c times the sum of the rounded losses, and its gradient."""
    r = y[:, None] - z @ w[:-1] - w[-1]
    over = np.abs(r) - epsilon
    inside = np.clip(over, 0, corner)
    loss = c * (inside * inside / (2 * corner) + np.maximum(over - corner, 0)).sum(axis=0)
    pull = -c * np.sign(r) * inside / corner
    return loss, np.vstack([z.T @ pull, pull.sum(axis=0)])


def evaluate_all(blocks: Packed, groups: Sequence[Group], weights: Sequence[np.ndarray], corners: Sequence[float]) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """Objectives and gradients of all fits of all groups in one job. weights: for each group an array (size + 1, fits, tries)."""
    shapes = [w.shape for w in weights]
    sizes = [s[1] * s[2] * (1 + s[0]) for s in shapes]

    def work(x, y, t):
        out = []
        for g, w, corner in zip(groups, weights, corners, strict=True):
            own = t < g.before
            tries = w.shape[2]
            loss, grad = losses(g.map(g.scaler(x[own])), y[own], w.reshape(len(w), -1), np.repeat(g.c, tries), np.repeat(g.epsilon, tries), corner)
            out += [loss, grad.ravel()]
        return np.concatenate(out)

    flat, at = summed(blocks, work, sum(sizes)), 0
    values, gradients = [], []
    for w, shape, size in zip(weights, shapes, sizes, strict=True):
        fits = shape[1] * shape[2]
        loss, grad = flat[at : at + fits].reshape(shape[1:]), flat[at + fits : at + size].reshape(shape)
        ridge = w.copy()
        ridge[-1] = 0
        values.append(loss + (ridge * ridge).sum(axis=0) / 2)
        gradients.append(grad + ridge)
        at += size
    return values, gradients


class Memory:
    """The last steps and changes of gradient of one fit, for the direction of L-BFGS."""

    def __init__(self):
        self.pairs: list[tuple[np.ndarray, np.ndarray]] = []

    def add(self, s: np.ndarray, y: np.ndarray) -> None:
        if s @ y > 1e-12 * (y @ y):
            self.pairs = [*self.pairs[-MEMORY + 1 :], (s, y)]

    def direction(self, g: np.ndarray) -> np.ndarray:
        q, along = g.copy(), []
        for s, y in reversed(self.pairs):
            a = (s @ q) / (s @ y)
            along.append(a)
            q -= a * y
        if self.pairs:
            s, y = self.pairs[-1]
            q *= (s @ y) / (y @ y)
        else:
            q /= max(np.linalg.norm(g), 1e-12)
        for (s, y), a in zip(self.pairs, reversed(along), strict=True):
            q += (a - (y @ q) / (s @ y)) * s
        return -q


def solve(blocks: Packed, groups: Sequence[Group], starts: Sequence[float], spreads: Sequence[float], steps: int = STEPS, tolerance: float = 1e-5) -> list[np.ndarray]:
    """Weights (size + 1, fits) of each group; starts and spreads: mean and deviation of the target of each group."""
    sizes = [g.map.size(len(g.scaler.mean)) + 1 for g in groups]
    w = [np.zeros((s, len(g.c))) for s, g in zip(sizes, groups, strict=True)]
    for x, start in zip(w, starts, strict=True):
        x[-1] = start
    for rounding in ROUNDING:
        corners = [rounding * s for s in spreads]
        f, g = ([v[..., 0] for v in out] for out in evaluate_all(blocks, groups, [x[..., None] for x in w], corners))
        memory = [[Memory() for _ in range(x.shape[1])] for x in w]
        open_ = [np.ones(x.shape[1], bool) for x in w]
        for _ in range(steps):
            d = [np.column_stack([m.direction(g[k][:, j]) for j, m in enumerate(memory[k])]) for k in range(len(w))]
            tried = [x[..., None] + d[k][..., None] * TRIES for k, x in enumerate(w)]
            values, gradients = evaluate_all(blocks, groups, tried, corners)
            for k in range(len(w)):
                slope = (d[k] * g[k]).sum(axis=0)
                for j in np.flatnonzero(open_[k]):
                    good = values[k][j] <= f[k][j] + 1e-4 * TRIES * slope[j]
                    at = int(np.argmin(np.where(good, values[k][j], np.inf)))
                    if not good[at]:
                        # no step is short enough: once more along the gradient, then this fit is done
                        open_[k][j] = bool(memory[k][j].pairs)
                        memory[k][j].pairs = []
                        continue
                    new, slope_now = tried[k][:, j, at], gradients[k][:, j, at]
                    memory[k][j].add(new - w[k][:, j], slope_now - g[k][:, j])
                    open_[k][j] = f[k][j] - values[k][j, at] > tolerance * max(1.0, abs(f[k][j]))
                    w[k][:, j], f[k][j], g[k][:, j] = new, values[k][j, at], slope_now
            if not any(x.any() for x in open_):
                break
    return w


def landmarks(blocks: Packed, n_features: int, before: float, rows: int = LANDMARKS, seed: int = 42) -> np.ndarray:
    """A bounded sample of the rows before a time, by a seeded hash of their bytes, so that it doesn't depend on how rows are dealt."""

    arrays, salt = blocks.arrays(), seed.to_bytes(8, "little")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: list[tuple[int, bytes]] = []
        for b in batches:
            for k in range(b.num_rows):
                x, _, t = arrays(b.slice(k, 1).to_pylist()[0])
                raw = [r.tobytes() for r in x[t < before]]
                best = sorted({*best, *((int.from_bytes(blake2b(r, digest_size=7, salt=salt).digest(), "little"), r) for r in raw)})[:rows]
        yield pa.RecordBatch.from_arrays([pa.array([h for h, _ in best], pa.int64()), pa.array([r for _, r in best], pa.binary())], names=["h", "x"])

    found = blocks.blocks.mapInArrow(work, "h bigint, x binary").distinct().orderBy("h", "x").limit(rows).collect()
    return np.array([np.frombuffer(r["x"]) for r in found]).reshape(-1, n_features)


def groups_of(blocks: Packed, n_features: int, points: Sequence[Point], cuts: Sequence[tuple[float, float]]) -> tuple[list[Group], list[float], list[float], list[list[int]]]:
    """A group for each cut (training before the first number, validation from there up to the second) and map, and the points of each."""
    facts = scalers(blocks, n_features, [b for b, _ in cuts])
    keys = list(dict.fromkeys(p.map_key for p in points))
    wants = any(k[0] == "sigmoid" or (k[0] == "poly" and math.comb(n_features + k[2] - 1, k[2]) > MONOMIALS) for k in keys)
    groups, starts, spreads, members = [], [], [], []
    for (before, until), (n, scaler, mean, spread) in zip(cuts, facts, strict=True):
        if not n:
            raise ValueError("a fold has no rows to train on")
        marks = scaler(landmarks(blocks, n_features, before)) if wants else np.zeros((0, n_features))
        for key in keys:
            own = [k for k, p in enumerate(points) if p.map_key == key]
            groups.append(Group(before, until, scaler, Map(key[0], key[1], key[2], n_features, marks), np.array([points[k].c for k in own]), np.array([points[k].epsilon for k in own])))
            starts.append(mean)
            spreads.append(spread)
            members.append(own)
    return groups, starts, spreads, members


class SvrModel:
    """Adds `prediction`. Rows with a null feature get null."""

    def __init__(self, features: Sequence[str], point: Point, group: Group, weights: np.ndarray):
        self.features, self.point, self.group, self.weights = list(features), point, group, weights

    def predict(self, x: np.ndarray) -> np.ndarray:
        return self.group.map(self.group.scaler(x)) @ self.weights[:-1] + self.weights[-1]

    def transform(self, frame: DataFrame) -> DataFrame:
        model, p = self, len(self.features)

        @F.pandas_udf("double")
        def told(rows: pd.Series) -> pd.Series:
            x = np.array([np.asarray(r, float) if r is not None else np.full(p, np.nan) for r in rows]).reshape(len(rows), p)
            out, whole = np.full(len(x), np.nan), ~np.isnan(x).any(axis=1)
            out[whole] = model.predict(x[whole])
            return pd.Series(out)

        value = told(F.array(*(F.col(f"`{f}`").cast("double") for f in self.features)))
        return frame.withColumn("prediction", F.nanvl(value, F.lit(None).cast("double")))


class Svr:
    """A regressor for one point; `fit` and `transform` as Spark ML's."""

    def __init__(self, features: Sequence[str], target: str, point: Point | None = None, steps: int = STEPS):
        self.features, self.target, self.point, self.steps = list(features), target, point or Point(), steps

    def fit(self, frame: DataFrame) -> SvrModel:
        return fit_points(frame, self.features, self.target, [self.point], self.steps)[0]


def fit_points(frame: DataFrame, features: Sequence[str], target: str, points: Sequence[Point], steps: int = STEPS) -> list[SvrModel]:
    """A model for each point, all fitted in lockstep over all rows with a target."""
    blocks = pack(frame, [F.col(f"`{f}`") for f in features], F.col(f"`{target}`"))
    groups, starts, spreads, members = groups_of(blocks, len(features), points, [(math.inf, math.inf)])
    out: list[SvrModel | None] = [None] * len(points)
    for g, w, own in zip(groups, solve(blocks, groups, starts, spreads, steps), members, strict=True):
        for j, k in enumerate(own):
            out[k] = SvrModel(features, points[k], g, w[:, j])
    return out


def search(frame: DataFrame, features: Sequence[str], target: str, points: Sequence[Point], folds: int = 5, period: Sequence[str] = PERIOD, steps: int = STEPS) -> list[tuple[Point, float]]:
    """(point, mean MAE over chronological folds), best first; of equals the first given stays first. All points of one map, and all folds, are fitted at once.

    Fold k trains on the periods before its first.
    """
    rows = with_fold(frame.where(F.col(f"`{target}`").isNotNull()), folds, period)
    blocks = pack(rows, [F.col(f"`{f}`") for f in features], F.col(f"`{target}`"), F.col("_fold"))
    scores = [0.0] * len(points)
    for key in dict.fromkeys(p.map_key for p in points):
        some = [k for k, p in enumerate(points) if p.map_key == key]
        cuts = [(float(k), float(k + 1)) for k in range(1, folds + 1)]
        groups, starts, spreads, _ = groups_of(blocks, len(features), [points[k] for k in some], cuts)
        weights = solve(blocks, groups, starts, spreads, steps)

        def errors(x, y, t, groups=groups, weights=weights):
            out = []
            for g, w in zip(groups, weights, strict=True):
                held = (t >= g.before) & (t < g.until)
                z = g.map(g.scaler(x[held]))
                out += [np.abs(y[held, None] - z @ w[:-1] - w[-1]).sum(axis=0), [held.sum()]]
            return np.concatenate(out)

        flat = summed(blocks, errors, folds * (len(some) + 1)).reshape(folds, len(some) + 1)
        for k, mae in zip(some, (flat[:, :-1] / flat[:, -1:]).mean(axis=0), strict=True):
            scores[k] = float(mae)
    order = sorted(range(len(points)), key=lambda k: scores[k])
    return [(points[k], scores[k]) for k in order]
