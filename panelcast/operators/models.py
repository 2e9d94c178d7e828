"""Regressors as Spark ML pipelines: robust linear, boosted trees, additive by bins; grids over chronological folds."""

from __future__ import annotations

from collections.abc import Sequence
from concurrent.futures import ThreadPoolExecutor
from itertools import combinations
from queue import Queue

from pyspark import inheritable_thread_target
from pyspark.ml import Model, Pipeline
from pyspark.ml.feature import Bucketizer, OneHotEncoder, SQLTransformer, StandardScaler, VectorAssembler
from pyspark.ml.regression import GBTRegressor, LinearRegression
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import staged
from . import ranks
from .evaluate import metrics, with_fold
from .panel import PERIOD

#: Bins of each feature of the additive model.
BINS = 8


def matrix(features: Sequence[str]) -> VectorAssembler:
    return VectorAssembler(inputCols=list(features), outputCol="_vector")


def robust_linear(features: Sequence[str], target: str, regularisation: float = 0.01, epsilon: float = 1.35) -> Pipeline:
    """Standardised features and a linear model with Huber loss. The role of a linear support-vector regressor, with another robust loss."""
    scale = StandardScaler(inputCol="_vector", outputCol="_scaled", withMean=True, withStd=True)
    fit = LinearRegression(featuresCol="_scaled", labelCol=target, loss="huber", epsilon=epsilon, regParam=regularisation, maxIter=50)
    return Pipeline(stages=[matrix(features), scale, fit])


def boosted_trees(features: Sequence[str], target: str, rounds: int = 15, depth: int = 4, seed: int = 42) -> Pipeline:
    """A non-linear regressor, in the place of a neural network."""
    return Pipeline(stages=[matrix(features), GBTRegressor(featuresCol="_vector", labelCol=target, maxIter=rounds, maxDepth=depth, seed=seed)])


def bin_edges(frame: DataFrame, features: Sequence[str], bins: int = BINS) -> dict[str, list[float]]:
    """Inner quantiles of each feature, exact and each once."""
    return {f: sorted(set(found[1:-1])) or [0.0] for f, found in ranks.quantiles(frame, features, bins).items()}


class Additive:
    """A sum of one step function a feature, and of one for each of `pairs` pairs of features ("a & b"): features are binned, each bin is a 0-1 column, and a
    ridge regression weighs them. Pairs are those whose cells explain most of what a first fit without pairs leaves over.
    """

    def __init__(self, features: Sequence[str], target: str, ridge: float = 0.1, bins: int = BINS, pairs: int = 0):
        self.features, self.target, self.ridge, self.bins, self.pairs = list(features), target, ridge, bins, pairs

    def _fit(self, frame: DataFrame, edges: dict[str, list[float]], pairs: Sequence[tuple[str, str]]) -> AdditiveModel:
        terms = [*self.features, *(f"{a} & {b}" for a, b in pairs)]
        stages = [Bucketizer(splits=[-float("inf"), *edges[f], float("inf")], inputCol=f, outputCol=f"_bin_{f}", handleInvalid="keep") for f in self.features]
        if pairs:
            cells = ", ".join(f"`_bin_{a}` * {self.bins + 2} + `_bin_{b}` AS `_bin_{a} & {b}`" for a, b in pairs)
            stages.append(SQLTransformer(statement=f"SELECT *, {cells} FROM __THIS__"))
        stages += [OneHotEncoder(inputCol=f"_bin_{t}", outputCol=f"_hot_{t}", dropLast=False, handleInvalid="keep") for t in terms]
        stages += [VectorAssembler(inputCols=[f"_hot_{t}" for t in terms], outputCol="_hot"), LinearRegression(featuresCol="_hot", labelCol=self.target, regParam=self.ridge, elasticNetParam=0.0, maxIter=50)]
        return AdditiveModel(terms, Pipeline(stages=stages).fit(frame))

    def _best_pairs(self, main: AdditiveModel, frame: DataFrame) -> list[tuple[str, str]]:
        """Sums of the residuals in the cells of all pairs, in one aggregate; no more rows than asked for come back."""
        every = list(combinations(self.features, 2))
        cells = F.array(*(F.struct(F.lit(k).alias("k"), F.col(f"`_bin_{a}`").alias("a"), F.col(f"`_bin_{b}`").alias("b")) for k, (a, b) in enumerate(every)))
        rows = main.transform(frame).select((F.col(self.target) - F.col("prediction")).alias("_e"), F.explode(cells).alias("_x")).select("_e", "_x.*")
        sums = rows.groupBy("k", "a", "b").agg(F.sum("_e").alias("_s"), F.count("_e").alias("_n"))
        gains = sums.groupBy("k").agg(F.sum(F.try_divide(F.col("_s") * F.col("_s"), "_n")).alias("gain"))
        return [every[r["k"]] for r in gains.orderBy(F.desc("gain"), "k").limit(self.pairs).collect()]

    def fit(self, frame: DataFrame) -> AdditiveModel:
        edges = bin_edges(frame, self.features, self.bins)
        main = self._fit(frame, edges, [])
        return main if self.pairs < 1 or len(self.features) < 2 else self._fit(frame, edges, self._best_pairs(main, frame))


class AdditiveModel:
    """terms: the features, then the pairs. `_bin_<term>` is a row's bin; a pair's is a cell of its features' bins."""

    def __init__(self, terms: list[str], pipeline: Model):
        self.terms, self.pipeline = terms, pipeline

    def transform(self, frame: DataFrame) -> DataFrame:
        return self.pipeline.transform(frame)

    def coefficients(self, frame: DataFrame) -> list[tuple[str, int, float]]:
        """(term, bin, weight), in number the bins of all terms."""
        line, out, at = self.pipeline.stages[-1], [], 0
        for t, encoder in zip(self.terms, self.pipeline.stages[-2 - len(self.terms) : -2], strict=True):
            size = encoder.categorySizes[0] + 1  # and one for values unseen
            out += [(t, b, float(line.coefficients[at + b])) for b in range(size)]
            at += size
        return out

    @property
    def intercept(self) -> float:
        return float(self.pipeline.stages[-1].intercept)


def grid_select(frame: DataFrame, candidates: Sequence[tuple[str, Pipeline]], target: str, folds: int = 3, period: Sequence[str] = PERIOD, side_by_side: int = 4) -> list[tuple[str, float]]:
    """(name, mean MAE over chronological folds) of each candidate, best first; of equals the first given stays first.

    Rows are staged once with their fold, and fits go `side_by_side` from a pool of threads, each in a scheduler pool of its own (which counts where the session's
    scheduler is fair), so that small fits don't wait for one another; every fit and every metric is a Spark job over all rows of its fold.
    """
    spark = frame.sparkSession
    rows = staged(with_fold(frame, folds, period), "folds")
    turns: Queue[str] = Queue()
    for k in range(side_by_side):
        turns.put(f"fit-{k}")

    def error(pipeline: Pipeline, fold: int) -> float:
        pool = turns.get()
        spark.sparkContext.setLocalProperty("spark.scheduler.pool", pool)
        try:
            fitted = pipeline.fit(rows.where(F.col("_fold") < fold).drop("_fold"))
            held = fitted.transform(rows.where(F.col("_fold") == fold).drop("_fold"))
            return metrics(held, F.col(target), F.col("prediction")).select("mae").first()["mae"]
        finally:
            spark.sparkContext.setLocalProperty("spark.scheduler.pool", None)
            turns.put(pool)

    with ThreadPoolExecutor(side_by_side) as pool:
        jobs = [[pool.submit(inheritable_thread_target(spark)(error), p, k) for k in range(1, folds + 1)] for _, p in candidates]
        scores = [(name, sum(j.result() for j in own) / folds) for (name, _), own in zip(candidates, jobs, strict=True)]
    return sorted(scores, key=lambda s: s[1])


def project(pipeline, train: DataFrame, forecast: DataFrame, target: str) -> DataFrame:
    """Fits on rows with a target and predicts the frozen forecast."""
    return pipeline.fit(train.where(F.col(target).isNotNull())).transform(forecast)
