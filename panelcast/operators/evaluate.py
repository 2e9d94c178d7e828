"""Errors of forecasts: metrics, cohorts, histograms, chronological splits, intervals."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import staged
from . import ranks
from .panel import PERIOD


def metrics(frame: DataFrame, actual: Column, prediction: Column) -> DataFrame:
    """One row: n, MAE, RMSE, and the mean relative error over actual values other than 0. Reading it fails without any sample, and if all actual values are 0."""
    e = actual - prediction
    one = frame.where(actual.isNotNull() & prediction.isNotNull()).agg(
        F.count(F.lit(1)).alias("n"), F.avg(F.abs(e)).alias("mae"), F.sqrt(F.avg(e * e)).alias("rmse"), F.avg(F.when(actual != 0, F.abs(e) / F.abs(actual))).alias("relative_error"))
    wrong = F.when(F.col("n") == 0, F.lit("metrics need at least one sample")).otherwise(F.lit("the relative error needs an actual value other than 0"))
    return one.withColumn("relative_error", F.when(F.col("relative_error").isNull(), F.raise_error(wrong).cast("double")).otherwise(F.col("relative_error")))


def _cohort(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    return rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.avg("_e").alias("bias"), F.avg(F.abs("_e")).alias("mae"), F.sqrt(F.avg(F.col("_e") * F.col("_e"))).alias("rmse"))


def residuals_by_category(frame: DataFrame, actual: Column, prediction: Column, columns: Sequence[str]) -> DataFrame:
    """Cohorts of every value of several columns, in one aggregate. Bias is actual - prediction."""
    rows = frame.where(actual.isNotNull() & prediction.isNotNull()).select((actual - prediction).alias("_e"), *(F.col(c).cast("string").alias(c) for c in columns))
    return _cohort(rows.unpivot(["_e"], list(columns), "column", "value"), ["column", "value"])


def residuals_by_quantile(frame: DataFrame, actual: Column, prediction: Column, columns: Sequence[str], bins: int = 4) -> DataFrame:
    """Cohorts between a column's exact quantiles; equal edges are one. A column of one value has the one bin 1.

    Rows are summed up by value once; the edges come from the running count of the values, interpolated between the two values around
    a place, and each value finds its bin by counting the inner edges not above it.
    """
    if bins < 2:
        raise ValueError("bins must be 2 or more")
    rows = frame.where(actual.isNotNull() & prediction.isNotNull()).select((actual - prediction).alias("_e"), *(F.col(c).cast("double").alias(c) for c in columns))
    long = rows.unpivot(["_e"], list(columns), "column", "_v").where(F.col("_v").isNotNull())
    sums = staged(long.groupBy("column", "_v").agg(F.count(F.lit(1)).alias("c"), F.sum("_e").alias("_s"), F.sum(F.abs("_e")).alias("_a"), F.sum(F.col("_e") * F.col("_e")).alias("_q")), "quantiles")
    place = [(F.col("_total") - 1) * (i / bins) for i in range(bins + 1)]
    holder = lambda k: F.min(F.when(F.col("_upto") > k, F.col("_v")))
    around = ranks.running(sums, ["column"], "_v").groupBy("column", "_total").agg(*(holder(end(k)).alias(f"_{side}{i}") for i, k in enumerate(place) for side, end in (("lo", F.floor), ("hi", F.ceil))))
    between = lambda i, k: F.when(F.col(f"_lo{i}") == F.col(f"_hi{i}"), F.col(f"_lo{i}")).otherwise((F.ceil(k) - k) * F.col(f"_lo{i}") + (k - F.floor(k)) * F.col(f"_hi{i}"))
    edges = around.select("column", F.array_distinct(F.array(*(between(i, k) for i, k in enumerate(place)))).alias("_edges"))
    binned = sums.join(F.broadcast(edges), "column")
    inner = F.slice("_edges", 2, F.greatest(F.size("_edges") - 2, F.lit(0)))
    binned = binned.withColumn("bin", (1 + F.size(F.filter(inner, lambda e: e <= F.col("_v")))).cast("bigint"))
    bound = lambda k: F.get("_edges", F.least(k, F.size("_edges") - 1))
    binned = binned.withColumns({"lower": bound(F.col("bin").cast("int") - 1), "upper": bound(F.col("bin").cast("int"))})
    mean = lambda c: F.sum(c) / F.sum("c")
    return binned.groupBy("column", "bin", "lower", "upper").agg(F.sum("c").alias("n"), mean("_s").alias("bias"), mean("_a").alias("mae"), F.sqrt(mean("_q")).alias("rmse"))


def error_histogram(frame: DataFrame, actual: Column, prediction: Column, bins: int = 34, width: float = 1.0) -> DataFrame:
    """Counts of absolute errors in unit bins; the last bin holds its upper edge, too, and larger errors are left out."""
    e = F.abs(actual - prediction) / width
    return frame.where(e <= bins).groupBy(F.least(F.floor(e), F.lit(bins - 1)).cast("bigint").alias("bin")).agg(F.count(F.lit(1)).alias("n"))


def _periods(frame: DataFrame, period: Sequence[str]) -> DataFrame:
    return frame.select(*period).distinct()


def chronological_folds(frame: DataFrame, folds: int, period: Sequence[str] = PERIOD) -> DataFrame:
    """period, fold: whole periods in order, the first of all left out for training. Fold k trains on the periods before its first.

    The window is over distinct periods, of which there are few.
    """
    if folds < 2:
        raise ValueError("folds must be 2 or more")
    w = Window.orderBy(*period)
    numbered = _periods(frame, period).withColumn("_k", F.row_number().over(w)).where("_k > 1").drop("_k")
    return numbered.withColumn("fold", F.ntile(folds).over(w).cast("bigint"))


def fold_rows(frame: DataFrame, folds: DataFrame, fold: int, period: Sequence[str] = PERIOD) -> tuple[DataFrame, DataFrame]:
    """Training and test rows of a fold."""
    own = folds.where(F.col("fold") == fold)
    first = own.agg(F.min(F.struct(*period)).alias("_first"))
    train = frame.join(F.broadcast(first), F.struct(*(F.col(p) for p in period)) < F.col("_first")).drop("_first")
    return train, frame.join(F.broadcast(own.select(*period)), list(period), "left_semi")


def fold_starts(frame: DataFrame, folds: int, period: Sequence[str] = PERIOD) -> list[tuple]:
    """The first period of each fold: a row a fold comes to the driver."""
    parts = chronological_folds(frame, folds, period)
    lows = [tuple(r["low"]) for r in parts.groupBy("fold").agg(F.min(F.struct(*period)).alias("low")).orderBy("fold").collect()]
    if len(lows) < folds:
        raise ValueError(f"{folds} folds need {folds + 1} periods")
    return lows


def with_fold(frame: DataFrame, folds: int, period: Sequence[str] = PERIOD, name: str = "_fold") -> DataFrame:
    """Adds the fold of a row's period; 0 before the first. Fold k is tested on its own rows and trained on those with a smaller number."""
    kinds = {f.name: f.dataType for f in frame.schema}
    own = F.struct(*(F.col(p) for p in period))
    low = lambda at: F.struct(*(F.lit(v).cast(kinds[p]).alias(p) for p, v in zip(period, at, strict=True)))
    return frame.withColumn(name, sum((F.when(own >= low(at), 1).otherwise(0) for at in fold_starts(frame, folds, period)), F.lit(0)))


def calibration_periods(frame: DataFrame, fraction: float, period: Sequence[str] = PERIOD) -> DataFrame:
    """period, calibration: true for the latest periods, at least one and never all."""
    if not 0 < fraction < 1:
        raise ValueError("fraction must be between 0 and 1")
    p = _periods(frame, period)
    n = F.broadcast(p.agg(F.count(F.lit(1)).alias("_n")))
    held = F.least(F.col("_n") - 1, F.greatest(F.lit(1), F.ceil(F.col("_n") * fraction)))
    return p.withColumn("_k", F.row_number().over(Window.orderBy(*(F.desc(c) for c in period)))).crossJoin(n).select(*period, (F.col("_k") <= held).alias("calibration"))


def conformal_radius(frame: DataFrame, actual: Column, prediction: Column, coverage: float) -> DataFrame:
    """One row: the number of residuals and the one of rank ceil((n - 1) q), from 0, with q = min(1, ceil((n + 1) coverage) / n).

    Residuals are counted by value, once, and the rank is found in the running count of distinct values, spread over
    ranges of values, so that no task orders all residuals.
    """
    if not 0 < coverage < 1:
        raise ValueError("coverage must be between 0 and 1")
    told = frame.where(actual.isNotNull() & prediction.isNotNull()).select(F.lit(1).alias("_all"), F.abs(actual - prediction).alias("r"))
    counts = staged(told.groupBy("_all", "r").agg(F.count(F.lit(1)).alias("c")), "residuals")
    n = F.col("_total")
    q = F.least(F.lit(1.0), F.ceil((n + 1) * coverage) / n)
    return ranks.running(counts, ["_all"], "r").where(F.col("_upto") > F.ceil((n - 1) * q)).groupBy(n.alias("n")).agg(F.min("r").alias("radius"))


def with_interval(frame: DataFrame, radius: DataFrame, prediction: Column) -> DataFrame:
    """Adds prediction_lower, prediction_upper and n, the residuals that the radius rests on."""
    return frame.crossJoin(F.broadcast(radius.select("n", "radius"))).withColumns({"prediction_lower": prediction - F.col("radius"), "prediction_upper": prediction + F.col("radius")}).drop("radius")
