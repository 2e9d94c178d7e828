"""The model job: choose and fit on the training table, predict the test table, evaluate, and write predictions, metrics and diagnostics; by position from published datasets,
and for the frozen forecasts of an archive."""

from __future__ import annotations

from collections.abc import Sequence
from itertools import product

from pyspark.ml import Pipeline
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators import boards, boosted, evaluate, explain, models, svr
from ..operators.panel import PERIOD
from ..sources import io
from ..sources.document import schema_of, write_document
from ..sources.publish import Output, read_published
from . import datasets

TARGET = "fantasy_points"
TARGET_PERIOD = ("target_season", "target_week")
#: Places of the hand-picked features among the quarterbacks' model features.
MANUAL_PLACES = (0, 1, 2, 3, 4, 5, 8, 9, 10, 13, 14, 15, 16, 17, 20, 21, 22, 25, 26, 27, 28, 29, 30, 31, 32, 33)
#: The quarterbacks of the 2014 cohort.
COHORT_2014 = (
    "00-0029263", "00-0023459", "00-0026143", "00-0020531", "00-0026158", "00-0027973", "00-0024226", "00-0023436",
    "00-0029701", "00-0019596", "00-0031280", "00-0022924", "00-0026625", "00-0021678", "00-0027974", "00-0010346",
    "00-0029668", "00-0026498", "00-0022803", "00-0022942", "00-0027939", "00-0031237", "00-0031407", "00-0023541",
)
#: The dataset of each position that can be asked for.
POSITIONS = {"qb": "qb", "dst": "dst", "k": "kicker", "rb": "receiving", "wr": "receiving", "te": "receiving", "idp": "idp"}
#: Columns of a forecast that go with its predictions, where it has them.
CONTEXT = ("injury_status", "injury_missed_game", *boards.OPPORTUNITY)


def manual_features(features: Sequence[str]) -> list[str]:
    """The hand-picked subset of a list of model features, in its order."""
    if len(features) <= MANUAL_PLACES[-1]:
        raise ValueError(f"needs {MANUAL_PLACES[-1] + 1} features, not {len(features)}")
    return [features[k] for k in MANUAL_PLACES]


def search_space() -> list[dict]:
    """The 260 points of the search: penalty, tube and kernel, with a width for all kernels but the linear one and a degree for polynomials."""
    widths = {"linear": [{}], "poly": [{"gamma": g, "degree": d} for g in (0.05, 0.1, 0.15) for d in (2, 3)]}
    other = [{"gamma": g} for g in (0.05, 0.1, 0.15)]
    points = product((0.25, 0.5, 0.75, 1.0), (0.05, 0.1, 0.15, 0.2, 0.25), ("rbf", "linear", "sigmoid", "poly"))
    return [{"c": c, "epsilon": e, "kernel": k} | more for c, e, k in points for more in widths.get(k, other)]


def cohort(frame: DataFrame, players: Sequence[str] = COHORT_2014) -> DataFrame:
    """The rows of named players."""
    return frame.where(F.col("player_id").isin(list(players)))


def search_points() -> list[svr.Point]:
    return [svr.Point(**p) for p in search_space()]


def identity_of(output: Output) -> list[str]:
    """The columns of a table before its lineage: who, and which game."""
    names = output.schema.names
    return [c for c in names[: next(k for k, c in enumerate(names) if c.endswith("_through_season") and c != "history_through_season")] if c not in CONTEXT]


def features_of(output: Output) -> list[str]:
    """A table's model features: its numbers but the target and the projections."""
    return [f.name for f in output.schema if isinstance(f.dataType, T.DoubleType) and f.name != TARGET and not f.name.startswith("projected_")]


def diagnostics(model, train: DataFrame, predicted: DataFrame, features: Sequence[str], target: str, identity: Sequence[str], categories: Sequence[str] = ("position", "position_group", "target_week"), numbers: Sequence[str] | None = None, period: Sequence[str] = PERIOD, background: int = 100, samples: int = 25, repeats: int = 5, bins: int = 10) -> dict[str, DataFrame]:
    """The bundle by name: metrics, residual cohorts (of the columns that there are; numbers are, where none are named, years_pro and the points that opponents
    allowed), errors, accumulated effects, permutation importance within seasons, Shapley values of a bounded sample with the identities of its rows, and of an additive model its terms."""
    actual, prediction = F.col(target), F.col("prediction")
    plain = predicted.select(*(F.col(f"`{c}`") for c in train.columns if c in predicted.columns))  # without what the model's stages added
    bundle = {
        "metrics": evaluate.metrics(predicted, actual, prediction), "errors": evaluate.error_histogram(predicted, actual, prediction), "effects": explain.accumulated_effects(model, train, features, bins),
        "importance": explain.permutation_importance(model, plain, features, target, repeats, season=(period[0],)),
        "shapley": explain.shapley_values(model, explain.bounded_sample(plain, samples), explain.bounded_sample(train, background), features, identity),
    }
    strength = [f for f in features if f.endswith("defense_last_10_points_allowed")]
    have = [c for c in categories if c in predicted.columns]
    spread = [c for c in (["years_pro", *strength] if numbers is None else numbers) if c in predicted.columns]
    if have:
        bundle["cohorts"] = evaluate.residuals_by_category(predicted, actual, prediction, have)
    if spread:
        bundle["quantiles"] = evaluate.residuals_by_quantile(predicted, actual, prediction, spread)
    if hasattr(model, "terms"):
        bundle["terms"] = explain.additive_terms(model, train)
    return bundle


def train_predict_evaluate(train: DataFrame, test: DataFrame, candidates: Sequence[tuple[str, Pipeline]], features: Sequence[str], target: str, identity: Sequence[str], path: str, folds: int = 3, coverage: float = 0.9, calibration: float | None = 0.2, period: Sequence[str] = PERIOD, **bundle) -> dict:
    """Picks the candidate with the least error over chronological folds and predicts the test table with it. With `calibration` (a share of the periods) the model is fitted before the
    last periods of the training table, and their residuals give the radius of its interval: the model that predicts is the one whose errors were taken. Without, it is fitted on
    all rows and has no interval. Writes `predictions` (Parquet), the bundle with the interval as one document `diagnostics`, and an additive model's terms of every
    test row as `local_terms` under `path`; returns the choice, its scores and the schema of the document."""
    told = train.where(F.col(target).isNotNull())
    scores = models.grid_select(told, candidates, target, folds, period) if len(candidates) > 1 else [(candidates[0][0], None)]
    estimator = dict(candidates)[scores[0][0]]
    parts: dict[str, DataFrame] = {}
    if calibration is None:
        model = estimator.fit(told)
        predicted = model.transform(test)
        shown = predicted
    else:
        marked = told.join(F.broadcast(evaluate.calibration_periods(told, calibration, period)), list(period))
        told = marked.where("not calibration").drop("calibration")
        model = estimator.fit(told)
        held = model.transform(marked.where("calibration").drop("calibration"))
        radius = evaluate.conformal_radius(held, F.col(target), F.col("prediction"), coverage)
        parts["interval"] = radius.select(F.lit(coverage).alias("coverage"), "radius", F.col("n").alias("calibration_samples"))
        predicted = model.transform(test)
        shown = evaluate.with_interval(predicted, radius, F.col("prediction"))
    io.write_dataset(io.prediction_columns(shown, [*identity, target], CONTEXT), f"{path}/predictions")
    scored = predicted.where(F.col(target).isNotNull())
    parts |= diagnostics(model, told, scored, features, target, identity, period=period, **bundle)
    write_document(parts, f"{path}/diagnostics")
    if hasattr(model, "terms"):
        io.write_diagnostics(explain.local_terms(model, scored, identity), f"{path}/local_terms")
    return {"model": scores[0][0], "scores": scores, "schema": schema_of(parts)}


def estimators(kind: str, features: Sequence[str], **settings) -> object:
    """A model by name: "svr" (c, epsilon, kernel, gamma, degree), "additive" (bins, rounds, bags, pairs) or "trees" (rounds, depth)."""
    if kind == "svr":
        return svr.Svr(features, TARGET, svr.Point(**settings))
    if kind == "additive":
        return boosted.Boosted(features, TARGET, **({"pairs": 10} | settings))
    if kind == "trees":
        return models.boosted_trees(features, TARGET, **settings)
    raise ValueError(f"no model {kind}")


def train_position(spark: SparkSession, folder: str, position: str, path: str, kind: str = "svr", select: bool = False, manual: bool = False, folds: int = 5, settings: dict | None = None, **how) -> dict:
    """A position's model from its published `train` and `test` (datasets.build), read under their contract. `select`: the point of the whole search space with the least error (svr);
    `manual`: the hand-picked features, of quarterbacks alone. An additive model holds back periods for its interval; others are fitted on all rows."""
    if manual and position != "qb":
        raise ValueError("hand-picked features are of quarterbacks")
    output = datasets.OUTPUTS[POSITIONS[position]]
    train, test = (read_published(spark, folder, name, output) for name in ("train", "test"))
    features = manual_features(features_of(output)) if manual else features_of(output)
    settings = settings or {}
    if select:
        if kind != "svr":
            raise ValueError("the search is for svr")
        best = svr.search(train, features, TARGET, search_points(), folds, TARGET_PERIOD)[0][0]
        settings = {"c": best.c, "epsilon": best.epsilon, "kernel": best.kernel, "gamma": best.gamma, "degree": best.degree}
    how = {"calibration": 0.2 if kind == "additive" else None} | how
    told = train_predict_evaluate(train, test, [(kind, estimators(kind, features, **settings))], features, TARGET, identity_of(output), path, period=TARGET_PERIOD, **how)
    return told | {"features": features, "settings": settings}


def project_forecast(spark: SparkSession, folder: str, path: str, kind: str = "svr", **settings) -> dict:
    """Predictions of a published forecast (datasets.build_forecast, or a season of build_archive) by a model of its training rows, with the context that boards read. Gives the metrics
    of the rows that have an outcome (none: null), the features, the last season of history and the target season. Of an archive the svr is a linear one."""
    frozen = datasets.kind_of(spark.read.parquet(f"{folder}/forecast").columns, outcomes=False)
    training = datasets.ARCHIVE_TRAINING if frozen is datasets.ARCHIVE_FORECAST else datasets.OUTPUTS["qb"]
    train, forecast = read_published(spark, folder, "training", training), read_published(spark, folder, "forecast", frozen)
    features = features_of(training)
    predicted = models.project(estimators(kind, features, **settings), train, forecast, TARGET)
    io.write_dataset(io.prediction_columns(predicted, [*identity_of(frozen), TARGET], CONTEXT), f"{path}/predictions")
    back = spark.read.parquet(f"{path}/predictions")
    scored = back.where(F.col(TARGET).isNotNull())
    one = back.agg(F.count(F.lit(1)).alias("n"), F.max("history_through_season").alias("through"), F.max("target_season").alias("season")).first()
    found = None if scored.isEmpty() else evaluate.metrics(scored, F.col(TARGET), F.col("prediction")).first().asDict()
    return {"metrics": found, "features": features, "forecast_rows": one["n"], "history_through_season": one["through"], "target_year": one["season"]}
