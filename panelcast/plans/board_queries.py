"""Queries of boards and evaluation on two models without training."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import boards, evaluate
from .views import CONSENSUS, FT, M, P, m, p, query, r6


def r4(c: str) -> Column:
    return F.round(F.col(c) + 1.3e-7, 4).alias(c)


@query(f"""WITH {M} SELECT player_id, player_name, position, team, target_season, target_week, model, prediction, actual, missed, round(error + 1.3e-7, 6) AS error, round(absolute_error + 1.3e-7, 6) AS absolute_error FROM M""")
def prepare_predictions(spark: SparkSession, d: str) -> DataFrame:
    shown = ("player_id", "player_name", "position", "team", "target_season", "target_week", "model", "prediction", "actual", "missed")
    return m(spark, d).select(*shown, r6(F.col("error")).alias("error"), r6(F.col("absolute_error")).alias("absolute_error"))


@query(f"""WITH {M} SELECT player_id, target_week, model, prediction, actual, missed, CASE WHEN missed THEN 'Out' END AS status, upper(position) AS position, 'N/A' AS opponent, round(error + 1.3e-7, 6) AS error FROM M WHERE target_season = 1997""")
def prepare_prediction_files(spark: SparkSession, d: str) -> DataFrame:
    """Predictions as forecasts and jobs write them, with their names of outcomes and absences."""
    names = {"actual": "fantasy_points", "missed": "injury_missed_game"}
    files = m(spark, d).where("target_season = 1997").withColumnsRenamed(names).withColumn("injury_status", F.when(F.col("injury_missed_game"), "Out"))
    files = files.select("player_id", "player_name", F.lower("position").alias("position"), "target_season", "target_week", "model", "prediction", *names.values(), "injury_status")
    got = boards.prepare(files, results=True)
    return got.select("player_id", "target_week", "model", "prediction", "actual", "missed", "status", "position", "opponent", r6(F.col("error")).alias("error"))


@query(f"""WITH {CONSENSUS} SELECT player_id, target_season, target_week, round(prediction + 1.3e-7, 4) AS prediction, round(spread + 1.3e-7, 4) AS spread, models, actual, missed FROM C""")
def consensus(spark: SparkSession, d: str) -> DataFrame:
    return boards.consensus(m(spark, d)).select("player_id", "target_season", "target_week", r4("prediction"), r4("spread"), "models", "actual", "missed")


@query(f"WITH {M} SELECT DISTINCT model FROM M UNION ALL SELECT 'Consensus' FROM M HAVING count(DISTINCT model) > 1")
def model_choices(spark: SparkSession, d: str) -> DataFrame:
    return boards.model_choices(m(spark, d))


#: The panel's segments as positions, and columns of the panel as context.
_POSITIONS = {"AUTOMOBILE": "QB", "BUILDING": "RB", "FURNITURE": "WR", "HOUSEHOLD": "TE", "MACHINERY": "K"}
_CASE = "CASE position " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in _POSITIONS.items()) + " END"


def _season(spark: SparkSession, d: str) -> DataFrame:
    named = F.create_map(*(F.lit(x) for pair in _POSITIONS.items() for x in pair))
    rows = m(spark, d).withColumns({"position": named[F.col("position")], "projected_carry_share": F.col("target_week") / 12, "projected_target_share": F.col("target_week") / 40, "team_previous_season_offensive_plays": F.lit(50.0) + F.col("target_week")})
    return boards.draft_board(boards.choose_model(boards.prepare(rows), "A"), 1997)


_BOARD = f"""B0 AS (SELECT * REPLACE ({_CASE} AS position) FROM M WHERE model = 'A' AND target_season = 1997), ANYR AS (SELECT count(actual) > 0 AS a FROM B0),
B1 AS (SELECT player_id, player_name, position, team, sum(prediction) AS projected_points, avg(prediction) AS points_per_game, coalesce(stddev_samp(prediction), 0) AS volatility, count(*) AS projected_games,
         avg(target_week / 12) AS projected_carry_share, avg(target_week / 40) AS projected_target_share, avg(50 + target_week) AS team_previous_season_offensive_plays,
         count(actual) AS g, coalesce(sum(actual), 0) AS pts, count(*) FILTER (WHERE missed) AS ms FROM B0 GROUP BY ALL),
B2 AS (SELECT * EXCLUDE (g, pts, ms, a), CASE WHEN a THEN g END AS actual_games, CASE WHEN a AND (g > 0 OR ms > 0) THEN pts END AS actual_points, CASE WHEN a THEN ms END AS injury_games FROM B1, ANYR),
B3 AS (SELECT *, CASE WHEN actual_games > 0 THEN actual_points / actual_games END AS actual_points_per_game, actual_points - projected_points AS projection_delta FROM B2),
B4 AS (SELECT *, injury_games * points_per_game AS projected_pace_injury_points, injury_games * actual_points_per_game AS actual_pace_injury_points FROM B3),
B5 AS (SELECT *, actual_points + projected_pace_injury_points AS projected_pace_adjusted_actual, actual_points + actual_pace_injury_points AS actual_pace_adjusted_actual FROM B4),
BOARD AS (SELECT *, projected_pace_adjusted_actual - projected_points AS projected_pace_adjusted_delta, actual_pace_adjusted_actual - projected_points AS actual_pace_adjusted_delta,
  (projected_pace_adjusted_actual - projected_points) / nullif(projected_points, 0) * 100 AS projected_pace_adjusted_delta_percent, (actual_pace_adjusted_actual - projected_points) / nullif(projected_points, 0) * 100 AS actual_pace_adjusted_delta_percent,
  concat_ws('; ', CASE WHEN position = 'RB' AND projected_carry_share < 0.45 THEN 'RB committee' END, CASE WHEN position IN ('WR', 'TE') AND projected_target_share < 0.15 THEN 'Low target share' END,
    CASE WHEN position IN ('QB', 'RB', 'WR', 'TE') AND team_previous_season_offensive_plays < 58 THEN 'Low-volume offense' END) AS opportunity_risk,
  row_number() OVER (PARTITION BY position ORDER BY projected_points DESC, player_id) AS position_rank FROM B5)"""
_POINTS = (
    "projected_points", "points_per_game", "volatility", "projected_carry_share", "projected_target_share", "team_previous_season_offensive_plays", "actual_points", "actual_points_per_game", "projection_delta",
    "projected_pace_injury_points", "actual_pace_injury_points", "projected_pace_adjusted_actual", "actual_pace_adjusted_actual", "projected_pace_adjusted_delta", "actual_pace_adjusted_delta",
    "projected_pace_adjusted_delta_percent", "actual_pace_adjusted_delta_percent",
)
_SHOWN = ", ".join(f"round({c} + 1.3e-7, 4) AS {c}" for c in _POINTS)


@query(f"""WITH {M}, {_BOARD} SELECT player_id, player_name, position, team, {_SHOWN}, CAST(0 AS DOUBLE) AS model_spread, projected_games, actual_games, injury_games, 'Depth-chart estimate' AS opportunity_basis, opportunity_risk, position_rank FROM BOARD""")
def draft_board(spark: SparkSession, d: str) -> DataFrame:
    return _season(spark, d).select("player_id", "player_name", "position", "team", *map(r4, _POINTS), "model_spread", "projected_games", "actual_games", "injury_games", "opportunity_basis", "opportunity_risk", "position_rank")


@query(f"""WITH {CONSENSUS} SELECT player_id, position, round(prediction + 1.3e-7, 4) AS prediction, row_number() OVER (PARTITION BY position ORDER BY prediction DESC, player_id) AS position_rank,
CASE WHEN models <= 1 THEN 'Single model' WHEN spread <= 1.5 THEN 'Tight' WHEN spread <= 3 THEN 'Mixed' ELSE 'Wide' END AS agreement FROM C WHERE target_season = 1997 AND target_week = 6 AND position IN ('BUILDING', 'MACHINERY')""")
def weekly_board(spark: SparkSession, d: str) -> DataFrame:
    b = boards.weekly_board(boards.consensus(m(spark, d)), 1997, 6, ["BUILDING", "MACHINERY"])
    return b.select("player_id", "position", r4("prediction"), "position_rank", "agreement")


@query(f"""WITH {M}, {_BOARD} SELECT player_name AS player, round(projected_points + 1.3e-7, 4) AS points, round(projected_pace_adjusted_delta_percent + 1.3e-7, 2) AS gap_percent FROM BOARD WHERE contains(player_name, '7') ORDER BY projected_pace_adjusted_actual DESC NULLS LAST, player_id LIMIT 25""")
def top_players(spark: SparkSession, d: str) -> DataFrame:
    b = boards.top_players(_season(spark, d), "projected_pace_adjusted_actual", 25, "7")
    return b.select(F.col("player_name").alias("player"), F.round(F.col("projected_points") + 1.3e-7, 4).alias("points"), F.round(F.col("projected_pace_adjusted_delta_percent") + 1.3e-7, 2).alias("gap_percent"))


def named(labels) -> list[str]:
    """Labels as column names that SQL takes without quotes."""
    return [re.sub(r"_+", "_", re.sub(r"[^a-z]", "_", label.lower().replace("%", "percent"))).strip("_") for label in labels]


_CELLS = {"team_previous_season_pass_rate": "CAST(NULL AS DOUBLE)", "model_spread": "CAST(0 AS DOUBLE)", "opportunity_basis": "'Depth-chart estimate'"}


def _cell(v: str | tuple[str, float], label: str) -> str:
    name, times = (v, None) if isinstance(v, str) else v
    got = _CELLS.get(name, name) + (f" * {times}" if times else "")
    return f"{f'round({got} + 1.3e-7, 4)' if name in (*_POINTS, 'team_previous_season_pass_rate') else got} AS {label}"


_TABLE = ", ".join(_cell(v, n) for v, n in zip(boards.SEASON_TABLE.values(), named(boards.SEASON_TABLE), strict=True))


@query(f"WITH {M}, {_BOARD} SELECT {_TABLE} FROM BOARD")
def season_table(spark: SparkSession, d: str) -> DataFrame:
    """The whole table of a season's board, under its labels (as plain names here)."""
    shown = boards.display_table(_season(spark, d), boards.SEASON_TABLE).toDF(*named(boards.SEASON_TABLE))
    return shown.withColumns({n: F.round(F.col(n) + 1.3e-7, 4) for v, n in zip(boards.SEASON_TABLE.values(), shown.columns, strict=True) if (v if isinstance(v, str) else v[0]) in (*_POINTS, "team_previous_season_pass_rate")})


@query(f"""WITH {CONSENSUS}, W AS (SELECT *, row_number() OVER (PARTITION BY position ORDER BY prediction DESC, player_id) AS position_rank FROM C WHERE target_season = 1997 AND target_week = 6)
SELECT position_rank AS rank, upper(position) AS pos, player_name AS player, upper(team) AS team, 'N/A' AS opponent, round(prediction + 1.3e-7, 4) AS projected, round(spread + 1.3e-7, 4) AS model_spread,
CASE WHEN models <= 1 THEN 'Single model' WHEN spread <= 1.5 THEN 'Tight' WHEN spread <= 3 THEN 'Mixed' ELSE 'Wide' END AS agreement, actual FROM W""")
def week_table(spark: SparkSession, d: str) -> DataFrame:
    """The whole table of a week's board of the consensus."""
    shown = boards.display_table(boards.weekly_board(boards.consensus(m(spark, d)), 1997, 6), boards.WEEK_TABLE).toDF(*named(boards.WEEK_TABLE))
    return shown.withColumns({c: F.round(F.col(c) + 1.3e-7, 4) for c in ("projected", "model_spread")})


@query(f"""WITH {M}, H AS (SELECT * FROM M WHERE model = 'A')
SELECT player_id, target_season, target_week, 'prediction' AS series, prediction AS points FROM H UNION ALL SELECT player_id, target_season, target_week, 'actual', actual FROM H""")
def series_long(spark: SparkSession, d: str) -> DataFrame:
    return boards.long_series(m(spark, d).where("model = 'A'"), ["player_id", "target_season", "target_week"], ["prediction", "actual"])


@query(f"""WITH {M}, {_BOARD}, L AS (SELECT player_id, injury_games, unnest([{{'measure': 'Projected', 'base': projected_points, 'added': 0.0}}, {{'measure': 'Actual', 'base': actual_points, 'added': 0.0}},
  {{'measure': 'Adjusted at projected PPG', 'base': actual_points, 'added': projected_pace_injury_points}}, {{'measure': 'Adjusted at actual PPG', 'base': actual_points, 'added': actual_pace_injury_points}}]) AS s FROM BOARD)
SELECT player_id, s.measure AS measure, round(s.base + 1.3e-7, 4) AS base_points, round(s.added + 1.3e-7, 4) AS addition_points, round(s.base + s.added + 1.3e-7, 4) AS total_points FROM L
WHERE s.base + s.added IS NOT NULL AND (injury_games > 0 OR s.measure IN ('Projected', 'Actual'))""")
def measures_long(spark: SparkSession, d: str) -> DataFrame:
    return boards.measure_bars(_season(spark, d)).select("player_id", "measure", r4("base_points"), r4("addition_points"), r4("total_points"))


@query(f"""WITH {CONSENSUS}, E AS (SELECT model, error FROM M UNION ALL SELECT 'Consensus', prediction - actual FROM C)
SELECT model, count(*) AS samples, round(avg(abs(error)), 3) AS mae, round(sqrt(avg(error * error)), 3) AS rmse, round(avg(error), 3) AS bias FROM E WHERE error IS NOT NULL GROUP BY model""")
def scorecard(spark: SparkSession, d: str) -> DataFrame:
    return boards.scorecard(m(spark, d)).select("model", "samples", *(F.round(c, 3).alias(c) for c in ("mae", "rmse", "bias")))


@query(f"""WITH {FT} SELECT 2 * count(*) AS n_predictions, 2 * count(*) FILTER (WHERE status <> 'P') AS n_actual, max(h_through_season) AS history_through, max(season) AS target_season,
CASE WHEN count(*) FILTER (WHERE status <> 'P') > 0 THEN 'replay' ELSE 'upcoming' END AS state FROM FT""")
def forecast_state(spark: SparkSession, d: str) -> DataFrame:
    return boards.forecast_state(m(spark, d))


_E = "E AS (SELECT *, actual - prediction AS e FROM M WHERE model = 'A' AND actual IS NOT NULL)"


def told(spark: SparkSession, d: str) -> tuple[DataFrame, Column, Column]:
    return m(spark, d).where("model = 'A'"), F.col("actual"), F.col("prediction")


def r3(frame: DataFrame, keys: list[str]) -> DataFrame:
    return frame.select(*keys, "n", *(F.round(c, 3).alias(c) for c in ("bias", "mae", "rmse")))


@query(f"WITH {M}, {_E} SELECT count(*) AS n, round(avg(abs(e)), 3) AS mae, round(sqrt(avg(e * e)), 3) AS rmse, round(avg(abs(e) / abs(actual)) FILTER (WHERE actual <> 0), 6) AS relative_error FROM E")
def regression_metrics(spark: SparkSession, d: str) -> DataFrame:
    return evaluate.metrics(*told(spark, d)).select("n", F.round("mae", 3).alias("mae"), F.round("rmse", 3).alias("rmse"), F.round("relative_error", 6).alias("relative_error"))


@query(f"""WITH {M}, {_E}, L AS (SELECT 'position' AS "column", position AS value, e FROM E UNION ALL SELECT 'target_week', CAST(target_week AS VARCHAR), e FROM E)
SELECT "column", value, count(*) AS n, round(avg(e), 3) AS bias, round(avg(abs(e)), 3) AS mae, round(sqrt(avg(e * e)), 3) AS rmse FROM L GROUP BY ALL""")
def residual_by_category(spark: SparkSession, d: str) -> DataFrame:
    return r3(evaluate.residuals_by_category(*told(spark, d), ["position", "target_week"]), ["column", "value"])


@query(f"""WITH {M}, {_E}, L AS (SELECT 'prediction' AS "column", prediction AS v, e FROM E UNION ALL SELECT 'target_week', CAST(target_week AS DOUBLE), e FROM E),
Q AS (SELECT "column", list_sort(list_distinct(quantile_cont(v, [0, 0.25, 0.5, 0.75, 1]))) AS q FROM L GROUP BY 1),
B AS (SELECT L.*, q, 1 + len(list_filter(list_slice(q, 2, len(q) - 1), lambda x: x <= v)) AS bin FROM L JOIN Q USING ("column"))
SELECT "column", bin, round(q[bin], 4) AS lower, round(q[least(bin + 1, len(q))], 4) AS upper, count(*) AS n, round(avg(e), 3) AS bias, round(avg(abs(e)), 3) AS mae, round(sqrt(avg(e * e)), 3) AS rmse FROM B GROUP BY ALL""")
def residual_by_quantile(spark: SparkSession, d: str) -> DataFrame:
    out = evaluate.residuals_by_quantile(*told(spark, d), ["prediction", "target_week"])
    return r3(out.withColumns({"lower": F.round("lower", 4), "upper": F.round("upper", 4)}), ["column", "bin", "lower", "upper"])


@query(f"WITH {M}, {_E} SELECT CAST(least(floor(abs(e) / 10000), 33) AS BIGINT) AS bin, count(*) AS n FROM E WHERE abs(e) / 10000 <= 34 GROUP BY 1")
def error_histogram(spark: SparkSession, d: str) -> DataFrame:
    return evaluate.error_histogram(*told(spark, d), width=10000.0)


@query(f"""WITH {P}, T AS (SELECT DISTINCT season, week FROM P), N AS (SELECT *, row_number() OVER (ORDER BY season, week) AS k FROM T)
SELECT season, week, ntile(5) OVER (ORDER BY season, week) AS fold FROM N WHERE k > 1""")
def chronological_folds(spark: SparkSession, d: str) -> DataFrame:
    return evaluate.chronological_folds(p(spark, d), 5)


@query(f"""WITH {P}, T AS (SELECT DISTINCT season, week FROM P), N AS (SELECT *, row_number() OVER (ORDER BY season DESC, week DESC) AS k, count(*) OVER () AS n FROM T)
SELECT season, week, k <= least(n - 1, greatest(1, ceil(n * 0.2))) AS calibration FROM N""")
def calibration_split(spark: SparkSession, d: str) -> DataFrame:
    return evaluate.calibration_periods(p(spark, d), 0.2)


@query(f"WITH {P} SELECT seq, CASE WHEN season = 1997 THEN 'test' ELSE 'train' END AS part FROM P WHERE status <> 'P' AND score >= 1000 AND season >= 1993 AND season <= 1997")
def train_test_split(spark: SparkSession, d: str) -> DataFrame:
    rows = p(spark, d).where("status <> 'P' and score >= 1000")
    train = rows.where((F.col("season") >= 1993) & (F.col("season") < 1997)).select("seq", F.lit("train").alias("part"))
    return train.unionByName(rows.where("season = 1997").select("seq", F.lit("test").alias("part")))


@query(f"""WITH {M}, {_E}, S AS (SELECT round(abs(e), 6) AS r, row_number() OVER (ORDER BY abs(e)) - 1 AS k, count(*) OVER () AS n FROM E WHERE target_season < 1997),
I AS (SELECT n, r AS radius FROM S WHERE k = ceil((n - 1) * least(1.0::DOUBLE, ceil((n + 1) * 0.9::DOUBLE) / n)))
SELECT player_id, target_week, round(prediction - radius + 1.3e-7, 4) AS lower, round(prediction + radius + 1.3e-7, 4) AS upper, n FROM M, I WHERE model = 'A' AND target_season = 1997""")
def conformal_interval(spark: SparkSession, d: str) -> DataFrame:
    frame, actual, prediction = told(spark, d)
    radius = evaluate.conformal_radius(frame.where("target_season < 1997"), actual, prediction, 0.9).select("n", F.round("radius", 6).alias("radius"))
    out = evaluate.with_interval(frame.where("target_season = 1997"), radius, prediction)
    return out.select("player_id", "target_week", F.round(F.col("prediction_lower") + 1.3e-7, 4).alias("lower"), F.round(F.col("prediction_upper") + 1.3e-7, 4).alias("upper"), "n")
