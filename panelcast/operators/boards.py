"""Boards over predictions: consensus of models, season and week rankings, scorecards."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalar import agreement, first_present, flags
from ..session import staged
from . import ranks

CONSENSUS = "Consensus"
#: Columns that rows of several models must share to be one forecast; those that a frame lacks are left out.
IDENTITY = (
    "player_id", "player_name", "position", "team", "opponent", "target_season", "target_week", "target_game_id", "forecast_as_of", "history_through_season", "status", "missed",
)
#: The columns of a result, and what files call them: the names that boards use come first.
RESULTS = {"actual": ("actual", "fantasy_points"), "missed": ("missed", "injury_missed_game"), "status": ("status", "injury_status")}
REQUIRED = ("player_id", "player_name", "target_season", "target_week", "prediction")
#: Context of a forecast, and the feature that stands for it where the forecast has none.
OPPORTUNITY = {
    "projected_target_share": "receiving_last_10_target_share",
    "projected_carry_share": "receiving_last_10_carry_share",
    "team_previous_season_targets": "receiving_last_10_team_targets",
    "team_previous_season_pass_attempts": "receiving_last_10_team_pass_attempts",
    "team_previous_season_rushing_attempts": "receiving_last_10_team_rushing_attempts",
    "team_previous_season_offensive_plays": "receiving_last_10_team_offensive_plays",
    "team_previous_season_pass_rate": "receiving_last_10_team_pass_rate",
    "team_previous_season_rush_rate": "receiving_last_10_team_rush_rate",
}
#: What stands for a missing position, team and opponent.
DEFAULTS = {"position": "QB", "team": "N/A", "opponent": "N/A"}
#: Spreads up to which models agree tightly, and up to which they are mixed.
TIGHT, MIXED = 1.5, 3.0
#: Shares and plays below which an opportunity is at risk.
COMMITTEE_SHARE, LOW_TARGET_SHARE, LOW_VOLUME = 0.45, 0.15, 58.0


def opportunity(columns: Sequence[str]) -> dict[str, Column]:
    """The context columns, from the forecast itself or else from trailing features, and which of the two they rest on."""
    found = {c: first_present(columns, [(c, "own"), (trailing, "trailing")])[0] for c, trailing in OPPORTUNITY.items()}
    have = set(columns)
    basis = "Depth-chart estimate" if have & set(OPPORTUNITY) else "Trailing history" if have & set(OPPORTUNITY.values()) else "Unavailable"
    return found | {"opportunity_basis": F.lit(basis)}


def prepare(frame: DataFrame, model: str | None = None, results: bool = False) -> DataFrame:
    """A prediction frame with all columns that boards read, beside those that it has: results under any of their names, defaults, upper-case names of positions and
    teams, context, error of the prediction.

    A model that is given is the name of all rows. A frame without a required column is refused, and so is one without a column of outcomes where `results` are asked
    for; whether it has rows is for the reader of files to check.
    """
    missing = [c for c in REQUIRED if c not in frame.columns]
    if results and not set(RESULTS["actual"]) & set(frame.columns):
        missing.append(" or ".join(RESULTS["actual"]))
    if missing:
        raise ValueError(f"predictions lack {', '.join(missing)}")
    have = set(frame.columns)
    typed = lambda c, t: (F.col(c) if c in have else F.lit(None)).cast(t)
    result = lambda c, t: typed(next((x for x in RESULTS[c] if x in have), c), t)
    new = {
        "player_id": typed("player_id", "string"), "player_name": typed("player_name", "string"), "target_season": typed("target_season", "bigint"), "target_week": typed("target_week", "bigint"),
        "prediction": typed("prediction", "double"), "actual": result("actual", "double"), "missed": F.coalesce(result("missed", "boolean"), F.lit(False)), "status": result("status", "string"),
        "model": F.lit(model) if model or "model" not in have else F.col("model"),
    }
    new |= opportunity(frame.columns) | {c: F.upper(F.coalesce(typed(c, "string"), F.lit(d))) for c, d in DEFAULTS.items()}
    return frame.withColumns(new).withColumns({"error": F.col("prediction") - F.col("actual"), "absolute_error": F.abs(F.col("prediction") - F.col("actual"))})


def union_models(frames: Sequence[DataFrame]) -> DataFrame:
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out


def _context(columns: Sequence[str]) -> dict[str, Column]:
    means = {c: F.avg(c) for c in OPPORTUNITY if c in columns}
    return means | {"opportunity_basis": F.min("opportunity_basis")} if "opportunity_basis" in columns else means


def consensus(frame: DataFrame, identity: Sequence[str] = IDENTITY) -> DataFrame:
    """Mean prediction over models, their sample deviation and number, an actual if there is one (models share it), and the context's means.

    A forecast has a row a model, too few to be worth combining before the shuffle: rows are sorted by forecast and model and taken one forecast after the other, so that a
    task holds no table of its forecasts, and sums don't depend on the order in which rows arrive.
    """
    keys = [c for c in identity if c in frame.columns]
    ordered = Window.partitionBy(*keys).orderBy("model")
    of = ordered.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    found = {"prediction": F.avg("prediction"), "spread": F.stddev_samp("prediction"), "models": F.collect_set("model"), "actual": F.max("actual")} | _context(frame.columns)
    out = frame.select(*keys, F.row_number().over(ordered).alias("_nth"), *(c.over(of).alias(name) for name, c in found.items())).where("_nth = 1").drop("_nth")
    out = out.withColumns({"spread": F.coalesce("spread", F.lit(0.0)), "models": F.size("models").cast("bigint")})
    return out.withColumns({"error": F.col("prediction") - F.col("actual"), "absolute_error": F.abs(F.col("prediction") - F.col("actual")), "model": F.lit(CONSENSUS)})


def choose_model(frame: DataFrame, model: str) -> DataFrame:
    if model == CONSENSUS:
        return consensus(frame)
    return frame.where(F.col("model") == model).withColumns({"spread": F.lit(0.0), "models": F.lit(1).cast("bigint")})


def model_choices(frame: DataFrame) -> DataFrame:
    """Names of the models in order, after the consensus if there are several."""
    names = frame.select("model").distinct()
    extra = names.agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(F.lit(CONSENSUS).alias("model"))
    return extra.union(names)


def draft_board(frame: DataFrame, season: int, positions: Sequence[str] | None = None) -> DataFrame:
    """One row a player for a season: projected and actual totals, those with games missed by injury added at the projected or the actual pace, gaps to the
    projection (in points and percent), context and its risks, ranked within the position.

    A player's rows are summed in the order of their weeks, so that equal seasons have sums equal to the last bit, in whatever order rows arrive, and rank by player_id; rows of one week are ordered by the
    values summed. The sums are staged, so that the forecast is read once; ranks are taken over ranges of the points. Actual figures are null until the selection has any result, and points also where the
    player neither played nor missed a game by injury. The frame is one model or the consensus (see choose_model).
    """
    rows = frame.where(F.col("target_season") == season)
    if positions is not None:
        rows = rows.where(F.col("position").isin(list(positions)))
    keys = ["player_id", "player_name", "position", "team"]
    ordered = Window.partitionBy(*keys).orderBy("target_week", "prediction", "actual", "spread", *(c for c in OPPORTUNITY if c in rows.columns))
    of = ordered.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    found = {
        "projected_points": F.sum("prediction"), "points_per_game": F.avg("prediction"), "volatility": F.stddev_samp("prediction"), "model_spread": F.avg("spread"), "projected_games": F.count(F.lit(1)),
        "actual_games": F.count("actual"), "actual_points": F.sum("actual"), "injury_games": F.count_if("missed"),
    } | _context(rows.columns)
    out = rows.select(*keys, F.row_number().over(ordered).alias("_nth"), *(c.over(of).alias(name) for name, c in found.items())).where("_nth = 1").drop("_nth")
    out = out.withColumns({c: F.coalesce(c, F.lit(0.0)) for c in ("volatility", "actual_points")})
    out = staged(out, "board")
    out = out.crossJoin(F.broadcast(out.agg((F.sum("actual_games") > 0).alias("_any"))))
    there = F.col("_any") & ((F.col("actual_games") > 0) | (F.col("injury_games") > 0))
    out = out.withColumns({"actual_points": F.when(there, F.col("actual_points")), "injury_games": F.when(F.col("_any"), F.col("injury_games")), "actual_games": F.when(F.col("_any"), F.col("actual_games"))}).drop("_any")
    out = out.withColumns({"actual_points_per_game": F.when(F.col("actual_games") > 0, F.try_divide("actual_points", "actual_games")), "projection_delta": F.col("actual_points") - F.col("projected_points")})
    for pace, per_game in (("projected_pace", "points_per_game"), ("actual_pace", "actual_points_per_game")):
        added = F.col("injury_games") * F.col(per_game)
        delta = F.col("actual_points") + added - F.col("projected_points")
        out = out.withColumns({
            f"{pace}_injury_points": added, f"{pace}_adjusted_actual": F.col("actual_points") + added, f"{pace}_adjusted_delta": delta,
            f"{pace}_adjusted_delta_percent": F.try_divide(delta, "projected_points") * 100,
        })
    if "opportunity_basis" in out.columns:
        out = out.withColumn("opportunity_risk", opportunity_risk())
    return ranks.ordinal(out, ["position"], "projected_points", ["player_id"], "position_rank")


def opportunity_risk() -> Column:
    position = F.col("position")
    return flags({
        "RB committee": (position == "RB") & (F.col("projected_carry_share") < COMMITTEE_SHARE),
        "Low target share": position.isin("WR", "TE") & (F.col("projected_target_share") < LOW_TARGET_SHARE),
        "Low-volume offense": position.isin("QB", "RB", "WR", "TE") & (F.col("team_previous_season_offensive_plays") < LOW_VOLUME),
    })


#: The measures of a board as bars: points they start from, and points added for games missed by injury.
MEASURES = {
    "Projected": ("projected_points", None), "Actual": ("actual_points", None),
    "Adjusted at projected PPG": ("actual_points", "projected_pace_injury_points"), "Adjusted at actual PPG": ("actual_points", "actual_pace_injury_points"),
}


def measure_bars(board: DataFrame, ids: Sequence[str] = ("player_id",)) -> DataFrame:
    """ids, measure, base_points, addition_points, total_points of each measure; adjusted ones of players that missed games by injury alone, and none without points."""
    bar = lambda name, base, more: F.struct(F.lit(name).alias("measure"), F.col(base).alias("base_points"), (F.col(more) if more else F.lit(0.0)).alias("addition_points"), F.lit(more is None).alias("plain"))
    rows = board.select(*ids, "injury_games", F.explode(F.array(*(bar(k, *v) for k, v in MEASURES.items()))).alias("s")).select(*ids, "injury_games", "s.*")
    rows = rows.where(F.col("plain") | (F.col("injury_games") > 0)).withColumn("total_points", F.col("base_points") + F.col("addition_points"))
    return rows.where(F.col("total_points").isNotNull()).select(*ids, "measure", "base_points", "addition_points", "total_points")


#: The columns of the season's and the week's table as they are shown, and what they hold (and times what).
SEASON_TABLE = {
    "Rank": "position_rank", "Pos": "position", "Player": "player_name", "Team": "team", "Projected": "projected_points", "Target share %": ("projected_target_share", 100.0),
    "Carry share %": ("projected_carry_share", 100.0), "Off. plays/game": "team_previous_season_offensive_plays", "Pass rate %": ("team_previous_season_pass_rate", 100.0),
    "Usage watch": "opportunity_risk", "Usage basis": "opportunity_basis", "Actual": "actual_points", "Inj. missed": "injury_games", "Adj. at proj. PPG": "projected_pace_adjusted_actual",
    "Proj. pace gap %": "projected_pace_adjusted_delta_percent", "Adj. at actual PPG": "actual_pace_adjusted_actual", "Actual pace gap %": "actual_pace_adjusted_delta_percent",
    "Projected PPG": "points_per_game", "Actual PPG": "actual_points_per_game", "Played": "actual_games", "Scheduled": "projected_games", "Weekly swing": "volatility", "Model spread": "model_spread",
}
WEEK_TABLE = {
    "Rank": "position_rank", "Pos": "position", "Player": "player_name", "Team": "team", "Opponent": "opponent", "Projected": "prediction", "Model spread": "spread", "Agreement": "agreement", "Actual": "actual",
}


def display_table(board: DataFrame, columns: dict[str, str | tuple[str, float]]) -> DataFrame:
    """A board as it is shown: its columns under their labels, shares as percents."""
    cell = lambda v: F.col(v) if isinstance(v, str) else F.col(v[0]) * v[1]
    return board.select(*(cell(v).alias(label) for label, v in columns.items()))


def weekly_board(frame: DataFrame, season: int, week: int, positions: Sequence[str] | None = None) -> DataFrame:
    rows = frame.where((F.col("target_season") == season) & (F.col("target_week") == week))
    if positions is not None:
        rows = rows.where(F.col("position").isin(list(positions)))
    ranked = ranks.ordinal(staged(rows, "week"), ["position"], "prediction", ["player_id"], "position_rank")
    return ranked.withColumn("agreement", agreement(F.col("models"), F.col("spread"), TIGHT, MIXED))


def top_players(board: DataFrame, measure: str, count: int, search: str | None = None) -> DataFrame:
    """The largest of a measure, nulls last. The search is for a literal part of the name, in its case."""
    rows = board if search is None else board.where(F.col("player_name").contains(search))
    return rows.orderBy(F.desc_nulls_last(measure), "player_id").limit(count)


def scorecard(frame: DataFrame) -> DataFrame:
    """Samples, MAE, RMSE and bias (prediction - actual) of each model, and of the consensus if there are several.

    Whether there are is told by the scorecard itself, a row a model, before those without an error go.
    """
    both = frame.select("model", "error").unionByName(consensus(frame).select("model", "error"))
    each = both.groupBy("model").agg(
        F.count("error").alias("samples"), F.avg(F.abs("error")).alias("mae"), F.sqrt(F.avg(F.col("error") * F.col("error"))).alias("rmse"), F.avg("error").alias("bias"))
    told = each.withColumn("_models", F.count_if(F.col("model") != CONSENSUS).over(Window.partitionBy()))
    return told.where((F.col("samples") > 0) & (~F.col("model").eqNullSafe(CONSENSUS) | (F.col("_models") > 1))).drop("_models")


def forecast_state(frame: DataFrame, through: str = "history_through_season") -> DataFrame:
    """One row: predictions, results, and the state: of a forecast with a frozen history a replay if there are results, else upcoming; rolling without that column."""
    frozen = through in frame.columns
    one = frame.agg(F.count(F.lit(1)).alias("n_predictions"), F.count("actual").alias("n_actual"), (F.max(through) if frozen else F.lit(None).cast("bigint")).alias("history_through"), F.max("target_season").alias("target_season"))
    return one.withColumn("state", F.when(F.col("n_actual") > 0, "replay").otherwise("upcoming") if frozen else F.lit("rolling"))


def long_series(frame: DataFrame, ids: Sequence[str], values: Sequence[str], name: str = "series", value: str = "points") -> DataFrame:
    return frame.unpivot(list(ids), list(values), name, value)


def player_history(frame: DataFrame, players: Sequence[str], season: int) -> DataFrame:
    return frame.where(F.col("player_id").isin(list(players)) & (F.col("target_season") == season))
