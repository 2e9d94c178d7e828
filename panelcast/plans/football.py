"""End-to-end jobs on football tables: feature tables of five positions, injury reports, coaching continuity, training.

Each job takes DataFrames (see the contracts) and returns one; nothing is collected. A feature table's history is strictly before its
target. `sequence` orders repeated rows of a key: the last one counts.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import presets
from ..functions.scalar import age_years, as_day, current_code, experience, feature_names, number_or_zero, ratio_or_zero, required, severity, tiered, weighted_score
from ..operators import absence, asof, panel, roster
from ..sources import io
from ..sources.contracts import Contract, check_input

PERIOD = ("target_season", "target_week")
#: Stats of each position that features are made of.
STATS = {
    "qb": ["passing_attempts", "passing_yards", "passing_touchdowns", "passing_interceptions", "passing_two_point_attempts", "passing_two_point_made", "rushing_attempts", "rushing_yards", "rushing_touchdowns", "rushing_two_point_attempts", "rushing_two_point_made", "fumbles"],
    "defense": ["points_allowed", "passing_yards_allowed", "rushing_yards_allowed", "turnovers"],
    "dst": ["points_allowed", "sacks", "interceptions", "fumble_recoveries", "touchdowns", "safeties", "blocked_kicks"],
    "kicker": ["fg_made_0_39", "fg_made_40_49", "fg_made_50_plus", "fg_missed", "pat_made", "pat_missed"],
    "receiving": ["rushing_attempts", "rushing_yards", "rushing_touchdowns", "rushing_two_point_made", "receptions", "targets", "receiving_yards", "receiving_touchdowns", "receiving_two_point_made", "fumbles",
                  "target_share", "carry_share", "team_targets", "team_pass_attempts", "team_rushing_attempts", "team_offensive_plays", "team_pass_rate", "team_rush_rate"],
    "idp": ["solo_tackles", "assisted_tackles", "sacks", "interceptions", "passes_defended", "fumbles_forced", "touchdowns"],
}
#: A kicker's stats, and what the weights call them.
KICKS = {
    "fg_made_0_39": "field_goals_0_39", "fg_made_40_49": "field_goals_40_49", "fg_made_50_plus": "field_goals_50_plus", "fg_missed": "field_goals_missed", "pat_made": "extra_points",
    "pat_missed": "extra_points_missed",
}
SCHEDULE = Contract("schedules", {"game_id": "text", "gameday": "date", "home_team": "text", "away_team": "text", "home_score": "number", "away_score": "number"}, ["game_id", "gameday", "home_team", "away_team"])
KEYS = {"season": "integer", "week": "integer", "season_type": "text", "game_id": "text"}
PLAYER_STATS = Contract("player_stats", {**KEYS, "player_id": "text", "player_display_name": "text", "position": "text"}, ["season", "week", "game_id"])
TEAM_STATS = Contract("team_stats", {**KEYS, "team": "text", "opponent_team": "text"}, ["season", "week", "game_id"])
DEFENDERS = Contract("player_stats", {**KEYS, "player_id": "text", "player_display_name": "text", "position_group": "text"}, ["season", "week", "game_id"])
INJURIES = Contract("injuries", {"season": "integer", "week": "integer", "gsis_id": "text", "report_status": "text"}, ["season", "week"])


@dataclass(frozen=True)
class Seasons:
    """history < train <= test: the first season read, the first trained on, and the season tested."""

    history: int
    train: int
    test: int

    def __post_init__(self):
        if not self.history < self.train <= self.test:
            raise ValueError("history must be before train, and train not after test")


def _stats(columns: dict[str, str | Sequence[str]]) -> dict[str, Column]:
    """Output stat -> the source column, or the sum of several; null is 0."""
    total = lambda names: sum((number_or_zero(F.col(c)) for c in names[1:]), number_or_zero(F.col(names[0])))
    return {k: total([v] if isinstance(v, str) else list(v)) for k, v in columns.items()}


def _regular(frame: DataFrame) -> DataFrame:
    return frame.where(F.col("season_type") == "REG")


def _arrival(frame: DataFrame) -> Column:
    """What orders the rows of a frame as they came. A frame's own order is told before any shuffle."""
    return F.col(io.ARRIVAL) if io.ARRIVAL in frame.columns else F.monotonically_increasing_id()


def _arrived(frame: DataFrame) -> DataFrame:
    return frame.withColumn(io.ARRIVAL, _arrival(frame))


def _keyed(frame: DataFrame, entity: Sequence[str], extra: dict[str, Column], stats: dict[str, Column]) -> DataFrame:
    """One row for each entity and period. Rows are dealt by entity, so that the windows of its history need no shuffle of their own."""
    rows = frame.select(*extra_columns(extra), F.col("season").cast("bigint").alias("target_season"), F.col("week").cast("bigint").alias("target_week"), F.col("game_id").alias("target_game_id"), *(v.alias(k) for k, v in stats.items()), io.ARRIVAL)
    return panel.last_write(rows, [*entity, *PERIOD], [io.ARRIVAL], within=entity).drop(io.ARRIVAL)


def extra_columns(extra: dict[str, Column]) -> list[Column]:
    return [v.alias(k) for k, v in extra.items()]


def _history(frame: DataFrame, entity: str, prefix: str) -> DataFrame:
    out = panel.history_features(frame, STATS[prefix], prefix, [entity], PERIOD)
    return out.withColumnsRenamed({f"{prefix}_through_{p}": f"{prefix}_history_through_{p.removeprefix('target_')}" for p in PERIOD})


def _features(prefix: str) -> list[str]:
    return feature_names(prefix, STATS[prefix])


def schedule_of(schedules: DataFrame) -> DataFrame:
    """Games with today's team codes and a day."""
    s = check_input(schedules, SCHEDULE)
    return s.select("game_id", as_day(F.col("gameday")).alias("game_date"), current_code(F.col("home_team")).alias("home_team"), current_code(F.col("away_team")).alias("away_team"), "home_score", "away_score").dropDuplicates(["game_id"])


def _sided(frame: DataFrame, schedules: DataFrame, own: bool) -> DataFrame:
    """Rows of teams with the points that their game's other side (own: their own defense) gave up; a row without a game or side fails the job."""
    rows = frame.withColumns({"team": current_code(F.col("team")), "opponent_team": current_code(F.col("opponent_team"))})
    games = roster.must_match(rows, schedule_of(schedules), ["game_id"], "game")
    first, second = (F.col("away_score"), F.col("home_score")) if own else (F.col("home_score"), F.col("away_score"))
    points = roster.resolve_side(F.col("team"), F.col("home_team"), F.col("away_team"), first, second)
    on_neither = (F.col("team") != F.col("home_team")) & (F.col("team") != F.col("away_team"))
    return games.withColumn("_points", F.when(on_neither, F.raise_error(F.concat(F.lit("team isn't in its game: "), "team")).cast("double")).otherwise(points))


def defense_games(team_stats: DataFrame, schedules: DataFrame) -> DataFrame:
    """What each defense allowed: the offense's row counts for its opponent."""
    rows = _sided(_regular(_arrived(check_input(team_stats, TEAM_STATS))), schedules, own=False)
    stats = {"points_allowed": number_or_zero(F.col("_points"))} | _stats({"passing_yards_allowed": "passing_yards", "rushing_yards_allowed": "rushing_yards", "turnovers": ["passing_interceptions", "fumbles_lost_total"]})
    return _keyed(rows, ["defense"], {"defense": F.col("opponent_team")}, stats)


def defense_history(team_stats: DataFrame, schedules: DataFrame) -> DataFrame:
    out = _history(defense_games(team_stats, schedules), "defense", "defense")
    return out.select(F.col("defense").alias("opponent"), *PERIOD, "defense_history_through_season", "defense_history_through_week", *_features("defense"))


def two_point_attempts(plays: DataFrame) -> DataFrame:
    """Passing and rushing two-point attempts by game and player."""
    tries = _regular(plays).where(F.col("two_point_attempt") == 1).withColumn("player_id", F.coalesce(F.nullif("passer_player_id", F.lit("")), F.nullif("rusher_player_id", F.lit("")))).where("player_id is not null")
    passed = F.coalesce(F.col("passer_player_id"), F.lit("")) != ""
    return tries.groupBy("game_id", "player_id").agg(F.count_if(passed).alias("passing_two_point_attempts"), F.count_if(~passed).alias("rushing_two_point_attempts"))


def known_players(players: DataFrame) -> DataFrame:
    return players.select(F.col("gsis_id").alias("player_id"), "display_name", as_day(F.col("birth_date")).alias("birth_date"), F.col("rookie_season").cast("bigint").alias("rookie_season")).where("player_id is not null").dropDuplicates(["player_id"])


def quarterback_games(player_stats: DataFrame, schedules: DataFrame, players: DataFrame, plays: DataFrame, min_attempts: int = 5) -> DataFrame:
    """Regular-season games of quarterbacks with enough attempts, one row for each player and week."""
    rows = _regular(_arrived(check_input(player_stats, PLAYER_STATS))).where((F.col("position") == "QB") & (F.col("attempts") >= min_attempts)).withColumn("opponent", current_code(F.col("opponent_team")))
    rows = roster.must_match(rows, schedule_of(schedules).select("game_id", "game_date"), ["game_id"], "game").join(two_point_attempts(plays), ["game_id", "player_id"], "left")
    rows = rows.join(known_players(players), "player_id", "left")
    stats = _stats({
        "passing_attempts": "attempts", "passing_yards": "passing_yards", "passing_touchdowns": "passing_tds", "passing_interceptions": "passing_interceptions", "passing_two_point_attempts": "passing_two_point_attempts",
        "passing_two_point_made": "passing_2pt_conversions", "rushing_attempts": "carries", "rushing_yards": "rushing_yards", "rushing_touchdowns": "rushing_tds", "rushing_two_point_attempts": "rushing_two_point_attempts",
        "rushing_two_point_made": "rushing_2pt_conversions", "fumbles": "fumbles_total",
    })
    extra = {"player_id": F.col("player_id"), "player_name": F.coalesce("display_name", "player_display_name"), "opponent": F.col("opponent"), "game_date": F.col("game_date"), "birth_date": F.col("birth_date"), "rookie_season": F.col("rookie_season")}
    return _keyed(rows, ["player_id"], extra, stats)


def quarterback_score(weights: dict = presets.QUARTERBACK) -> Column:
    made = F.col("passing_two_point_made") + F.col("rushing_two_point_made")
    return weighted_score({k: v for k, v in weights.items() if k != "two_point_conversions"}) + made * weights["two_point_conversions"]


def quarterback_features(player_stats: DataFrame, schedules: DataFrame, team_stats: DataFrame, players: DataFrame, plays: DataFrame, min_attempts: int = 5, weights: dict = presets.QUARTERBACK) -> DataFrame:
    """Quarterbacks by game. A first game takes the means of all rookies' games before it, if there are any."""
    games = quarterback_games(player_stats, schedules, players, plays, min_attempts)
    rookies = asof.cohort_means(games, F.col("target_season") == F.col("rookie_season"), STATS["qb"], PERIOD)
    q = _history(games, "player_id", "qb").join(F.broadcast(rookies), list(PERIOD), "left")
    through = F.col("cohort_through")
    q = q.withColumns({"qb_history_through_season": F.coalesce("qb_history_through_season", (through / 100).cast("bigint")), "qb_history_through_week": F.coalesce("qb_history_through_week", through % 100)} | {c: F.coalesce(c, f"cohort_{c.split('_', 3)[3]}") for c in _features("qb")})
    out = q.join(defense_history(team_stats, schedules), ["opponent", *PERIOD], "left").where("birth_date is not null and defense_history_through_season is not null and qb_last_1_passing_attempts is not null")
    out = out.withColumns({"age": age_years(F.col("birth_date"), F.col("game_date")), "years_pro": experience(F.col("target_season"), F.col("rookie_season")).cast("double"), "fantasy_points": quarterback_score(weights)})
    return out.select("player_id", "player_name", *PERIOD, "target_game_id", "qb_history_through_season", "qb_history_through_week", "defense_history_through_season", "defense_history_through_week", "age", "years_pro", *_features("qb"), *_features("defense"), "fantasy_points")


def defense_features(team_stats: DataFrame, schedules: DataFrame, weights: dict = presets.DEFENSE) -> DataFrame:
    """Teams' own defenses by game; first games are dropped."""
    rows = _sided(_regular(_arrived(check_input(team_stats, TEAM_STATS))), schedules, own=True)
    stats = {"points_allowed": number_or_zero(F.col("_points"))} | _stats({"sacks": "def_sacks", "interceptions": "def_interceptions", "fumble_recoveries": "fumble_recovery_opp", "touchdowns": "def_tds", "safeties": "def_safeties", "blocked_kicks": ["def_punt_blocks", "def_pat_blocks", "def_fg_blocks"]})
    out = _history(_keyed(rows, ["team"], {"team": F.col("team")}, stats), "team", "dst").where("dst_history_through_season is not null")
    return out.withColumn("fantasy_points", weighted_score(weights) + tiered(F.col("points_allowed"))).select("team", *PERIOD, "target_game_id", "dst_history_through_season", "dst_history_through_week", *_features("dst"), "fantasy_points")


def kicker_features(player_stats: DataFrame, weights: dict = presets.KICKER) -> DataFrame:
    weights = {c: weights[KICKS[c]] for c in STATS["kicker"]}
    rows = _regular(_arrived(check_input(player_stats, PLAYER_STATS))).where("position = 'K'")
    stats = _stats({"fg_made_0_39": ["fg_made_0_19", "fg_made_20_29", "fg_made_30_39"], "fg_made_40_49": "fg_made_40_49", "fg_made_50_plus": ["fg_made_50_59", "fg_made_60_"], "fg_missed": "fg_missed", "pat_made": "pat_made", "pat_missed": "pat_missed"})
    games = _keyed(rows, ["player_id"], {"player_id": F.col("player_id"), "player_name": F.col("player_display_name")}, stats)
    out = _history(games, "player_id", "kicker").where("kicker_history_through_season is not null")
    return out.withColumn("fantasy_points", weighted_score(weights)).select("player_id", "player_name", *PERIOD, "target_game_id", "kicker_history_through_season", "kicker_history_through_week", *_features("kicker"), "fantasy_points")


def receiving_games(player_stats: DataFrame, schedules: DataFrame, positions: Sequence[str] = ("RB", "WR", "TE")) -> DataFrame:
    """Backs, receivers and ends by game, with their shares of the team's targets and carries. Team totals count every position."""
    every = _regular(_arrived(check_input(player_stats, PLAYER_STATS))).where("player_id is not null")
    totals = panel.group_totals(every, ["game_id", "team"], ["targets", "attempts", "carries"])
    rows = every.where(F.col("position").isin(list(positions))).join(totals, ["game_id", "team"])
    rows = roster.must_match(rows, schedule_of(schedules).select("game_id"), ["game_id"], "game")
    stats = _stats({
        "rushing_attempts": "carries", "rushing_yards": "rushing_yards", "rushing_touchdowns": "rushing_tds", "rushing_two_point_made": "rushing_2pt_conversions", "receptions": "receptions", "targets": "targets",
        "receiving_yards": "receiving_yards", "receiving_touchdowns": "receiving_tds", "receiving_two_point_made": "receiving_2pt_conversions", "fumbles": "fumbles_total",
        "team_targets": "total_targets", "team_pass_attempts": "total_attempts", "team_rushing_attempts": "total_carries", "team_offensive_plays": ["total_attempts", "total_carries"],
    })
    share = lambda a, b: ratio_or_zero(number_or_zero(F.col(a)), b)
    plays = F.col("total_attempts") + F.col("total_carries")
    stats |= {"target_share": share("targets", F.col("total_targets")), "carry_share": share("carries", F.col("total_carries")), "team_pass_rate": share("total_attempts", plays), "team_rush_rate": share("total_carries", plays)}
    extra = {"player_id": F.col("player_id"), "player_name": F.col("player_display_name"), "position": F.col("position"), "team": current_code(F.col("team")), "opponent": current_code(F.col("opponent_team"))}
    return _keyed(rows, ["player_id"], extra, stats)


def receiving_points(reception: float = 0.0) -> Column:
    """Points of a row of receiving_games. reception: 0, 0.5 or 1 points a catch."""
    made = F.col("rushing_two_point_made") + F.col("receiving_two_point_made")
    weights = {k: v for k, v in presets.RECEIVING.items() if k != "two_point_conversions"}
    return presets.receiving_score(reception, weights) + made * presets.RECEIVING["two_point_conversions"]


def receiving_features(player_stats: DataFrame, schedules: DataFrame, team_stats: DataFrame, reception: float = 0.0, positions: Sequence[str] = ("RB", "WR", "TE")) -> DataFrame:
    """Games of backs, receivers and ends with their history and the opposing defense's; first games are dropped."""
    games = _history(receiving_games(player_stats, schedules, positions), "player_id", "receiving")
    out = games.join(defense_history(team_stats, schedules), ["opponent", *PERIOD], "left").where("receiving_history_through_season is not null and defense_history_through_season is not null")
    out = out.withColumn("fantasy_points", receiving_points(reception))
    return out.select("player_id", "player_name", "position", "team", "opponent", *PERIOD, "target_game_id", "receiving_history_through_season", "receiving_history_through_week", "defense_history_through_season", "defense_history_through_week", *_features("receiving"), *_features("defense"), "fantasy_points")


def defender_features(player_stats: DataFrame, weights: dict = presets.DEFENDER) -> DataFrame:
    rows = _regular(_arrived(check_input(player_stats, DEFENDERS))).where(F.col("position_group").isin("DL", "LB", "DB"))
    stats = _stats({"solo_tackles": "def_tackles_solo", "assisted_tackles": "def_tackles_with_assist", "sacks": "def_sacks", "interceptions": "def_interceptions", "passes_defended": "def_pass_defended", "fumbles_forced": "def_fumbles_forced", "touchdowns": "def_tds"})
    games = _keyed(rows, ["player_id"], {"player_id": F.col("player_id"), "player_name": F.col("player_display_name"), "position_group": F.col("position_group")}, stats)
    out = _history(games, "player_id", "idp").where("idp_history_through_season is not null")
    return out.withColumn("fantasy_points", weighted_score(weights)).select("player_id", "player_name", "position_group", *PERIOD, "target_game_id", "idp_history_through_season", "idp_history_through_week", *_features("idp"), "fantasy_points")


def train_test(features: DataFrame, seasons: Seasons) -> tuple[DataFrame, DataFrame]:
    """Rows of the training seasons (the test season not among them) and of the test season."""
    s = F.col("target_season")
    return features.where((s >= seasons.train) & (s < seasons.test)), features.where(s == seasons.test)


def injury_reports(injuries: DataFrame, first: int = 2009, last: int = 2024) -> DataFrame:
    """Recognised statuses of covered seasons, the last to arrive of a player's week: an Out that becomes Questionable ends as Questionable."""
    rows = absence.covered(_arrived(check_input(injuries, INJURIES)), "season", first, last).where("game_type = 'REG' and gsis_id is not null").withColumn("severity", severity(F.col("report_status"))).where("severity is not null")
    out = rows.select(F.col("gsis_id").alias("entity"), F.col("season").cast("bigint").alias("season"), F.col("week").cast("bigint").alias("week"), "team", F.col("full_name").alias("name"), F.col("report_status").alias("status"), "severity", F.col("report_primary_injury").alias("primary_injury"), io.ARRIVAL)
    return panel.last_write(out, ["entity", "season", "week"], [io.ARRIVAL]).drop(io.ARRIVAL)


def injury_impact(games: DataFrame, injuries: DataFrame, window: int = 10, last_week: int = 18) -> DataFrame:
    """Each report with the player's pace before it and the weeks missed. games: entity, season, week, score."""
    return absence.pace_and_streak(games, injury_reports(injuries), window=window, last_week=last_week)


def injury_snapshot(feed: DataFrame, players: DataFrame) -> DataFrame:
    """The landed feed's players that the crosswalk knows."""
    crosswalk = players.select(F.col("espn_id").cast("string").alias("athlete_id"), F.col("gsis_id").alias("player_id"))
    return io.known_players(feed, crosswalk)


def coaching_continuity(schedules: DataFrame) -> DataFrame:
    """team, season, holder, changed: the coach of a season is the one of its earliest game."""
    sides = roster.two_rows(schedules, ["season", "week"], {"team": ("home_team", "away_team"), "coach": ("home_coach", "away_coach")})
    rows = sides.withColumns({"team": current_code(F.col("team")), "season": F.col("season").cast("bigint")})
    return roster.holder_changes(rows, "team", "season", [F.col("week")], "coach")


def latest_state(games: DataFrame, entity: str, prefix: str) -> DataFrame:
    """Of each entity the last value and the mean of up to ten of its newest games, and the newest game's period."""
    newest = panel.top_rows(games, [entity], [F.desc(p) for p in PERIOD], 10, "_k")
    last = F.col("_k") == 1
    return newest.groupBy(entity).agg(
        *(F.max(F.when(last, F.col(f))).alias(f"{prefix}_last_1_{f}") for f in STATS[prefix]), *(F.avg(f).alias(f"{prefix}_last_10_{f}") for f in STATS[prefix]),
        *(F.max(F.when(last, F.col(p))).alias(f"{prefix}_history_through_{p.removeprefix('target_')}") for p in PERIOD))


def quarterback_forecast(games: DataFrame, defenses: DataFrame, schedules: DataFrame, depth_charts: DataFrame, players: DataFrame, target_year: int, through: int, as_of: str, outcomes: DataFrame | None = None) -> DataFrame:
    """A season's games with each team's first quarterback as of a day, frozen at the end of season `through`.

    games, defenses: the facts of quarterback_games and defense_games. The day is the one asked for, or the day before the first game.
    A player without history takes the rookies' means. A team without a starter or a birth date, or an opponent without history, fails the job.
    """
    if target_year <= through:
        raise ValueError("target_year must be after the history")
    season = schedules.where((F.col("season") == target_year) & (F.col("game_type") == "REG")).withColumns({"day": as_day(F.col("gameday")), "home_team": current_code(F.col("home_team")), "away_team": current_code(F.col("away_team"))})
    day = F.broadcast(asof.forecast_day(season, "day", "season", F.lit(as_of).cast("date")).select(F.col("as_of").alias("forecast_as_of")))
    charts = depth_charts.where("pos_abb = 'QB' and pos_rank = 1").withColumn("_day", as_day(F.col("dt"))).crossJoin(day)
    starters = asof.snapshot(charts, "_day", F.col("forecast_as_of")).select(current_code(F.col("team")).alias("team"), F.col("gsis_id").alias("player_id"), "player_name", "forecast_as_of")
    sides = roster.two_rows(season, ["game_id", "week", "day"], {"team": ("home_team", "away_team"), "opponent": ("away_team", "home_team")})
    rows = roster.must_match(sides, starters, ["team"], "team's starter")
    past = games.where(F.col("target_season") <= through)
    state = latest_state(past, "player_id", "qb")
    cohort = past.where("target_season = rookie_season").agg(*(F.avg(f).alias(f"_rookie_{f}") for f in STATS["qb"]), F.max(asof.period_number(PERIOD)).alias("_rookie_through"))
    rows = rows.join(state, "player_id", "left").crossJoin(F.broadcast(cohort))
    rows = rows.withColumns({c: F.coalesce(c, f"_rookie_{c.split('_', 3)[3]}") for c in _features("qb")} | {
        "qb_history_through_season": F.coalesce("qb_history_through_season", (F.col("_rookie_through") / 100).cast("bigint")), "qb_history_through_week": F.coalesce("qb_history_through_week", F.col("_rookie_through") % 100)})
    rows = rows.join(known_players(players).select("player_id", "birth_date", "rookie_season"), "player_id", "left")
    born = required(F.col("birth_date"), F.concat(F.lit("birth date of "), "player_name"))
    against = latest_state(defenses.where(F.col("target_season") <= through), "defense", "defense").withColumnRenamed("defense", "opponent")
    rows = roster.must_match(rows, against, ["opponent"], "opponent's history")
    if outcomes is None:
        rows = rows.withColumn("fantasy_points", F.lit(None).cast("double"))
    else:
        rows = rows.join(outcomes.select("player_id", F.col("target_game_id").alias("game_id"), "fantasy_points"), ["player_id", "game_id"], "left")
    # here a first season of 0 is as unknown as none
    years = experience(F.lit(target_year).cast("bigint"), F.nullif("rookie_season", F.lit(0))).cast("double")
    return rows.select(
        "player_id", "player_name", F.lit("QB").alias("position"), "team", "opponent", F.lit(target_year).cast("bigint").alias("target_season"), F.col("week").cast("bigint").alias("target_week"), F.col("game_id").alias("target_game_id"),
        F.col("forecast_as_of").cast("string").alias("forecast_as_of"), F.lit(through).cast("bigint").alias("history_through_season"), "qb_history_through_season", "qb_history_through_week", "defense_history_through_season", "defense_history_through_week",
        age_years(born, F.col("day")).alias("age"), years.alias("years_pro"), *_features("qb"), *_features("defense"), "fantasy_points")
