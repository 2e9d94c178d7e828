"""The forecast archive of all positions: scored facts, rosters as of a day, and features frozen at the end of the season before.

Features of many target years come from one pass: states at each season's end are valid for later years up to the entity's next
season, and sums by season are joined to the years that read them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import presets
from ..functions.scalar import as_day, current_code, number_or_zero, one_hot, participated, ratio_or_zero, tiered
from ..operators import absence, panel, roster

PLAYERS = ("QB", "RB", "WR", "TE", "K")
POSITIONS = (*PLAYERS, "DST")
#: How many players of a position a team's roster has.
DEPTH = {"QB": 1, "RB": 3, "WR": 3, "TE": 2, "K": 1}
TARGETED, CARRYING = ("RB", "WR", "TE"), ("QB", "RB")
VOLUME = ("team_targets", "team_pass_attempts", "team_rushing_attempts", "team_offensive_plays", "team_pass_rate", "team_rush_rate")
FACTS = ("player_id", "player_name", "position", "team", "opponent", "season", "week", "game_id", "is_home", "player_targets", "player_carries", *VOLUME[:4], "target_share", "carry_share", *VOLUME[4:], "fantasy_points")


def _num(c: str) -> Column:
    return number_or_zero(F.col(c))


def _games(schedules: DataFrame) -> DataFrame:
    return schedules.select("game_id", current_code(F.col("home_team")).alias("home_team"), current_code(F.col("away_team")).alias("away_team"), "home_score", "away_score").dropDuplicates(["game_id"])


def player_facts(player_stats: DataFrame, schedules: DataFrame) -> DataFrame:
    """Games in which a player of the five positions took part. Team volumes count these positions, whether a player took part or not."""
    rows = player_stats.where((F.col("season_type") == "REG") & F.col("position").isin(list(PLAYERS)) & F.col("player_id").isNotNull())
    rows = rows.withColumns({"team": current_code(F.col("team")), "opponent": current_code(F.col("opponent_team")), "player_targets": _num("targets"), "player_carries": _num("carries"), "_attempts": _num("attempts")})
    volume = rows.groupBy("game_id", "team").agg(F.sum("player_targets").alias("team_targets"), F.sum("_attempts").alias("team_pass_attempts"), F.sum("player_carries").alias("team_rushing_attempts"))
    volume = volume.withColumn("team_offensive_plays", F.col("team_pass_attempts") + F.col("team_rushing_attempts"))
    short, far = _num("fg_made_0_19") + _num("fg_made_20_29") + _num("fg_made_30_39"), _num("fg_made_50_59") + _num("fg_made_60_")
    w = presets.KICKER
    kicks = short * w["field_goals_0_39"] + _num("fg_made_40_49") * w["field_goals_40_49"] + far * w["field_goals_50_plus"] + _num("pat_made") * w["extra_points"]
    used = [F.col(c) for c in ("attempts", "carries", "targets", "receptions", "fg_att")]
    rows = rows.where(participated(F.col("fantasy_points"), used)).join(_games(schedules).select("game_id", "home_team"), "game_id").join(volume, ["game_id", "team"], "left")
    plays = F.col("team_offensive_plays")
    rows = rows.withColumns({
        "is_home": (F.col("team") == F.col("home_team")).cast("double"), "fantasy_points": F.when(F.col("position") == "K", kicks).otherwise(_num("fantasy_points")),
        "target_share": ratio_or_zero(F.col("player_targets"), F.col("team_targets")), "carry_share": ratio_or_zero(F.col("player_carries"), F.col("team_rushing_attempts")),
        "team_pass_rate": ratio_or_zero(F.col("team_pass_attempts"), plays), "team_rush_rate": ratio_or_zero(F.col("team_rushing_attempts"), plays),
        "player_name": F.col("player_display_name"), "season": F.col("season").cast("bigint"), "week": F.col("week").cast("bigint"),
    })
    return rows.select(*FACTS)


def defense_facts(team_stats: DataFrame, schedules: DataFrame) -> DataFrame:
    """Teams' defenses as entities of their own; special-teams touchdowns count here."""
    rows = team_stats.where("season_type = 'REG'").join(_games(schedules), "game_id").withColumns({"team": current_code(F.col("team")), "opponent": current_code(F.col("opponent_team"))})
    home = F.col("team") == F.col("home_team")
    allowed = F.coalesce(F.when(home, F.col("away_score")).otherwise(F.col("home_score")), F.lit(0))
    blocks = _num("def_punt_blocks") + _num("def_pat_blocks") + _num("def_fg_blocks")
    points = _num("def_sacks") + 2 * (_num("def_interceptions") + _num("fumble_recovery_opp") + _num("def_safeties") + blocks) + 6 * (_num("def_tds") + _num("special_teams_tds")) + tiered(allowed)
    zero = {c: F.lit(0.0) for c in FACTS[9:-1]}
    return rows.withColumns(zero | {
        "player_id": F.concat(F.lit("DST-"), "team"), "player_name": F.concat("team", F.lit(" D/ST")), "position": F.lit("DST"), "is_home": home.cast("double"), "fantasy_points": points,
        "season": F.col("season").cast("bigint"), "week": F.col("week").cast("bigint")}).select(*FACTS)


def facts(player_stats: DataFrame, team_stats: DataFrame, schedules: DataFrame) -> DataFrame:
    return player_facts(player_stats, schedules).unionByName(defense_facts(team_stats, schedules))


def daily_charts(charts: DataFrame, as_of: str) -> DataFrame:
    """Each team's newest chart up to a day; teams are told apart by the code in the chart."""
    rows = charts.withColumns({"_day": as_day(F.col("dt")), "position": F.when(F.col("pos_abb") == "PK", "K").otherwise(F.col("pos_abb"))})
    rows = rows.where((F.col("_day") <= F.lit(as_of).cast("date")) & F.col("position").isin(list(PLAYERS))).dropna(subset=["gsis_id", "player_name"])
    newest = rows.groupBy("team").agg(F.max("_day").alias("_day"))
    picked = rows.join(newest, ["team", "_day"]).withColumn("team", current_code(F.col("team")))
    return picked.groupBy("team", F.col("gsis_id").alias("player_id"), "position").agg(F.min_by("player_name", "pos_rank").alias("player_name"), F.min("pos_rank").cast("bigint").alias("rank"))


def weekly_charts(charts: DataFrame, year: int) -> DataFrame:
    """The charts of a season's first week, as seasons before the daily charts have them: kickers from the special teams, all others from the offense."""
    unit = F.when(F.col("position") == "K", "Special Teams").otherwise("Offense")
    rows = charts.where((F.col("season") == year) & (F.col("week") == 1) & (F.col("game_type") == "REG") & F.col("position").isin(list(PLAYERS)) & (F.col("formation") == unit))
    rows = rows.dropna(subset=["gsis_id", "full_name"]).withColumns({"team": current_code(F.col("club_code")), "_rank": F.col("depth_team").cast("bigint")})
    return rows.groupBy("team", F.col("gsis_id").alias("player_id"), "position").agg(F.min_by("full_name", F.struct("_rank", "full_name")).alias("player_name"), F.min("_rank").alias("rank"))


def charts_of(charts: DataFrame, year: int, as_of: str) -> DataFrame:
    """Charts by day have a column `dt` and are read up to a day; charts by week are read in the season's first."""
    return daily_charts(charts, as_of) if "dt" in charts.columns else weekly_charts(charts, year)


def candidates(charts: DataFrame) -> DataFrame:
    return roster.depth_filter(charts, ["team"], "position", "rank", ["QB", "K"], DEPTH)


def complete_roster(found: DataFrame, known: DataFrame, teams: DataFrame, year: int) -> DataFrame:
    """Candidates, and for positions that a team has none of, its best producers of the season before. A job fails where there is nobody."""
    spark = found.sparkSession
    slots = F.broadcast(spark.createDataFrame([(p, n) for p, n in DEPTH.items()], "position string, depth bigint"))
    gaps = roster.grid_gaps(found, teams.select("team").distinct(), slots.select("position"))
    produced = known.where((F.col("season") == year - 1) & F.col("position").isin(list(PLAYERS))).groupBy("team", "position", "player_id").agg(F.max("player_name").alias("player_name"), F.sum("fantasy_points").alias("_points"))
    best = produced.withColumn("rank", F.row_number().over(Window.partitionBy("team", "position").orderBy(F.desc("_points"), "player_id")).cast("bigint")).join(slots, "position").where("rank <= depth")
    filled = roster.must_match(gaps, best.select("team", "position", "player_id", "player_name", "rank"), ["team", "position"], "roster slot")
    return found.select("team", "position", "player_id", "player_name", "rank").unionByName(filled.select("team", "position", "player_id", "player_name", "rank"))


def projected_shares(rosters: DataFrame, known: DataFrame, year: int) -> DataFrame:
    """Parts of a team's targets and carries, from means of ten games or of the position's last three seasons, less the lower the rank."""
    past = known.where((F.col("season") < year) & F.col("position").isin(list(PLAYERS)))
    last = panel.top_rows(past, ["player_id", "position"], [F.desc("season"), F.desc("week")], 10, "_k").groupBy("player_id", "position").agg(F.avg("target_share").alias("_t"), F.avg("carry_share").alias("_c"))
    base = past.where(F.col("season") >= year - 3).groupBy("position").agg(F.avg("target_share").alias("_bt"), F.avg("carry_share").alias("_bc"))
    rows = rosters.join(last, ["player_id", "position"], "left").join(F.broadcast(base), "position", "left")
    weight = lambda own, other, who: F.when(F.col("position").isin(list(who)), F.coalesce(own, other, F.lit(0.0))).otherwise(0.0)
    rows = roster.shares(rows, ["team"], weight("_t", "_bt", TARGETED), F.col("rank"), "projected_target_share")
    rows = roster.shares(rows, ["team"], weight("_c", "_bc", CARRYING), F.col("rank"), "projected_carry_share")
    return rows.select("team", "position", "player_id", "player_name", "projected_target_share", "projected_carry_share")


def states(known: DataFrame) -> DataFrame:
    """For each player and position what is known at the end of each season in which they played."""
    w = Window.partitionBy("player_id", "position").orderBy("season", "week")
    own = Window.partitionBy("player_id", "position", "season")
    cols = {"player_career_ppg": F.avg("fantasy_points").over(w.rowsBetween(Window.unboundedPreceding, 0)), "player_career_games": F.count(F.lit(1)).over(w.rowsBetween(Window.unboundedPreceding, 0)).cast("double"),
            "_season_ppg": F.avg("fantasy_points").over(own), "_season_games": F.count(F.lit(1)).over(own).cast("double"), "_nth": F.row_number().over(own.orderBy(F.desc("week")))}
    for stat, name in (("fantasy_points", "points"), ("target_share", "target_share"), ("carry_share", "carry_share")):
        cols |= {f"player_last_1_{name}": F.col(stat)} | {f"player_last_{n}_{name}": F.avg(stat).over(w.rowsBetween(-(n - 1), 0)) for n in (5, 10)}
    last = known.withColumns(cols).where("_nth = 1")
    last = last.withColumn("_next", F.coalesce(F.lead("season").over(Window.partitionBy("player_id", "position").orderBy("season")), F.lit(9999)))
    return last.select("player_id", "position", F.col("season").alias("_state"), "_next", *(c for c in cols if c != "_nth"))


def features(base: DataFrame, known: DataFrame) -> DataFrame:
    """base: identity, target_season, target_week, is_home and, if there are, projected shares, injury status and outcome. All positions and years at once."""
    years = F.broadcast(base.select("target_season").distinct())
    y = F.col("target_season")
    rows = base
    for c, kind in (("projected_target_share", "double"), ("projected_carry_share", "double"), ("injury_status", "string"), ("fantasy_points", "double")):
        rows = rows if c in rows.columns else rows.withColumn(c, F.lit(None).cast(kind))
    rows = rows if "injury_missed_game" in rows.columns else rows.withColumn("injury_missed_game", F.lit(False))
    state = states(known)
    b = rows.alias("b")
    rows = b.join(state.alias("s"), (F.col("b.player_id") == F.col("s.player_id")) & (F.col("b.position") == F.col("s.position")) & (F.col("_state") < y) & (y <= F.col("_next")), "left").select("b.*", *(F.col(f"s.{c}") for c in state.columns if c not in ("player_id", "position")))
    recent = known.join(years, (F.col("season") < y) & (F.col("season") >= y - 3))
    baseline = recent.groupBy("target_season", "position").agg(F.avg("fantasy_points").alias("_ppg"), F.avg("target_share").alias("_ts"), F.avg("carry_share").alias("_cs"), F.max("season").alias("_bl"))
    rows = rows.join(baseline, ["target_season", "position"], "left")
    before = known.withColumn("target_season", F.col("season") + 1)
    own = before.groupBy("target_season", "team", "position").agg(F.avg("fantasy_points").alias("team_position_ppg"))
    faced = before.groupBy("target_season", "opponent", "position").agg(F.avg("fantasy_points").alias("opponent_position_points_allowed"))
    rows = rows.join(own, ["target_season", "team", "position"], "left").join(faced, ["target_season", "opponent", "position"], "left")
    games = known.where("position <> 'DST'").dropDuplicates(["season", "team", "game_id"])
    # the season before, or the newest one there is if nobody played in it
    pick = known.join(years, F.col("season") < y).groupBy("target_season").agg(F.coalesce(F.max(F.when((F.col("season") == y - 1) & (F.col("position") != "DST"), F.col("season"))), F.max("season")).alias("season"))
    volume = games.join(F.broadcast(pick), "season").groupBy("target_season", "team").agg(*(F.avg(c).alias(c.replace("team_", "team_previous_season_", 1)) for c in VOLUME))
    rows = rows.join(volume, ["target_season", "team"], "left")
    mean = Window.partitionBy("target_season")
    filled = {c: F.coalesce(c, "_ppg") for c in ("player_last_1_points", "player_last_5_points", "player_last_10_points", "player_career_ppg", "team_position_ppg", "opponent_position_points_allowed")}
    filled |= {f"player_last_{n}_{k}": F.coalesce(f"player_last_{n}_{k}", v) for n in (1, 5, 10) for k, v in (("target_share", "_ts"), ("carry_share", "_cs"))}
    last = F.col("_state") == y - 1
    filled |= {"player_previous_season_ppg": F.coalesce(F.when(last, F.col("_season_ppg")), "_ppg"), "player_previous_season_games": F.coalesce(F.when(last, F.col("_season_games")), F.lit(0.0)), "player_career_games": F.coalesce("player_career_games", F.lit(0.0))}
    filled |= {"target_week_normalized": F.col("target_week") / 18.0, "player_history_through_season": F.coalesce("_state", "_bl"), "opponent_history_through_season": y - 1, "history_through_season": y - 1}
    filled |= {c: F.coalesce(c, F.avg(c).over(mean), F.lit(0.0)) for c in (v.replace("team_", "team_previous_season_", 1) for v in VOLUME)}
    out = rows.withColumns(filled | one_hot(F.col("position"), POSITIONS, "position"))
    out = out.withColumns({f"projected_{k}_share": F.coalesce(f"projected_{k}_share", f"player_last_10_{k}_share") for k in ("target", "carry")})
    return out.drop("_state", "_next", "_season_ppg", "_season_games", "_ppg", "_ts", "_cs", "_bl")


def training(known: DataFrame, years: list[int]) -> DataFrame:
    """Every played game of the target years with the features of its year."""
    base = known.where(F.col("season").isin(years)).select("player_id", "player_name", "position", "team", "opponent", F.col("season").alias("target_season"), F.col("week").alias("target_week"), F.col("game_id").alias("target_game_id"), "is_home", "fantasy_points")
    return features(base, known)


def absences(injuries: DataFrame, rosters: DataFrame) -> DataFrame:
    """player_id, season, week, status: "Out" where reported out, "Reserve list" where on reserve, or both."""
    key = {"player_id": F.col("gsis_id"), "season": F.col("season").cast("bigint"), "week": F.col("week").cast("bigint")}
    pick = lambda f, told: f.where("game_type = 'REG'").where(F.coalesce(F.col("gsis_id"), F.lit("")) != "").select(*(v.alias(k) for k, v in key.items()), F.lit(told).alias("status"))
    return absence.joined_statuses([pick(injuries.where(F.lower("report_status") == "out"), "Out"), pick(rosters.where("status = 'RES'"), "Reserve list")], list(key))


def forecast(known: DataFrame, schedules: DataFrame, charts: DataFrame, year: int, as_of: str, absent: DataFrame | None = None) -> DataFrame:
    """One target season: roster as of a day, completed; its games; outcomes and absences attached after the features are frozen."""
    season = schedules.where((F.col("season") == year) & (F.col("game_type") == "REG")).withColumns({"home_team": current_code(F.col("home_team")), "away_team": current_code(F.col("away_team"))})
    sides = roster.two_rows(season, ["game_id", "week"], {"team": ("home_team", "away_team"), "opponent": ("away_team", "home_team")})
    past = known.where(F.col("season") < year)
    people = projected_shares(complete_roster(candidates(charts_of(charts, year, as_of)), past, sides, year), past, year)
    teams = sides.select("team").distinct().select(F.concat(F.lit("DST-"), "team").alias("player_id"), F.concat("team", F.lit(" D/ST")).alias("player_name"), F.lit("DST").alias("position"), "team", F.lit(0.0).alias("projected_target_share"), F.lit(0.0).alias("projected_carry_share"))
    rows = sides.join(people.unionByName(teams), "team").withColumns({"target_season": F.lit(year).cast("bigint"), "target_week": F.col("week").cast("bigint"), "is_home": F.col("home").cast("double")})
    rows = rows.join(known.select("player_id", "game_id", "fantasy_points"), ["player_id", "game_id"], "left").withColumnRenamed("game_id", "target_game_id")
    if absent is not None:
        told = absent.select("player_id", F.col("season").alias("target_season"), F.col("week").alias("target_week"), F.col("status").alias("injury_status"))
        rows = rows.join(told, ["player_id", "target_season", "target_week"], "left").withColumn("injury_missed_game", F.col("fantasy_points").isNull() & F.col("injury_status").isNotNull())
    return features(rows.drop("week", "home"), past).withColumn("forecast_as_of", F.lit(as_of))


