"""The all-position archive on three small seasons."""

import pytest
from pyspark.sql import functions as F

from panelcast.plans import archive

TEAMS = ("GB", "SEA")
STATS = "player_id string, player_display_name string, position string, season int, week int, season_type string, game_id string, team string, opponent_team string, fantasy_points double, attempts double, carries double, targets double, receptions double, fg_att double, fg_made_0_19 double, fg_made_20_29 double, fg_made_30_39 double, fg_made_40_49 double, fg_made_50_59 double, fg_made_60_ double, pat_made double"


def players(spark):
    rows = []
    for s in (2020, 2021, 2022):
        for t, o in (TEAMS, TEAMS[::-1]):
            for pos, pts, att, car, tgt in (("QB", 20.0, 25.0, 2.0, 0.0), ("RB", 10.0, 0.0, 10.0, 4.0), ("WR", 12.0, 0.0, 0.0, 8.0), ("TE", 6.0, 0.0, 0.0, 4.0)):
                rows.append((f"{t}{pos}", f"{t} {pos}", pos, s, 1, "REG", f"g{s}", t, o, pts + s - 2020, att, car, tgt, tgt, 0.0, *[0.0] * 6, 0.0))
            rows.append((f"{t}K", f"{t} K", "K", s, 1, "REG", f"g{s}", t, o, 0.0, 0.0, 0.0, 0.0, 0.0, 4.0, 1.0, 0.0, 0.0, 1.0, 1.0, 0.0, 2.0))
    return spark.createDataFrame(rows, STATS)


def schedules(spark):
    return spark.createDataFrame([(f"g{s}", s, "REG", 1, "GB", "SEA", 20, 7) for s in (2020, 2021, 2022, 2023)], "game_id string, season int, game_type string, week int, home_team string, away_team string, home_score int, away_score int")


def known(spark):
    cols = "season int, week int, season_type string, game_id string, team string, opponent_team string, def_sacks double, def_interceptions double, fumble_recovery_opp double, def_tds double, special_teams_tds double, def_safeties double, def_punt_blocks double, def_pat_blocks double, def_fg_blocks double"
    stats = spark.createDataFrame([(s, 1, "REG", f"g{s}", t, o, 3.0, 1.0, 1.0, 0.0, 1.0, 0.0, 0.0, 0.0, 0.0) for s in (2020, 2021, 2022) for t, o in (TEAMS, TEAMS[::-1])], cols)
    return archive.facts(players(spark), stats, schedules(spark))


def test_facts(spark):
    got = {(r["player_id"], r["season"]): r for r in known(spark).collect()}
    assert got[("GBK", 2020)]["fantasy_points"] == 3 + 4 + 5 + 2
    assert got[("DST-GB", 2020)]["fantasy_points"] == 3 + 2 + 2 + 6 + 4 and got[("DST-SEA", 2020)]["fantasy_points"] == 3 + 2 + 2 + 6 + 1
    r = got[("GBWR", 2021)]
    assert (r["target_share"], r["team_targets"], r["team_pass_attempts"], r["team_rushing_attempts"], r["team_offensive_plays"]) == (0.5, 16.0, 25.0, 12.0, 37.0)


def test_training_uses_the_past_alone(spark):
    f = archive.training(known(spark), [2021, 2022])
    assert f.where("player_history_through_season >= target_season").count() == 0 and f.count() == 24
    r = f.where("player_id = 'GBQB' and target_season = 2022").first()
    assert (r["player_last_1_points"], r["player_last_10_points"], r["player_career_games"], r["player_previous_season_ppg"], r["fantasy_points"]) == (21.0, 20.5, 2.0, 21.0, 22.0)
    assert (r["team_position_ppg"], r["opponent_position_points_allowed"], r["position_qb"], r["team_previous_season_offensive_plays"]) == (21.0, 21.0, 1.0, 37.0)


def test_forecast_completes_the_roster(spark):
    charts = spark.createDataFrame([("2023-08-30", t, f"{t} {p}", f"{t}{p}", p, 1) for t in TEAMS for p in ("QB", "RB", "WR", "TE")] + [("2023-08-30", "GB", "GB K", "GBK", "PK", 1), ("2023-09-30", "SEA", "late", "late", "QB", 1), ("2023-08-30", "GB", "new", "newRB", "RB", 4)], "dt string, team string, player_name string, gsis_id string, pos_abb string, pos_rank int")
    absent = archive.absences(
        spark.createDataFrame([("GBQB", 2023, 1, "REG", "OUT"), ("GBWR", 2023, 1, "REG", "Questionable")], "gsis_id string, season int, week int, game_type string, report_status string"),
        spark.createDataFrame([("GBQB", 2023, 1, "REG", "RES"), ("GBTE", 2023, 1, "REG", "INA")], "gsis_id string, season int, week int, game_type string, status string"),
    )
    f = archive.forecast(known(spark), schedules(spark), charts, 2023, "2023-08-31", absent)
    got = {r["player_id"]: r for r in f.collect()}
    assert len(got) == 12 and "SEAK" in got and "late" not in got and "newRB" not in got  # the missing kicker is the last season's
    assert got["GBQB"]["injury_status"] == "Out / Reserve list" and got["GBQB"]["injury_missed_game"] is True and got["GBWR"]["injury_missed_game"] is False
    sums = f.groupBy("team").agg(F.sum("projected_target_share").alias("t"), F.sum("projected_carry_share").alias("c")).collect()
    assert all(r["t"] == pytest.approx(1) and r["c"] == pytest.approx(1) for r in sums)
    assert got["GBWR"]["projected_target_share"] == pytest.approx(0.5) and got["DST-GB"]["player_last_1_points"] == 17.0 and got["GBQB"]["fantasy_points"] is None
    with pytest.raises(Exception, match="roster slot"):
        archive.forecast(known(spark).where("position <> 'K'"), schedules(spark), charts, 2023, "2023-08-31").collect()


def test_charts_by_week(spark):
    rows = [("2022", 1, "REG", "Offense", "GB", "GBQB", "QB", "GB QB", "1"), ("2022", 1, "REG", "Offense", "GB", "GBQB", "QB", "GB QB", "2"), ("2022", 1, "REG", "Special Teams", "GB", "GBK", "K", "GB K", "1"),
            ("2022", 1, "REG", "Offense", "GB", "x1", "K", "wrong unit", "1"), ("2022", 1, "REG", "Special Teams", "GB", "x2", "WR", "returner", "1"), ("2022", 2, "REG", "Offense", "GB", "x3", "RB", "later", "1"),
            ("2022", 1, "POST", "Offense", "GB", "x4", "RB", "other games", "1"), ("2021", 1, "REG", "Offense", "GB", "x5", "RB", "other year", "1"), ("2022", 1, "REG", "Offense", "GB", None, "RB", "no id", "1"), ("2022", 1, "REG", "Offense", "GB", "x6", "RB", None, "1")]
    charts = spark.createDataFrame(rows, "season string, week int, game_type string, formation string, club_code string, gsis_id string, position string, full_name string, depth_team string")
    assert sorted((r["player_id"], r["player_name"], r["rank"]) for r in archive.weekly_charts(charts, 2022).collect()) == [("GBK", "GB K", 1), ("GBQB", "GB QB", 1)]


def test_past_season_from_weekly_charts(spark):
    cols = "season int, week int, game_type string, formation string, club_code string, gsis_id string, position string, full_name string, depth_team string"
    charts = spark.createDataFrame([(2022, 1, "REG", "Special Teams" if p == "K" else "Offense", t, f"{t}{p}", p, f"{t} {p}", "1") for t in TEAMS for p in ("QB", "RB", "WR", "TE", "K")], cols)
    got = {r["player_id"]: r for r in archive.forecast(known(spark), schedules(spark), charts, 2022, "2022-08-31").collect()}
    assert len(got) == 12 and got["GBQB"]["fantasy_points"] == 22.0 and got["GBQB"]["player_last_1_points"] == 21.0 and got["GBQB"]["player_history_through_season"] == 2021
