"""The football jobs on small seasons."""

import pytest
from pyspark.sql import functions as F

from panelcast.plans import football as fb


def schedules(spark):
    rows = [(f"g{s}{w}", s, w, f"{s}-09-{w:02d}", "GB" if w % 2 else "OAK", "LV" if w % 2 else "GB", 24, 17, "A", "B" if s < 2022 else "C") for s in (2020, 2021, 2022) for w in (1, 2)]
    return spark.createDataFrame(rows, "game_id string, season int, week int, gameday string, home_team string, away_team string, home_score int, away_score int, home_coach string, away_coach string")


def team_stats(spark):
    rows = [(s, w, "REG", f"g{s}{w}", t, o, 200.0 + w, 100.0, 1.0, 1.0, 2.0 + w, 1.0, 1.0, 0.0, 0.0, 1.0, 0.0, 0.0) for s in (2020, 2021, 2022) for w in (1, 2) for t, o in (("GB", "OAK"), ("OAK", "GB"))]
    cols = "season int, week int, season_type string, game_id string, team string, opponent_team string, passing_yards double, rushing_yards double, passing_interceptions double, fumbles_lost_total double, def_sacks double, def_interceptions double, fumble_recovery_opp double, def_tds double, def_safeties double, def_punt_blocks double, def_pat_blocks double, def_fg_blocks double"
    return spark.createDataFrame(rows, cols)


def player_stats(spark):
    base = [(p, n, pos, s, w, "REG", f"g{s}{w}", "GB", "LV", att, 200.0 + 10 * w, 2.0, 1.0, 0.0, car, 20.0, 0.0, 0.0, 0.0, tgt, 3.0, 30.0, 1.0, 0.0) for s in (2020, 2021, 2022) for w in (1, 2)
            for p, n, pos, att, car, tgt in (("q1", "Q One", "QB", 30.0, 3.0, 0.0), ("r1", "R One", "RB", 0.0, 10.0, 5.0), ("w1", "W One", "WR", 0.0, 10.0, 5.0))]
    cols = "player_id string, player_display_name string, position string, season int, week int, season_type string, game_id string, team string, opponent_team string, attempts double, passing_yards double, passing_tds double, passing_interceptions double, passing_2pt_conversions double, carries double, rushing_yards double, rushing_tds double, rushing_2pt_conversions double, fumbles_total double, targets double, receptions double, receiving_yards double, receiving_tds double, receiving_2pt_conversions double"
    return spark.createDataFrame(base, cols)


def test_quarterbacks(spark):
    players = spark.createDataFrame([("q1", "Known Name", "1990-01-01", 2020)], "gsis_id string, display_name string, birth_date string, rookie_season int")
    plays = spark.createDataFrame([("g20201", "REG", 1, "q1", None), ("g20201", "REG", 0, "q1", None)], "game_id string, season_type string, two_point_attempt int, passer_player_id string, rusher_player_id string")
    f = fb.quarterback_features(player_stats(spark), schedules(spark), team_stats(spark), players, plays)
    got = f.orderBy("target_season", "target_week").collect()
    assert [(r["target_season"], r["target_week"]) for r in got] == [(2020, 2), (2021, 1), (2021, 2), (2022, 1), (2022, 2)]
    first = got[0]
    assert first["player_name"] == "Known Name" and first["qb_last_1_passing_two_point_attempts"] == 1.0 and first["qb_last_10_passing_yards"] == 210.0
    assert first["fantasy_points"] == pytest.approx(220 / 25 + 2 * 4 - 2 + 2) and first["years_pro"] == 0.0
    for r in got:
        key = (r["target_season"], r["target_week"])
        assert (r["qb_history_through_season"], r["qb_history_through_week"]) < key and (r["defense_history_through_season"], r["defense_history_through_week"]) < key
    train, test = fb.train_test(f, fb.Seasons(2020, 2021, 2022))
    assert (train.count(), test.count()) == (2, 2)
    with pytest.raises(ValueError):
        fb.Seasons(2021, 2021, 2022)


def test_rookie_means_fill_a_debut(spark):
    late = player_stats(spark).where("season = 2020 and week = 2 and player_id = 'q1'").withColumn("player_id", F.lit("q2"))
    players = spark.createDataFrame([("q1", "a", "1990-01-01", 2020), ("q2", "b", "1991-01-01", 2020)], "gsis_id string, display_name string, birth_date string, rookie_season int")
    plays = spark.createDataFrame([], "game_id string, season_type string, two_point_attempt int, passer_player_id string, rusher_player_id string")
    f = fb.quarterback_features(player_stats(spark).union(late), schedules(spark), team_stats(spark), players, plays).where("player_id = 'q2'").collect()
    assert len(f) == 1 and f[0]["qb_last_1_passing_yards"] == 210.0 and (f[0]["qb_history_through_season"], f[0]["qb_history_through_week"]) == (2020, 1)


def test_defense_and_receiving(spark):
    d = fb.defense_features(team_stats(spark), schedules(spark)).orderBy("team", "target_season", "target_week").collect()
    assert len(d) == 10 and {r["team"] for r in d} == {"GB", "LV"}
    r = next(x for x in d if x["team"] == "GB" and (x["target_season"], x["target_week"]) == (2020, 2))
    assert r["dst_last_1_points_allowed"] == 17.0 and r["dst_last_1_sacks"] == 3.0
    assert r["fantasy_points"] == 4.0 + 2.0 + 2.0 + 2.0 + 0.0  # 4 sacks, one interception, recovery and block; 24 allowed
    w = fb.receiving_features(player_stats(spark), schedules(spark), team_stats(spark), reception=1.0).where("player_id = 'r1'").orderBy("target_season", "target_week").first()
    assert w["receiving_last_1_target_share"] == 0.5 and w["receiving_last_1_carry_share"] == pytest.approx(10 / 23)
    assert w["receiving_last_1_team_offensive_plays"] == 53.0 and w["receiving_last_1_team_pass_rate"] == pytest.approx(30 / 53)
    assert w["fantasy_points"] == pytest.approx(2.0 + 3.0 + 6.0 + 3.0)


def test_missing_game_fails(spark):
    with pytest.raises(Exception, match="no match for game"):
        fb.defense_features(team_stats(spark), schedules(spark).where("season > 2020")).collect()


def test_kickers_and_defenders(spark):
    cols = "player_id string, player_display_name string, position string, season int, week int, season_type string, game_id string, fg_made_0_19 double, fg_made_20_29 double, fg_made_30_39 double, fg_made_40_49 double, fg_made_50_59 double, fg_made_60_ double, fg_missed double, pat_made double, pat_missed double"
    k = spark.createDataFrame([("k", "K", "K", 2020, w, "REG", f"g{w}", 1.0, 1.0, None, 1.0, 1.0, 0.0, 1.0, 3.0, 0.0) for w in (1, 2)], cols)
    got = fb.kicker_features(k).collect()
    assert len(got) == 1 and got[0]["fantasy_points"] == 18.0 and got[0]["kicker_last_1_fg_made_0_39"] == 2.0
    cols = "player_id string, player_display_name string, position_group string, season int, week int, season_type string, game_id string, def_tackles_solo double, def_tackles_with_assist double, def_sacks double, def_interceptions double, def_pass_defended double, def_fumbles_forced double, def_tds double"
    i = spark.createDataFrame([("l", "L", "LB", 2020, w, "REG", f"g{w}", 5.0, 4.0, 1.0, 1.0, 1.0, 1.0, 1.0) for w in (1, 2)], cols)
    assert [r["fantasy_points"] for r in fb.defender_features(i).collect()] == [5 + 2 + 4 + 6 + 2 + 2 + 6]


def test_reports_and_coaches(spark):
    cols = "season int, week int, game_type string, team string, gsis_id string, full_name string, report_status string, report_primary_injury string"
    rows = [(2020, 3, "REG", "GB", "q", "Q", "Out", "Knee"), (2020, 4, "REG", "GB", "q", "Q", "Questionable", None), (2020, 4, "REG", "GB", "x", "X", "Note", None), (1999, 4, "REG", "GB", "q", "Q", "Out", None)]
    games = spark.createDataFrame([("q", 2020, 1, 20.0), ("q", 2020, 2, 28.0), ("q", 2020, 4, 2.0)], "entity string, season bigint, week bigint, score double")
    got = fb.injury_impact(games, spark.createDataFrame(rows, cols)).orderBy("week").collect()
    assert [(r["week"], r["pace"], r["weeks_missed"], r["delta"], r["played"]) for r in got] == [(3, 24.0, 0, None, False), (4, 24.0, 1, -22.0, True)]
    c = {(r["team"], r["season"]): r["changed"] for r in fb.coaching_continuity(schedules(spark)).collect()}
    assert c[("LV", 2022)] is True and c[("LV", 2021)] is False and c[("GB", 2020)] is False


def test_forecast(spark):
    players = spark.createDataFrame([("q1", "a", "1990-01-01", 2020), ("new", "b", "2000-01-01", 2023)], "gsis_id string, display_name string, birth_date string, rookie_season int")
    plays = spark.createDataFrame([], "game_id string, season_type string, two_point_attempt int, passer_player_id string, rusher_player_id string")
    games = fb.quarterback_games(player_stats(spark), schedules(spark), players, plays)
    defenses = fb.defense_games(team_stats(spark), schedules(spark))
    season = spark.createDataFrame([("f1", 2023, "REG", 1, "2023-09-01", "GB", "OAK")], "game_id string, season int, game_type string, week int, gameday string, home_team string, away_team string")
    charts = spark.createDataFrame([("2023-08-01", "GB", "old", "x", "QB", 1), ("2023-08-30", "GB", "a", "q1", "QB", 1), ("2023-08-30", "OAK", "b", "new", "QB", 1), ("2023-09-05", "GB", "late", "y", "QB", 1)], "dt string, team string, player_name string, gsis_id string, pos_abb string, pos_rank int")
    got = {r["team"]: r for r in fb.quarterback_forecast(games, defenses, season, charts, players, 2023, 2022, "2023-12-31").collect()}
    assert set(got) == {"GB", "LV"} and {r["forecast_as_of"] for r in got.values()} == {"2023-08-31"} and got["GB"]["fantasy_points"] is None
    assert got["GB"]["qb_last_1_passing_yards"] == 220.0 and (got["GB"]["qb_history_through_season"], got["GB"]["qb_history_through_week"]) == (2022, 2)
    assert got["LV"]["player_id"] == "new" and got["LV"]["qb_last_1_passing_yards"] == got["LV"]["qb_last_10_passing_yards"] == 215.0
    assert got["LV"]["qb_history_through_season"] == 2020 and got["LV"]["years_pro"] == 0.0
