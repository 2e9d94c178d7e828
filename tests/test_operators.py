"""Small frames with known answers."""

import datetime as dt

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from panelcast.functions import presets, scalar
from panelcast.operators import absence, asof, boards, evaluate, panel, roster
from panelcast.sources import contracts, io


def rows(frame, *order):
    return [tuple(r) for r in frame.orderBy(*order).collect()]


def one(frame):
    return tuple(frame.first())


def test_quarterback_score(spark):
    f = spark.createDataFrame([(250.0, 2.0, 1.0, 20.0, 1.0, 0.0, 1.0)], list(presets.QUARTERBACK))
    assert one(f.select(F.round(presets.quarterback_score(), 6))) == (22.0,)


def test_tiers(spark):
    f = spark.createDataFrame([(v,) for v in (0.0, 6.0, 13.0, 20.0, 27.0, 34.0, 35.0, None)], "v double")
    assert [r[0] for r in f.select(scalar.tiered(F.col("v"))).collect()] == [10.0, 7.0, 4.0, 1.0, 0.0, -1.0, -4.0, None]


def test_codes_and_severity(spark):
    f = spark.createDataFrame([("STL",), ("SD",), ("GB",), (None,)], "c string")
    assert [r[0] for r in f.select(scalar.current_code(F.col("c"))).collect()] == ["LA", "LAC", "GB", None]
    g = spark.createDataFrame([("Out",), ("Doubtful",), ("Fine",)], "c string")
    assert [r[0] for r in g.select(scalar.severity(F.col("c"))).collect()] == [3, 2, None]


def test_history_excludes_own_row(spark):
    data = [("a", 2020, w, float(10 * w)) for w in range(1, 13)]
    f = panel.history_features(spark.createDataFrame(data, "entity string, season int, week int, v double"), ["v"], "h")
    got = {r["week"]: r for r in f.collect()}
    assert got[1]["h_last_1_v"] is None and got[1]["h_last_10_v"] is None
    assert (got[3]["h_last_1_v"], got[3]["h_last_10_v"], got[3]["h_through_week"]) == (20.0, 15.0, 2)
    assert got[12]["h_last_10_v"] == sum(10 * w for w in range(2, 12)) / 10
    assert panel.with_history(f, "h").count() == 11


def test_last_write(spark):
    f = spark.createDataFrame([("a", 1, 1, "x"), ("a", 1, 2, "y"), ("b", 1, 1, None)], "e string, k int, seq int, v string")
    assert rows(panel.last_write(f, ["e", "k"], ["seq"]), "e") == [("a", 1, 2, "y"), ("b", 1, 1, None)]


def test_cohort_means_are_strictly_before(spark):
    f = spark.createDataFrame([("a", 2014, 1, 100.0, True), ("b", 2014, 2, 50.0, True), ("c", 2014, 2, 7.0, False)], "e string, season int, week int, v double, rookie boolean")
    assert rows(asof.cohort_means(f, F.col("rookie"), ["v"]), "week") == [(2014, 2, 1, 100.0, 201401)]


def test_snapshots(spark):
    d = dt.date
    f = spark.createDataFrame([("x", d(2023, 8, 1), 1), ("x", d(2023, 8, 5), 2), ("y", d(2023, 8, 3), 3), ("y", d(2023, 9, 9), 4)], "team string, day date, v int")
    on = F.lit("2023-08-31").cast("date")
    assert [r["v"] for r in asof.snapshot(f, "day", on).collect()] == [2]
    assert sorted(r["v"] for r in asof.snapshot(f, "day", on, ["team"]).collect()) == [2, 3]


def test_grid_and_fill(spark):
    teams, slots = spark.createDataFrame([("A",), ("B",)], "team string"), spark.createDataFrame([("K",), ("QB",)], "slot string")
    gaps = roster.grid_gaps(spark.createDataFrame([("A", "K"), ("A", "QB"), ("B", "QB")], "team string, slot string"), teams, slots)
    assert rows(gaps, "team") == [("B", "K")]
    pool = spark.createDataFrame([("B", "K", "p1", 5.0), ("B", "K", "p2", 9.0)], "team string, slot string, player string, score double")
    assert [r["player"] for r in roster.fill_gaps(gaps, pool, ["team", "slot"], [F.desc("score")]).collect()] == ["p2"]


def test_shares_sum_to_one(spark):
    f = spark.createDataFrame([("A", 4.0, 1), ("A", 2.0, 4), ("B", 0.0, 1)], "team string, w double, r int")
    got = roster.shares(f, ["team"], F.col("w"), F.col("r")).groupBy("team").agg(F.sum("share"))
    assert rows(got, "team") == [("A", 1.0), ("B", 0.0)]


def test_must_match(spark):
    f, g = spark.createDataFrame([(1,), (2,)], "k int"), spark.createDataFrame([(1,)], "k int")
    assert one(roster.match_report(f, g, ["k"])) == (2, 1)
    with pytest.raises(Exception, match="no match for row 2"):
        roster.must_match(f, g, ["k"]).collect()


def test_holder_changes(spark):
    f = spark.createDataFrame([("A", 2020, 1, "x"), ("A", 2021, 2, "y"), ("A", 2021, 1, "x"), ("A", 2022, 1, "y"), ("A", 2024, 1, "z")], "team string, season int, week int, coach string")
    got = roster.holder_changes(f, "team", "season", [F.col("week")], "coach")
    assert rows(got.select("season", "holder", "changed"), "season") == [(2020, "x", False), (2021, "x", False), (2022, "y", True), (2024, "z", False)]


def test_pace_and_streak(spark):
    games = spark.createDataFrame([("q", 2020, 1, 20.0), ("q", 2020, 2, 28.0), ("q", 2020, 4, 2.0), ("other", 2020, 1, 9.0)], "entity string, season int, week int, score double")
    reports = spark.createDataFrame([("q", 2020, 3, "Out"), ("q", 2020, 4, "Questionable"), ("nobody", 2020, 4, "Out")], "entity string, season int, week int, status string")
    got = absence.pace_and_streak(games, reports).select("week", "played", "pace", "weeks_missed", "delta")
    assert rows(got, "week") == [(3, False, 24.0, 0, None), (4, True, 24.0, 1, -22.0)]


def test_joined_statuses(spark):
    a = spark.createDataFrame([("p", 1, "RES"), ("p", 1, "Out"), ("p", 1, "Out")], "e string, w int, status string")
    assert rows(absence.joined_statuses([a, a], ["e", "w"]), "e") == [("p", 1, "Out / RES")]


def predictions(spark):
    data = [(p, f"name {p}", "QB", "T", 2024, w, m, v + (2.0 if m == "B" else 0.0), a, w == 2 and p == "1") for p, w, v, a in (("1", 1, 19.0, 16.0), ("1", 2, 21.0, None), ("2", 1, 17.0, 12.0), ("2", 2, 15.0, 8.0)) for m in "AB"]
    return boards.prepare(spark.createDataFrame(data, "player_id string, player_name string, position string, team string, target_season int, target_week int, model string, prediction double, actual double, missed boolean"))


def test_consensus_and_board(spark):
    c = boards.consensus(predictions(spark))
    got = rows(c.select("player_id", "target_week", "prediction", F.round("spread", 6), "models"), "player_id", "target_week")
    assert [g[2] for g in got] == [20.0, 22.0, 18.0, 16.0] and {g[3] for g in got} == {1.414214} and {g[4] for g in got} == {2}
    b = boards.draft_board(c, 2024).select("player_id", "projected_points", "actual_points", "projected_pace_adjusted_actual", "position_rank", F.round("projected_pace_adjusted_delta_percent", 4))
    assert rows(b, "player_id") == [("1", 42.0, 16.0, 37.0, 1, round(-500 / 42, 4)), ("2", 34.0, 20.0, 20.0, 2, round(-1400 / 34, 4))]


def test_board_without_results_is_null(spark):
    p = predictions(spark).withColumn("actual", F.lit(None).cast("double"))
    got = boards.draft_board(boards.choose_model(p, "A"), 2024).collect()
    assert {(r["actual_points"], r["actual_games"], r["injury_games"], r["projection_delta"]) for r in got} == {(None,) * 4}


def test_board_of_players_without_games_and_of_missed_games_alone(spark):
    data = [("1", 1, 10.0, 8.0, False), ("2", 1, 10.0, None, False), ("3", 1, 10.0, None, True), ("4", 1, 10.0, 6.0, False), ("4", 2, 14.0, None, True)]
    p = boards.prepare(spark.createDataFrame([(i, "n", "RB", "t", 2024, w, v, a, x, 0.2, 50.0) for i, w, v, a, x in data], "player_id string, player_name string, position string, team string, target_season int, target_week int, prediction double, actual double, missed boolean, receiving_last_10_carry_share double, receiving_last_10_team_offensive_plays double"), "m")
    got = {r["player_id"]: r for r in boards.draft_board(boards.choose_model(p, "m"), 2024).collect()}
    one = lambda i, *names: tuple(got[i][c] for c in names)
    assert one("2", "actual_points", "injury_games", "projected_pace_adjusted_actual") == (None, 0, None)
    assert one("3", "actual_points", "projected_pace_adjusted_actual", "actual_points_per_game", "actual_pace_adjusted_actual") == (0.0, 10.0, None, None)
    assert one("4", "actual_points", "projected_pace_injury_points", "actual_pace_injury_points", "projected_pace_adjusted_delta", "actual_pace_adjusted_delta_percent") == (6.0, 12.0, 6.0, -6.0, -50.0)
    assert {(r["opportunity_basis"], r["opportunity_risk"], r["team"]) for r in got.values()} == {("Trailing history", "RB committee; Low-volume offense", "T")}
    bars = {(r["player_id"], r["measure"]): r["total_points"] for r in boards.measure_bars(boards.draft_board(boards.choose_model(p, "m"), 2024)).collect()}
    assert bars == {**{(i, "Projected"): 24.0 if i == "4" else 10.0 for i in "1234"}, ("1", "Actual"): 8.0, ("3", "Actual"): 0.0, ("4", "Actual"): 6.0, ("3", "Adjusted at projected PPG"): 10.0, ("4", "Adjusted at projected PPG"): 18.0, ("4", "Adjusted at actual PPG"): 12.0}


def test_board_sums_weeks_in_their_order(spark):
    """Equal seasons are equal to the last bit however their rows arrive: they rank by player_id, and a mean share at the bound is told alike."""
    points, shares, orders = (0.1, 0.2, 0.3, 0.4), (0.03, 0.04, 0.24, 0.29), {"a": (3, 2, 1, 0), "b": (0, 1, 2, 3), "c": (0, 3, 1, 2)}
    backwards, mixed = 0.4 + 0.3 + 0.2 + 0.1, (0.03 + 0.29 + 0.04 + 0.24) / 4
    assert backwards < 1.0 and mixed < boards.LOW_TARGET_SHARE
    data = [(i, "n", "WR", "t", 2024, k + 1, points[k], points[k], shares[k]) for i, order in orders.items() for k in order]
    schema = "player_id string, player_name string, position string, team string, target_season int, target_week int, prediction double, actual double, projected_target_share double"
    for parts in (spark.createDataFrame(data, schema).coalesce(1), spark.createDataFrame(data, schema).repartition(3, "target_week"), spark.createDataFrame(data[::-1], schema).coalesce(1)):
        got = boards.draft_board(boards.choose_model(boards.prepare(parts, "m"), "m"), 2024).orderBy("player_id").collect()
        assert [(r["player_id"], r["position_rank"], r["projected_points"], r["actual_points"], r["opportunity_risk"]) for r in got] == [("a", 1, 1.0, 1.0, ""), ("b", 2, 1.0, 1.0, ""), ("c", 3, 1.0, 1.0, "")]
        assert len({(r["volatility"], r["points_per_game"], r["projected_target_share"]) for r in got}) == 1


def test_prepare_defaults_and_state(spark):
    raw = spark.createDataFrame([("1", "n", 2024, 1, 3.0, "x")], "player_id string, player_name string, target_season int, target_week int, prediction double, own string")
    r = boards.prepare(raw, "svr").first()
    assert (r["position"], r["team"], r["opponent"], r["own"], r["missed"], r["status"], r["opportunity_basis"], r["model"]) == ("QB", "N/A", "N/A", "x", False, None, "Unavailable", "svr")
    assert boards.forecast_state(boards.prepare(raw)).first()["state"] == "rolling"
    frozen = boards.prepare(raw.withColumn("history_through_season", F.lit(2023)))
    assert boards.forecast_state(frozen).first()["state"] == "upcoming" and boards.forecast_state(frozen.withColumn("actual", F.lit(1.0))).first()["state"] == "replay"


def test_consensus_keeps_forecasts_apart_and_scorecard_of_one_model(spark):
    p = predictions(spark)
    assert boards.consensus(p.withColumn("opponent", F.when(F.col("model") == "A", "X").otherwise("Y"))).count() == 2 * boards.consensus(p).count()
    assert {r["model"] for r in boards.scorecard(p).collect()} == {"A", "B", "Consensus"}
    assert {r["model"] for r in boards.scorecard(p.where("model = 'A'")).collect()} == {"A"}


def test_consensus_takes_one_shuffle_and_holds_no_table(spark):
    """Rows are sorted, which spills, and not hashed; a model counts once, one without a name not at all, and the order of rows makes no difference."""
    p = predictions(spark).where("target_week = 1 AND player_id = '1'").drop("model", "prediction")
    told = [("A", 0.1), ("A", 1e16), (None, 0.3), ("B", -1e16), ("C", 0.7)]
    got = []
    for data in (told, told[::-1]):
        out = boards.consensus(p.limit(1).crossJoin(spark.createDataFrame(data, "model string, prediction double").coalesce(1)))
        got.append(out.select("models", "actual", F.round("spread", -15)).collect())
    assert got[0] == got[1] and [tuple(r)[:2] for r in got[0]] == [(3, 16.0)]
    plan = boards.consensus(predictions(spark))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "Aggregate" not in plan


def test_model_names_and_prediction_files(spark, tmp_path):
    from panelcast.sources import io

    for name in ("svr-predictions.parquet", "elastic-net-predictions.parquet"):
        predictions(spark).drop("model").write.parquet(str(tmp_path / name))
    got = io.read_predictions(spark, [str(tmp_path / "svr-predictions.parquet"), str(tmp_path / "elastic-net-predictions.parquet")])
    assert {r["model"] for r in got.select("model").distinct().collect()} == {"SVR", "Elastic Net"}
    predictions(spark).limit(0).write.parquet(str(tmp_path / "none.parquet"))
    for paths in ([], [str(tmp_path / "none.parquet")]):
        with pytest.raises(ValueError, match="no prediction"):
            io.read_predictions(spark, paths)


def test_metrics_need_samples(spark):
    f = spark.createDataFrame([(0.0, 1.0)], "a double, p double")
    for frame in (f, f.limit(0)):
        with pytest.raises(Exception, match="needs? a"):
            evaluate.metrics(frame, F.col("a"), F.col("p")).collect()


def test_prepare_needs_columns(spark):
    with pytest.raises(ValueError, match="prediction"):
        boards.prepare(spark.createDataFrame([(1,)], "player_id int"))


def test_metrics(spark):
    f = spark.createDataFrame([(10.0, 12.0), (0.0, 1.0), (20.0, 15.0)], "a double, p double")
    n, mae, rmse, rel = one(evaluate.metrics(f, F.col("a"), F.col("p")))
    assert (n, round(mae, 6), round(rmse, 6), round(rel, 6)) == (3, 2.666667, round((30 / 3) ** 0.5, 6), 0.225)


def test_conformal_radius(spark):
    f = spark.createDataFrame([(0.0, r) for r in (1.0, 2.0, 1.0, 2.0)], "a double, p double")
    assert one(evaluate.conformal_radius(f, F.col("a"), F.col("p"), 0.75)) == (4, 2.0)
    f = spark.createDataFrame([(0.0, float(r)) for r in range(1, 21)], "a double, p double")
    assert one(evaluate.conformal_radius(f, F.col("a"), F.col("p"), 0.9)) == (20, 20.0)


def test_splits(spark):
    f = spark.createDataFrame([(2020, w) for w in (1, 2, 3) for _ in range(2)], "season int, week int")
    assert rows(evaluate.calibration_periods(f, 0.34), "week") == [(2020, 1, False), (2020, 2, True), (2020, 3, True)]
    assert rows(evaluate.chronological_folds(f, 2), "week") == [(2020, 2, 1), (2020, 3, 2)]
    folds = evaluate.chronological_folds(f, 2)
    train, test = evaluate.fold_rows(f, folds, 2)
    assert (train.count(), test.count()) == (4, 2)
    with pytest.raises(ValueError):
        evaluate.calibration_periods(f, 1.0)


def test_contract_tells_all_problems(spark):
    f = spark.createDataFrame([(None, 5), ("g", 6)], "game_id string, gameday int")
    c = contracts.Contract("schedules", {"game_id": "text", "gameday": "date", "home_score": "number"}, ["game_id"])
    with pytest.raises(contracts.ContractError) as e:
        contracts.check_input(f, c)
    assert len(e.value.problems) == 3


def test_output_contract(spark):
    f = spark.createDataFrame([(1, None)], "a int, b string")
    schema = T.StructType([T.StructField("a", T.IntegerType()), T.StructField("b", T.StringType())])
    assert contracts.check_output(f, schema, nullable=["b"]) is f
    with pytest.raises(contracts.ContractError, match="b has nulls"):
        contracts.check_output(f, schema)


def test_files(spark, tmp_path):
    f = spark.range(5).withColumn("v", F.col("id") * 2)
    mark = io.fingerprint(f, "f").first()["fingerprint"]
    assert mark == io.fingerprint(f.orderBy(F.desc("id")), "f").first()["fingerprint"]
    io.write_dataset(f, str(tmp_path / "d"))
    assert io.read_dataset(spark, str(tmp_path / "d"), expected=mark).count() == 5
    with pytest.raises(contracts.ContractError):
        io.read_dataset(spark, str(tmp_path / "d"), expected="other")
    with pytest.raises(contracts.ContractError, match="empty"):
        io.write_dataset(f.where("id > 9"), str(tmp_path / "e"))


def test_feed(spark, tmp_path):
    import json

    athlete = lambda i, links=(): {"id": i, "displayName": "n", "team": {"abbreviation": "GB"}, "links": [{"href": x} for x in links]}
    feed = {"injuries": [{"abbreviation": "GB", "injuries": [{"status": "Out", "athlete": athlete("7")}, {"status": "Out", "athlete": athlete(None, ["http://x/id/42/y"])}, {"status": "Out", "athlete": athlete(None)}, {"athlete": athlete("9")}]}]}
    (tmp_path / "feed.json").write_text(json.dumps(feed))
    assert sorted(r["athlete_id"] for r in io.injury_feed(spark, str(tmp_path / "feed.json")).collect()) == ["42", "7"]


def test_additive_terms_add_up(spark):
    from panelcast.operators import explain, models

    f = spark.createDataFrame([(i, float(i % 7), float(i % 5), 3.0 * (i % 7 > 3) + (i % 5)) for i in range(200)], "id int, x double, y double, target double")
    model = models.Additive(["x", "y"], "target").fit(f)
    got = explain.local_terms(model, f, ["id"]).groupBy("id").agg(F.sum("weight").alias("s"), F.first("prediction").alias("p"))
    assert got.where(F.abs(F.col("s") + model.intercept - F.col("p")) > 1e-6).count() == 0
    shap = explain.shapley_values(model, f.limit(3), f.limit(5), ["x", "y"], ["id"]).groupBy("id").agg((F.sum("value") + F.first("base")).alias("s"))
    both = shap.join(model.transform(f.limit(3)).select("id", "prediction"), "id")
    assert both.where(F.abs(F.col("s") - F.col("prediction")) > 1e-6).count() == 0
