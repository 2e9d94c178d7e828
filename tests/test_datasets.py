"""Published datasets: contracts, one pass, nothing left behind; facts by season; arrival order; injury reports."""

import csv
import glob
import json
import os

import pytest
from pyspark.sql import functions as F

from panelcast.plans import archive, datasets, football
from panelcast.sources import io, publish
from panelcast.sources.contracts import ContractError
from panelcast.sources.provenance import Scans

from . import test_archive as ta
from . import test_football as tf

SEASONS = football.Seasons(2020, 2021, 2022)


def land(spark, folder):
    """The football tables as files."""
    k = "player_id string, player_display_name string, position string, season int, week int, season_type string, game_id string, team string, opponent_team string, fg_made_0_19 double, fg_made_20_29 double, fg_made_30_39 double, fg_made_40_49 double, fg_made_50_59 double, fg_made_60_ double, fg_missed double, pat_made double, pat_missed double"
    kicks = spark.createDataFrame([("k", "K One", "K", s, w, "REG", f"g{s}{w}", "GB", "LV", 1.0, 1.0, None, 1.0, 1.0, 0.0, 1.0, 3.0, 0.0) for s in (2020, 2021, 2022) for w in (1, 2)], k)
    d = "player_id string, player_display_name string, position string, position_group string, season int, week int, season_type string, game_id string, team string, opponent_team string, def_tackles_solo double, def_tackles_with_assist double, def_sacks double, def_interceptions double, def_pass_defended double, def_fumbles_forced double, def_tds double"
    backers = spark.createDataFrame([("l", "L One", "MLB", "LB", s, w, "REG", f"g{s}{w}", "LV", "GB", 5.0, 4.0, 1.0, 1.0, 1.0, 1.0, 1.0) for s in (2020, 2021, 2022) for w in (1, 2)], d)
    stats = tf.player_stats(spark).unionByName(kicks, allowMissingColumns=True).unionByName(backers, allowMissingColumns=True)
    tables = {
        "player_stats": stats, "schedules": tf.schedules(spark), "team_stats": tf.team_stats(spark),
        "players": spark.createDataFrame([("q1", "Known Name", "1990-01-01", 2020, "77"), ("r1", "R One", "1995-01-01", 2020, "78")], "gsis_id string, display_name string, birth_date string, rookie_season int, espn_id string"),
        "plays": spark.createDataFrame([("g20201", 2020, "REG", 1, "q1", None)], "game_id string, season int, season_type string, two_point_attempt int, passer_player_id string, rusher_player_id string"),
    }
    for name, frame in tables.items():
        frame.write.parquet(f"{folder}/{name}.parquet")
    return Scans(spark, folder)


@pytest.mark.parametrize("position", list(datasets.JOBS))
def test_every_position_is_published(spark, tmp_path, position):
    scans = land(spark, str(tmp_path / "in"))
    path = str(tmp_path / "out")
    told = {(r["role"], r["name"]): r for r in datasets.build(scans, position, path, SEASONS).collect()}
    assert sorted(os.listdir(path)) == ["manifest", "test", "train"]
    for name, season in (("train", 2021), ("test", 2022)):
        back = publish.read_published(spark, path, name, datasets.OUTPUTS[position])
        assert told["output", name]["n_rows"] == back.count() > 0
        assert told["output", name]["fingerprint"] == io.fingerprint(back, name).first()["fingerprint"]
        assert {r["target_season"] for r in back.select("target_season").distinct().collect()} == {season}
    assert json.loads(told["output", "test"]["parameters"])["test_year"] == "2022"
    stats = "team_stats:2020-2021-2022" if position == "dst" else "player_stats:2020-2021-2022"
    assert told["source", stats]["n_rows"] > 0
    # a second run of the same sources gives the same fingerprints, in place of the first
    again = {(r["role"], r["name"]): r["fingerprint"] for r in datasets.build(scans, position, path, SEASONS).collect()}
    assert again == {k: r["fingerprint"] for k, r in told.items()} and sorted(os.listdir(path)) == ["manifest", "test", "train"]


def test_a_broken_contract_leaves_nothing_behind(spark, tmp_path):
    path = str(tmp_path / "out")
    out = publish.Output("rows", spark.createDataFrame([], "id bigint, kind string, x double").schema, nullable=["x"], allowed={"kind": ["a", "b"]})
    rows = spark.createDataFrame([(1, "a", 1.0), (2, "b", None), (3, "a", 2.0)], out.schema)
    split = lambda frame: [(frame, {"low": (out, F.col("id") < 3), "high": (out, F.col("id") >= 3)})]
    publish.publish(split(rows), path)
    state = lambda: sorted((f, os.path.getmtime(f)) for f in glob.glob(f"{path}/**/*", recursive=True))
    before = state()
    for bad, problem in (
        (rows.union(spark.createDataFrame([(None, "a", 1.0)], out.schema)).withColumn("id", F.coalesce("id", F.lit(1))).withColumn("kind", F.when(F.col("id") > 2, "c").otherwise(F.col("kind"))), r"kind has other values than a, b \(1 rows\)"),
        (rows.withColumn("kind", F.when(F.col("id") > 1, F.col("kind"))), r"kind has nulls \(1 rows\)"),
        (rows.where("id < 3"), "rows is empty"), (rows.select("kind", "id", "x"), "wants"), (rows.withColumn("x", F.col("x").cast("float")), "wants"),
    ):
        with pytest.raises(ContractError, match=problem):
            publish.publish(split(bad), path)
        assert state() == before
    # a job that fails while it writes leaves the old folder, too
    with pytest.raises(Exception, match="boom"):
        publish.publish(split(rows.withColumn("x", F.when(F.col("id") == 2, F.raise_error(F.lit("boom"))).otherwise(F.col("x")))), path)
    assert state() == before


def test_a_frame_is_worked_out_once(spark, tmp_path):
    """Outputs, counts and fingerprints come from one pass over the frame."""
    seen = spark.sparkContext.accumulator(0)

    def watched(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield b

    out = publish.Output("rows", spark.createDataFrame([], "id bigint").schema)
    frame = spark.range(100).mapInArrow(watched, "id bigint")
    publish.publish([(frame, {"low": (out, F.col("id") < 30), "high": (out, F.col("id") >= 30)})], str(tmp_path / "out"))
    assert seen.value == 100


def test_readers_want_a_whole_folder(spark, tmp_path):
    path = str(tmp_path / "out")
    out = publish.Output("rows", spark.createDataFrame([], "id bigint").schema)
    publish.publish([(spark.range(10), {"all": (out, F.lit(True))})], path, sources=[("made", spark.range(3))])
    assert publish.read_published(spark, path, "all", out).count() == 10
    with pytest.raises(ContractError, match="no output"):
        publish.read_published(spark, path, "other")
    spark.range(9).write.mode("overwrite").parquet(f"{path}/all")
    with pytest.raises(ContractError, match="another fingerprint"):
        publish.read_published(spark, path, "all", out)
    publish.Folder(spark, path).delete("manifest")
    with pytest.raises(ContractError, match="isn't whole"):
        publish.read_published(spark, path, "all", out)


def test_quarterback_forecast_is_published(spark, tmp_path):
    folder = str(tmp_path / "in")
    scans = land(spark, folder)
    more = spark.createDataFrame([("f1", 2023, "REG", 1, "2023-09-01", "GB", "OAK", None, None)], "game_id string, season int, game_type string, week int, gameday string, home_team string, away_team string, home_score int, away_score int")
    more.write.mode("append").parquet(f"{folder}/schedules.parquet")
    charts = spark.createDataFrame([("2023-08-30", 2023, t, "a", "q1", "QB", 1) for t in ("GB", "OAK")], "dt string, season int, team string, player_name string, gsis_id string, pos_abb string, pos_rank int")
    charts.write.parquet(f"{folder}/depth_charts.parquet")
    scans = Scans(spark, folder)
    scans.spark.conf.set("spark.sql.parquet.mergeSchema", "true")
    try:
        told = datasets.build_forecast(scans, str(tmp_path / "out"), football.Seasons(2020, 2021, 2023), "2023-12-31")
    finally:
        spark.conf.unset("spark.sql.parquet.mergeSchema")
    rows = {r["name"]: r for r in told.where("role = 'output'").collect()}
    assert rows["forecast"]["n_rows"] == 2 and rows["training"]["n_rows"] == 4
    got = publish.read_published(spark, str(tmp_path / "out"), "forecast", datasets.QB_FORECAST).collect()
    assert {r["forecast_as_of"] for r in got} == {"2023-08-31"} and all(r["fantasy_points"] is None for r in got)


def land_archive(spark, folder):
    """The archive's tables as files, of seasons 2020 to 2023; the last has no games played."""
    cols = "season int, week int, season_type string, game_id string, team string, opponent_team string, def_sacks double, def_interceptions double, fumble_recovery_opp double, def_tds double, special_teams_tds double, def_safeties double, def_punt_blocks double, def_pat_blocks double, def_fg_blocks double"
    defense = spark.createDataFrame([(s, 1, "REG", f"g{s}", t, o, 3.0, 1.0, 1.0, 0.0, 1.0, 0.0, 0.0, 0.0, 0.0) for s in (2020, 2021, 2022) for t, o in (ta.TEAMS, ta.TEAMS[::-1])], cols)
    charts = spark.createDataFrame([(f"{s}-08-30", s, t, f"{t} {p}", f"{t}{p}", "PK" if p == "K" else p, 1) for s in (2022, 2023) for t in ta.TEAMS for p in ("QB", "RB", "WR", "TE", "K")], "dt string, season int, team string, player_name string, gsis_id string, pos_abb string, pos_rank int")
    none = "gsis_id string, season int, week int, game_type string"
    tables = {
        "player_stats": ta.players(spark), "team_stats": defense, "schedules": ta.schedules(spark).withColumn("gameday", F.concat("season", F.lit("-09-05"))), "depth_charts": charts,
        "injuries": spark.createDataFrame([("GBQB", 2022, 1, "REG", "Out")], none + ", report_status string"), "rosters_weekly": spark.createDataFrame([], none + ", status string"),
    }
    for name, frame in tables.items():
        frame.write.mode("overwrite").parquet(f"{folder}/{name}.parquet")
    return Scans(spark, folder)


def test_archive_of_facts_by_season(spark, tmp_path):
    folder, facts, out = (str(tmp_path / x) for x in ("in", "facts", "out"))
    scans = land_archive(spark, folder)
    assert datasets.store_facts(scans, facts, [2020, 2021, 2022]) == [2020, 2021, 2022]
    files = {s: set(glob.glob(f"{facts}/season={s}/*.parquet")) for s in (2020, 2021, 2022)}
    # a season that is built again replaces its own folder alone
    assert datasets.store_facts(scans, facts, [2021]) == [2020, 2021, 2022]
    now = {s: set(glob.glob(f"{facts}/season={s}/*.parquet")) for s in (2020, 2021, 2022)}
    assert now[2020] == files[2020] and now[2022] == files[2022] and not now[2021] & files[2021]
    key = lambda f: sorted(map(str, f.select(*archive.FACTS).collect()))
    whole = archive.facts(*(scans.scan(t) for t in ("player_stats", "team_stats", "schedules")))
    assert key(datasets.stored_facts(spark, facts)) == key(whole.withColumns({c: F.col(c).cast(datasets.FACT_SCHEMA[c].dataType) for c in archive.FACTS}))
    plan = datasets.stored_facts(spark, facts, before=2022)._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(season" in plan and "season#" in plan.split("PartitionFilters:")[1].split("PushedFilters")[0]
    assert len(datasets.stored_facts(spark, facts, before=2022, first=2021).inputFiles()) == len(now[2020] | now[2021] | now[2022])  # files are pruned when the plan runs
    assert {r["season"] for r in datasets.stored_facts(spark, facts, before=2022, first=2021).collect()} == {2021}
    done = datasets.build_archive(scans, facts, out, 2022, 2023, completed=2022)
    assert sorted(done) == [2022, 2023] and sorted(os.listdir(out)) == ["2022", "2023"]
    told = {(r["role"], r["name"]): r for r in done[2023].collect()}
    assert told["output", "training"]["n_rows"] == 24 and told["output", "forecast"]["n_rows"] == 12 and told["coverage", "QB"]["n_rows"] == 2
    assert json.loads(told["output", "forecast"]["parameters"])["forecast_as_of"] == "2023-09-04" and ("source", "facts") in told
    assert ("source", "injuries:2022") not in told
    past = publish.read_published(spark, f"{out}/2022", "forecast", datasets.ARCHIVE_FORECAST)
    got = {r["player_id"]: r for r in past.collect()}
    assert got["GBQB"]["fantasy_points"] == 22.0 and got["GBQB"]["injury_status"] == "Out" and got["GBQB"]["injury_missed_game"] is False
    trained = publish.read_published(spark, f"{out}/2023", "training", datasets.ARCHIVE_TRAINING)
    assert {(r["target_season"], r["forecast_as_of"]) for r in trained.select("target_season", "forecast_as_of").distinct().collect()} == {(2021, "2021-09-04"), (2022, "2022-09-04")}


INJURIES = "season int, week int, game_type string, team string, gsis_id string, full_name string, report_status string, report_primary_injury string"


def test_the_last_report_to_arrive_counts(spark, tmp_path):
    rows = [(2020, 3, "REG", "GB", "q1", "Q", "Out", "Knee"), (2020, 3, "REG", "GB", "r1", "R", "Questionable", None), (2020, 3, "REG", "GB", "q1", "Q", "Questionable", "Knee")]
    told = lambda frame: {r["entity"]: r["status"] for r in football.injury_reports(frame).collect()}
    # in a frame's own order, over partitions
    assert told(spark.createDataFrame(rows, INJURIES)) == {"q1": "Questionable", "r1": "Questionable"}
    assert told(spark.createDataFrame(rows[::-1], INJURIES).coalesce(1)) == {"q1": "Out", "r1": "Questionable"}
    # in files: rows of one, and a later file after an earlier one, whichever Spark reads first
    path = str(tmp_path / "injuries.parquet")
    spark.createDataFrame(rows, INJURIES).coalesce(1).write.parquet(path)
    assert told(io.with_arrival(spark.read.parquet(path)))["q1"] == "Questionable"
    big = spark.createDataFrame([(2020, 4, "REG", "GB", f"x{k}", "X", "Out", None) for k in range(2000)] + [(2020, 3, "REG", "GB", "q1", "Q", "Doubtful", "Knee")], INJURIES)
    big.coalesce(1).write.mode("append").parquet(path)
    assert told(io.with_arrival(spark.read.parquet(path)))["q1"] == "Doubtful"


def test_a_corrected_game_takes_the_place_of_the_first(spark):
    stats = tf.player_stats(spark).where("player_id = 'r1'")
    fixed = stats.where("season = 2021 and week = 1").withColumn("rushing_yards", F.lit(99.0))
    got = football.receiving_features(stats.union(fixed), tf.schedules(spark), tf.team_stats(spark)).where("target_season = 2021 and target_week = 2").first()
    assert got["receiving_last_1_rushing_yards"] == 99.0


def test_one_shuffle_for_a_panel(spark):
    """The newest row of a key and all of its history share one exchange and one sort by entity."""
    plan = football.kicker_features(spark.createDataFrame([], ",".join(f"{c} double" for c in ("fg_made_0_19", "fg_made_20_29", "fg_made_30_39", "fg_made_40_49", "fg_made_50_59", "fg_made_60_", "fg_missed", "pat_made", "pat_missed")) + ", season int, week int, season_type string, game_id string, player_id string, player_display_name string, position string"))
    text = plan._jdf.queryExecution().executedPlan().toString()
    assert text.count("Exchange ") == 1, text


def test_injury_report_and_snapshot(spark, tmp_path):
    folder = str(tmp_path / "in")
    scans = land(spark, folder)
    reports = [(2020, 2, "REG", "GB", "q1", "Q", "Questionable", "Knee"), (2021, 3, "REG", "GB", "q1", "Q", "Out", "Knee"), (2021, 2, "REG", "GB", "r1", "R", "Doubtful", None), (2021, 2, "REG", "GB", "zz", "Z", "Out", None)]
    spark.createDataFrame(reports, INJURIES).write.parquet(f"{folder}/injuries.parquet")
    told = datasets.injury_report(scans, str(tmp_path / "impact"), 2020, 2022)
    assert (told["events"], told["played_while_reported"], told["missed_games"]) == (3, 2, 1)
    rows = [r for f in glob.glob(f"{tmp_path}/impact/*.csv") for r in csv.DictReader(open(f))]
    assert {(r["entity"], r["season"], r["week"], r["position"], r["played"]) for r in rows} == {("q1", "2020", "2", "QB", "true"), ("q1", "2021", "3", "QB", "false"), ("r1", "2021", "2", "RB", "true")}
    only = datasets.injury_report(scans, str(tmp_path / "some"), 2020, 2022, positions=("RB",))
    assert only["events"] == 1
    assert datasets.injury_report(scans, str(tmp_path / "none"), 2022, 2022)["events"] == 0
    feed = {"injuries": [{"abbreviation": "GB", "injuries": [
        {"status": "Out", "date": "2024-10-01", "details": {"type": "Knee"}, "athlete": {"id": "77", "displayName": "Known", "team": {"abbreviation": "GB"}}},
        {"status": "Out", "athlete": {"displayName": "By link", "links": [{"href": "x/id/78/y"}]}}, {"status": "Questionable", "athlete": {"id": "1", "displayName": "Stranger"}}, {"athlete": {"id": "77"}},
    ]}]}
    (tmp_path / "feed.json").write_text(json.dumps(feed))
    told = datasets.injury_snapshot(scans, str(tmp_path / "feed.json"), str(tmp_path / "now"))
    assert (told["players"], told["records_seen"], told["by_status"]) == (2, 3, {"Out": 2})
    rows = [r for f in glob.glob(f"{tmp_path}/now/*.csv") for r in csv.DictReader(open(f))]
    assert {(r["player_id"], r["status"]) for r in rows} == {("q1", "Out"), ("r1", "Out")}


def test_required_values(spark):
    from panelcast.functions.scalar import required

    rows = spark.createDataFrame([("a", "x"), ("b", " ")], "name string, v string")
    assert rows.where("name = 'a'").select(required(F.col("v"), "the value")).first()[0] == "x"
    with pytest.raises(Exception, match="the value is required"):
        rows.select(required(F.col("v"), "the value")).collect()
    with pytest.raises(Exception, match="v of b is required"):
        rows.select(required(F.col("v"), F.concat(F.lit("v of "), "name"))).collect()
