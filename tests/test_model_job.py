import os
import threading

import pytest
from pyspark.sql import functions as F

from panelcast.operators import boards, evaluate, explain, models
from panelcast.plans import datasets, model_job
from panelcast.sources import document, io, provenance
from panelcast.sources.contracts import ContractError

from . import test_datasets


def test_search_space_and_subset(spark):
    points = model_job.search_space()
    assert len(points) == 260 == len({tuple(sorted(p.items())) for p in points})
    assert {k: sum(p["kernel"] == k for p in points) for k in ("rbf", "linear", "sigmoid", "poly")} == {"rbf": 60, "linear": 20, "sigmoid": 60, "poly": 120}
    names = [f"f{k}" for k in range(34)]
    assert model_job.manual_features(names)[:8] == ["f0", "f1", "f2", "f3", "f4", "f5", "f8", "f9"] and len(model_job.manual_features(names)) == 26
    with pytest.raises(ValueError, match="needs 34"):
        model_job.manual_features(names[:33])
    assert len(set(model_job.search_points())) == 260 and len(model_job.COHORT_2014) == len(set(model_job.COHORT_2014)) == 24


def test_job_writes_predictions_and_diagnostics(spark, tmp_path):
    rows = spark.range(240).select(
        F.concat(F.lit("p"), (F.col("id") % 12).cast("string")).alias("player_id"), (F.lit(2010) + F.expr("id div 48")).cast("bigint").alias("season"), (F.expr("id div 12") % 4 + 1).cast("bigint").alias("week"), F.lit("QB").alias("position"),
        (F.col("id") % 7).cast("double").alias("x"), (F.col("id") % 5).cast("double").alias("z"))
    rows = rows.withColumn("points", 3 * F.col("x") + F.col("z") + 1 + (F.col("week") - 2) * 0.1)
    train, test = rows.where("season < 2014"), rows.where("season = 2014")
    grid = [(f"r{r}", models.robust_linear(["x", "z"], "points", regularisation=r)) for r in (5.0, 0.0001)]
    path = str(tmp_path / "run")
    got = model_job.train_predict_evaluate(train, test, grid, ["x", "z"], "points", ["player_id", "season", "week"], path, folds=2, categories=("position", "week"), numbers=("x",), samples=3, background=5, repeats=2, bins=4)
    assert got["model"] == "r0.0001" and len(got["scores"]) == 2
    told = spark.read.parquet(f"{path}/predictions")
    assert told.count() == 48 and told.where("prediction_lower <= points and points <= prediction_upper").count() >= 40
    # the interval is that of the model that predicts: fitted before the last fifth of the periods, whose residuals give the radius
    early, late = train.where("season < 2013"), train.where("season = 2013")  # four of 16 periods
    model = dict(grid)["r0.0001"].fit(early)
    radius = evaluate.conformal_radius(model.transform(late), F.col("points"), F.col("prediction"), 0.9).first()["radius"]
    width = told.select(((F.col("prediction_upper") - F.col("prediction_lower")) / 2).alias("r")).distinct().collect()
    assert all(r["r"] == pytest.approx(radius) for r in width)
    assert {r["player_id"]: r["prediction"] for r in told.where("week = 1").collect()} == pytest.approx({r["player_id"]: r["prediction"] for r in model.transform(test.where("week = 1")).collect()})
    back = document.read_document(spark, f"{path}/diagnostics", got["schema"])
    assert set(back) == {"interval", "metrics", "errors", "effects", "importance", "shapley", "cohorts", "quantiles"}
    assert back["metrics"].first()["mae"] < 1 and back["interval"].first()["radius"] == pytest.approx(radius)
    assert {r["feature"] for r in back["importance"].collect()} == {"x", "z"} and all(f.count() > 0 for f in back.values())
    assert {"player_id", "season", "week", "feature", "value", "base"} == set(back["shapley"].columns)
    assert model_job.cohort(told, ["p3"]).count() == 4


def test_document_round_trip(spark, tmp_path):
    parts = {
        "curves": spark.createDataFrame([("x", 1, 0.1, [1.0, 2.0]), ("x", 2, None, []), ("a \"b\"", 1, 1 / 3, None)], "feature string, bin int, effect double, edges array<double>"),
        "rows": spark.createDataFrame([("p", ("GB", 3), 2**60)], "id string, who struct<team:string,week:int>, n bigint"), "none": spark.createDataFrame([], "x double"),
    }
    path = str(tmp_path / "doc")
    document.write_document(parts | {"holes": spark.createDataFrame([(float("nan"),)], "x double")}, path)
    back = document.read_document(spark, path, document.schema_of(parts))
    assert set(back) == set(parts)
    for name, frame in parts.items():
        assert back[name].schema.simpleString() == frame.schema.simpleString() and sorted(back[name].collect(), key=str) == sorted(frame.collect(), key=str)
    assert document.read_document(spark, path, document.schema_of({"holes": spark.range(0).selectExpr("0D as x")}))["holes"].first()["x"] is None
    with pytest.raises(Exception):
        document.read_document(spark, path, document.schema_of({"curves": spark.range(0).selectExpr("0 as feature, 'a' as bin")}))["curves"].collect()


def test_a_document_has_a_bound(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(document, "MOST_ROWS", 10)
    document.write_document({"rows": spark.range(10)}, str(tmp_path / "ten"))
    with pytest.raises(Exception, match="more than 10 rows"):
        document.write_document({"rows": spark.range(11)}, str(tmp_path / "more"))


def test_fits_side_by_side(spark):
    """The same choice as one after the other, with several fits under way at once."""
    rows = spark.range(300).select((F.lit(2010) + F.expr("id div 100")).cast("int").alias("season"), (F.expr("id div 20") % 5).cast("int").alias("week"), (F.col("id") % 7).cast("double").alias("x"))
    rows = rows.withColumn("y", 2 * F.col("x") + F.col("week"))
    now, most, lock = [0], [0], threading.Lock()

    class Watched:
        def __init__(self, inner):
            self.inner = inner

        def fit(self, frame):
            with lock:
                now[0] += 1
                most[0] = max(most[0], now[0])
            try:
                return self.inner.fit(frame)
            finally:
                with lock:
                    now[0] -= 1

    grid = [(f"r{r}", Watched(models.robust_linear(["x"], "y", regularisation=r))) for r in (1.0, 0.001, 0.1)]
    alone = models.grid_select(rows, grid, "y", folds=3, side_by_side=1)
    assert most[0] == 1
    both = models.grid_select(rows, grid, "y", folds=3, side_by_side=4)
    assert [n for n, _ in both] == [n for n, _ in alone] and [s for _, s in both] == pytest.approx([s for _, s in alone]) and most[0] > 1

    class Broken:
        def fit(self, frame):
            raise ValueError("can't be fitted")

    with pytest.raises(ValueError, match="can't be fitted"):
        models.grid_select(rows, [*grid, ("broken", Broken())], "y", folds=3)


def test_permutation_stays_in_a_season(spark):
    """Values move within their season alone, each is given once, and by another row in each repeat."""
    for n in (1, 2, 7, 1000):
        rank = spark.range(n).select("id", *(explain.giver(F.col("id"), F.lit(n).cast("bigint"), m).alias(f"g{k}") for k, m in enumerate(explain.multipliers(4, 42)))).collect()
        for k in range(4):
            assert sorted(r[f"g{k}"] for r in rank) == list(range(n))
        assert n < 8 or len({tuple(r[f"g{k}"] for r in rank) for k in range(4)}) == 4
    p = explain.multipliers(1, 42)[0][0]
    some = [r[0] for r in spark.range(0, 2 * p, 1000).select(explain.giver(F.col("id"), F.lit(2 * p).cast("bigint"), explain.multipliers(1, 42)[0])).collect()]
    assert len(set(some)) == len(some)  # the first factor divides this size, so that the second is taken

    class Far:
        def transform(self, rows):
            return rows.withColumn("prediction", F.col("x"))

    rows = spark.range(200).select((F.lit(2010) + F.col("id") % 2).alias("season"), F.col("id").alias("k")).withColumn("x", F.when(F.col("season") == 2010, 5.0).otherwise(1000.0)).withColumn("y", F.col("x"))
    got = explain.permutation_importance(Far(), rows, ["x"], "y").collect()
    assert [(r["feature"], r["importance"], r["deviation"]) for r in got] == [("x", 0.0, 0.0)]


def test_position_models_from_published_datasets(spark, tmp_path):
    scans = test_datasets.land(spark, str(tmp_path / "in"))
    for position, kind, how in (("k", "svr", {}), ("qb", "svr", {"manual": True}), ("k", "additive", {"settings": {"bins": 4, "rounds": 2, "bags": 1, "pairs": 1, "validation": 0.0}, "calibration": 0.5})):
        folder, path = str(tmp_path / f"data-{position}"), str(tmp_path / f"{position}-{kind}")
        if not os.path.exists(folder):
            datasets.build(scans, model_job.POSITIONS[position], folder, test_datasets.SEASONS)
        got = model_job.train_position(spark, folder, position, path, kind, samples=2, background=2, repeats=1, bins=2, **how)
        told = spark.read.parquet(f"{path}/predictions")
        assert told.count() == 2 and ("prediction_lower" in told.columns) == (kind == "additive") and {"player_id", "target_week", "fantasy_points"} <= set(told.columns)
        assert len(got["features"]) == (26 if position == "qb" else 12)
        back = document.read_document(spark, f"{path}/diagnostics", got["schema"])
        assert back["shapley"].count() == 2 * len(got["features"]) and ("interval" in back) == ("terms" in back) == (kind == "additive")
        if kind == "additive":
            terms = spark.read.json(f"{path}/local_terms").groupBy("target_week").agg((F.sum("weight") + F.first("intercept") - F.first("prediction")).alias("d"), F.count(F.lit(1)).alias("n")).collect()
            assert len(terms) == 2 and all(abs(r["d"]) < 1e-9 and r["n"] == 13 for r in terms)
    with pytest.raises(ValueError, match="quarterbacks"):
        model_job.train_position(spark, folder, "k", str(tmp_path / "no"), manual=True)
    with pytest.raises(Exception, match="wants"):
        model_job.train_position(spark, folder, "qb", str(tmp_path / "no"))


def test_forecast_to_boards(spark, tmp_path):
    """Facts, archive, projection, prediction files and boards, with every result under the names that files have."""
    scans = test_datasets.land_archive(spark, str(tmp_path / "in"))
    facts, out = str(tmp_path / "facts"), str(tmp_path / "out")
    datasets.store_facts(scans, facts, [2020, 2021, 2022])
    scans.spark.createDataFrame([("GBQB", 2022, 1, "REG", "Out"), ("gone", 2022, 1, "REG", "Out")], "gsis_id string, season int, week int, game_type string, report_status string").write.mode("overwrite").parquet(f"{scans.folder}/injuries.parquet")
    charts = spark.read.parquet(f"{scans.folder}/depth_charts.parquet")
    more = charts.union(spark.createDataFrame([("2022-08-30", 2022, "GB", "Gone RB", "gone", "RB", 2)], charts.schema)).collect()
    spark.createDataFrame(more, charts.schema).write.mode("overwrite").parquet(f"{scans.folder}/depth_charts.parquet")
    datasets.build_archive(scans, facts, out, 2022, 2023, completed=2022)
    linear = model_job.project_forecast(spark, f"{out}/2022", str(tmp_path / "svr"), "svr")
    trees = model_job.project_forecast(spark, f"{out}/2022", str(tmp_path / "trees"), "trees", rounds=2, depth=2)
    assert linear["metrics"]["n"] == 12 and linear["target_year"] == 2022 and linear["history_through_season"] == 2021 and trees["forecast_rows"] == 13
    ahead = model_job.project_forecast(spark, f"{out}/2023", str(tmp_path / "next"), "svr")
    assert ahead["metrics"] is None and ahead["forecast_rows"] == 12
    files = io.read_predictions(spark, [str(tmp_path / "svr" / "predictions"), str(tmp_path / "trees" / "predictions")])
    files = files.withColumn("model", F.when(F.input_file_name().contains("/svr/"), "SVR").otherwise("TREES"))
    both = boards.prepare(files, results=True)
    assert both.where("actual is not null").count() == 24 and {r["player_id"] for r in both.where("missed").collect()} == {"gone"}
    assert both.where("player_id = 'gone'").first()["status"] == "Out"
    state = boards.forecast_state(both).first()
    assert (state["state"], state["n_actual"], state["history_through"]) == ("replay", 24, 2021)
    board = {r["player_id"]: r for r in boards.draft_board(boards.choose_model(both, "Consensus"), 2022).collect()}
    assert board["GBQB"]["actual_points"] == 22.0 and board["gone"]["injury_games"] == 1 and board["GBRB"]["opportunity_basis"] == "Depth-chart estimate"
    assert {r["model"]: r["samples"] for r in boards.scorecard(both).collect()} == {"SVR": 12, "TREES": 12, "Consensus": 12}
    assert {r["player_id"] for r in boards.player_history(both, ["GBQB", "gone"], 2022).collect()} == {"GBQB", "gone"}
    upcoming = boards.prepare(spark.read.parquet(str(tmp_path / "next" / "predictions")))
    assert boards.forecast_state(upcoming).first()["state"] == "upcoming"
    with pytest.raises(ValueError, match="actual or fantasy_points"):
        boards.prepare(upcoming.select("player_id", "player_name", "target_season", "target_week", "prediction"), results=True)


def test_tables_are_told_apart_by_what_they_hold(spark, tmp_path):
    scans = test_datasets.land(spark, str(tmp_path / "in"))
    datasets.build(scans, "kicker", str(tmp_path / "k"), test_datasets.SEASONS)
    assert datasets.read_table(spark, str(tmp_path / "k" / "train")).count() == 2
    assert datasets.kind_of(["x", "player_history_through_season"], outcomes=False) is datasets.ARCHIVE_FORECAST
    assert datasets.kind_of(["qb_history_through_season"]) is datasets.OUTPUTS["qb"]
    with pytest.raises(ContractError, match="is a forecast"):
        datasets.kind_of(["qb_history_through_season", "forecast_as_of"])
    with pytest.raises(ContractError, match="has none of"):
        datasets.kind_of(["x"])
    spark.read.parquet(str(tmp_path / "k" / "train")).withColumn("fantasy_points", F.lit(None).cast("double")).write.parquet(str(tmp_path / "bad"))
    with pytest.raises(ContractError, match="fantasy_points has nulls"):
        datasets.read_table(spark, str(tmp_path / "bad"))


def test_provenance_and_manifests(spark, tmp_path):
    stats = spark.createDataFrame([("a", "QB", "X", 2020, 1.0), ("b", "QB", "Y", 2021, 2.0), ("c", "RB", "X", 2021, 3.0)], "player_id string, position string, team string, season int, points double")
    stats.write.parquet(str(tmp_path / "stats.parquet"))
    scans = provenance.Scans(spark, str(tmp_path))
    some = scans.scan("stats", [2021])
    whole = scans.scan("stats")
    assert (some.count(), whole.count()) == (2, 3)
    m = provenance.forecast_manifest(scans, [("forecast", some)], 2021, "2022-09-01")
    io.write_diagnostics(m, str(tmp_path / "manifest"))
    back = io.read_manifest(spark, str(tmp_path / "manifest"))
    assert {(r["role"], r["name"], r["n_rows"]) for r in back.collect()} == {("source", "stats", 3), ("source", "stats:2021", 2), ("output", "forecast", 2)}
    assert '"history_through_season":"2021"' in back.first()["parameters"] and '"forecast_as_of":"2022-09-01"' in back.first()["parameters"]
    prints = {r["name"]: r["fingerprint"] for r in back.collect()}
    assert prints["stats:2021"] == prints["forecast"] != prints["stats"]
    archive = provenance.archive_manifest(scans, whole, some, ["QB", "RB", "WR"], {"target": "2021"})
    assert {(r["name"], r["n_rows"], r["parameters"]) for r in archive.where("role = 'coverage'").collect()} == {
        ("QB", 1, '{"teams":"1","expected_teams":"2"}'), ("RB", 1, '{"teams":"1","expected_teams":"2"}'), ("WR", 0, '{"teams":"0","expected_teams":"2"}')}
