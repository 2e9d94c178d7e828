"""The football jobs as published datasets: each reads its sources, writes its tables under their contracts in one pass, and a manifest last.

Facts that many seasons' jobs read are stored by season: a season is replaced alone, and a job reads the folders of its seasons only.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.scalar import as_day
from ..operators import asof
from ..sources import io
from ..sources.contracts import ContractError, check_output
from ..sources.provenance import Scans, coverage_rows
from ..sources.publish import Folder, Output, publish
from . import archive, football


def _table(text: Sequence[str], whole: Sequence[str], numbers: Sequence[str], order: Sequence[str]) -> T.StructType:
    kinds = dict.fromkeys(text, T.StringType()) | dict.fromkeys(whole, T.LongType()) | dict.fromkeys(numbers, T.DoubleType())
    return T.StructType([T.StructField(c, kinds[c]) for c in order])


def _features(name: str, identity: Sequence[str], prefixes: Sequence[str], more: Sequence[str] = ()) -> Output:
    """Identity, the key of the target, how far each history reaches, features and the target; nothing is null."""
    lineage = [f"{p}_history_through_{x}" for p in prefixes for x in ("season", "week")]
    numbers = [*more, *(c for p in prefixes for c in football._features(p)), "fantasy_points"]
    order = [*identity, *football.PERIOD, "target_game_id", *lineage, *numbers]
    return Output(name, _table([*identity, "target_game_id"], [*football.PERIOD, *lineage], numbers, order))


OUTPUTS = {
    "qb": _features("quarterback features", ["player_id", "player_name"], ["qb", "defense"], ["age", "years_pro"]),
    "dst": _features("defense features", ["team"], ["dst"]),
    "kicker": _features("kicker features", ["player_id", "player_name"], ["kicker"]),
    "receiving": _features("receiving features", ["player_id", "player_name", "position", "team", "opponent"], ["receiving", "defense"]),
    "idp": _features("defender features", ["player_id", "player_name", "position_group"], ["idp"]),
}
_FROZEN = [*football.PERIOD, "history_through_season", *(f"{p}_history_through_{x}" for p in ("qb", "defense") for x in ("season", "week"))]
QB_FORECAST = Output(
    "quarterback forecast",
    _table(
        ["player_id", "player_name", "position", "team", "opponent", "target_game_id", "forecast_as_of"], _FROZEN, [c for c in OUTPUTS["qb"].schema.names if isinstance(OUTPUTS["qb"].schema[c].dataType, T.DoubleType)],
        ["player_id", "player_name", "position", "team", "opponent", *football.PERIOD, "target_game_id", "forecast_as_of", *_FROZEN[2:], *(c for c in OUTPUTS["qb"].schema.names if isinstance(OUTPUTS["qb"].schema[c].dataType, T.DoubleType))],
    ),
    nullable=["fantasy_points"],
)
#: The model features of all positions, in their order.
POSITION_FEATURES = (
    "player_last_1_points", "player_last_5_points", "player_last_10_points", "player_previous_season_ppg", "player_previous_season_games", "player_career_ppg", "player_career_games",
    "team_position_ppg", "opponent_position_points_allowed", "target_week_normalized", "is_home", *(f"position_{p.lower()}" for p in archive.POSITIONS),
    "player_last_1_target_share", "player_last_5_target_share", "player_last_10_target_share", "player_last_1_carry_share", "player_last_5_carry_share", "player_last_10_carry_share",
    *(v.replace("team_", "team_previous_season_", 1) for v in archive.VOLUME),
)
_TEXT = ["player_id", "player_name", "position", "team", "opponent", "target_game_id", "forecast_as_of", "injury_status"]
_WHOLE = [*football.PERIOD, "history_through_season", "player_history_through_season", "opponent_history_through_season"]
_ARCHIVE = T.StructType([
    T.StructField(c, T.BooleanType() if c == "injury_missed_game" else T.StringType() if c in _TEXT else T.LongType() if c in _WHOLE else T.DoubleType())
    for c in (
        "player_id", "player_name", "position", "team", "opponent", *football.PERIOD, "target_game_id", "forecast_as_of", "history_through_season", "injury_status", "injury_missed_game",
        "player_history_through_season", "opponent_history_through_season", *POSITION_FEATURES, "projected_target_share", "projected_carry_share", "fantasy_points",
    )
])
ARCHIVE_TRAINING = Output("archive training", _ARCHIVE, nullable=["injury_status"], allowed={"position": archive.POSITIONS})
ARCHIVE_FORECAST = Output("archive forecast", _ARCHIVE, nullable=["injury_status", "fantasy_points"], allowed={"position": archive.POSITIONS})


#: Marker columns of written tables, the most telling first: (columns, with outcomes, without).
KINDS = (
    (("player_history_through_season",), ARCHIVE_TRAINING, ARCHIVE_FORECAST),
    (("qb_history_through_season", "forecast_as_of"), None, QB_FORECAST),
    (("qb_history_through_season",), OUTPUTS["qb"], None),
    (("dst_history_through_season",), OUTPUTS["dst"], None),
    (("kicker_history_through_season",), OUTPUTS["kicker"], None),
    (("receiving_history_through_season",), OUTPUTS["receiving"], None),
    (("idp_history_through_season",), OUTPUTS["idp"], None),
)


def kind_of(columns: Sequence[str], outcomes: bool = True) -> Output:
    """The contract of a table by what it holds. `outcomes`: as a table to train on, which must have them, or as a forecast, which may lack them."""
    for markers, trained, frozen in KINDS:
        if set(markers) <= set(columns):
            found = trained if outcomes else frozen
            if found is None:
                raise ContractError(", ".join(markers), ["is a forecast, not a table to train on" if outcomes else "is no forecast"])
            return found
    raise ContractError("table", [f"has none of {', '.join(m[0] for m, *_ in KINDS)}"])


def read_table(spark: SparkSession, path: str, outcomes: bool = True) -> DataFrame:
    """A written table under the contract that its marker columns call for."""
    frame = spark.read.parquet(path)
    output = kind_of(frame.columns, outcomes)
    return check_output(frame, output.schema, output.nullable, output.name, output.allowed)


@dataclass(frozen=True)
class Job:
    """A position's features: how they are made, and of which tables by season and which without."""

    make: Callable[..., DataFrame]
    seasonal: Sequence[str]
    whole: Sequence[str] = field(default=())


JOBS = {
    "qb": Job(lambda t, **o: football.quarterback_features(t["player_stats"], t["schedules"], t["team_stats"], t["players"], t["plays"], **o), ["player_stats", "schedules", "team_stats", "plays"], ["players"]),
    "dst": Job(lambda t, **o: football.defense_features(t["team_stats"], t["schedules"], **o), ["team_stats", "schedules"]),
    "kicker": Job(lambda t, **o: football.kicker_features(t["player_stats"], **o), ["player_stats"]),
    "receiving": Job(lambda t, **o: football.receiving_features(t["player_stats"], t["schedules"], t["team_stats"], **o), ["player_stats", "schedules", "team_stats"]),
    "idp": Job(lambda t, **o: football.defender_features(t["player_stats"], **o), ["player_stats"]),
}


def build(scans: Scans, position: str, path: str, seasons: football.Seasons = football.Seasons(2009, 2010, 2014), **options) -> DataFrame:
    """One position's `train` and `test` in `path`, from one scan of its sources; gives the manifest. `options` go to the position's features (weights, least attempts, ...)."""
    job, out = JOBS[position], OUTPUTS[position]
    years = range(seasons.history, seasons.test + 1)
    tables = {t: scans.scan(t, years, arrival=True) for t in job.seasonal} | {t: scans.scan(t) for t in job.whole}
    features, season = job.make(tables, **options), F.col("target_season")
    outputs = {"train": (out, (season >= seasons.train) & (season < seasons.test)), "test": (out, season == seasons.test)}
    told = {"position": position, "history_start": seasons.history, "train_start": seasons.train, "test_year": seasons.test} | options
    return publish([(features, outputs)], path, scans.sources(), told)


def build_forecast(scans: Scans, path: str, seasons: football.Seasons, as_of: str, outcomes: bool = False) -> DataFrame:
    """The frozen quarterback forecast: `training`, seasons from seasons.train up to the one before seasons.test, and `forecast`, the season seasons.test as of a day."""
    through, target = seasons.test - 1, seasons.test
    tables = {t: scans.scan(t, range(seasons.history, target), arrival=True) for t in JOBS["qb"].seasonal} | {"players": scans.scan("players")}
    features = football.quarterback_features(*(tables[t] for t in ("player_stats", "schedules", "team_stats", "players", "plays")))
    games = football.quarterback_games(tables["player_stats"], tables["schedules"], tables["players"], tables["plays"])
    defenses = football.defense_games(tables["team_stats"], tables["schedules"])
    season, charts = scans.scan("schedules", [target]), scans.scan("depth_charts", [target])
    played = None
    if outcomes:
        held = football.quarterback_games(scans.scan("player_stats", [target], arrival=True), season, tables["players"], scans.scan("plays", [target]))
        played = held.withColumn("fantasy_points", football.quarterback_score())
    forecast = football.quarterback_forecast(games, defenses, season, charts, tables["players"], target, through, as_of, played)
    trained = F.col("target_season").between(seasons.train, through)
    told = {"history_start": seasons.history, "train_start": seasons.train, "history_through_season": through, "target_year": target, "requested_as_of": as_of, "include_actuals": outcomes}
    return publish([(features, {"training": (OUTPUTS["qb"], trained)}), (forecast, {"forecast": (QB_FORECAST, F.lit(True))})], path, scans.sources(), told)


def store_facts(scans: Scans, path: str, years: Sequence[int]) -> list[int]:
    """The scored facts of some seasons, stored by season (`season=<year>`): their folders replace those of these years, and no other. Gives the seasons that have rows now."""
    facts = archive.facts(*(scans.scan(t, years) for t in ("player_stats", "team_stats", "schedules")))
    io.write_partitions(facts, path, "season")
    return sorted(int(n.removeprefix("season=")) for n in Folder(facts.sparkSession, path).names() if n.startswith("season="))


FACT_SCHEMA = T.StructType([
    T.StructField(c, T.LongType() if c in ("season", "week") else T.StringType() if c in ("player_id", "player_name", "position", "team", "opponent", "game_id") else T.DoubleType()) for c in archive.FACTS
])


def stored_facts(spark: SparkSession, path: str, before: int | None = None, first: int | None = None) -> DataFrame:
    """Stored facts, of seasons from `first` and before `before` alone: a filter on folders."""
    rows = spark.read.schema(FACT_SCHEMA).parquet(path).select(*archive.FACTS)
    rows = rows if before is None else rows.where(F.col("season") < before)
    return rows if first is None else rows.where(F.col("season") >= first)


def _season_days(schedules: DataFrame, asked: str | None = None) -> DataFrame:
    """season, as_of: the day asked for, or the day before a season's first game if that is earlier or none is asked for."""
    games = schedules.where("game_type = 'REG'").select(F.col("season").cast("bigint").alias("season"), as_day(F.col("gameday")).alias("_day"))
    return asof.forecast_day(games, "_day", "season", F.lit(asked).cast("date")).select("season", F.col("as_of").cast("string").alias("as_of"))


def archive_columns(frame: DataFrame) -> DataFrame:
    """The archive's columns in their order and kinds."""
    return frame.select(*(F.col(f.name).cast(f.dataType).alias(f.name) for f in _ARCHIVE))


def build_archive(scans: Scans, facts_path: str, path: str, first: int, last: int, completed: int, as_of: str | None = None) -> dict[int, DataFrame]:
    """For each target season `training` (all played games of earlier seasons that have a season before them) and `forecast`, in `path/<season>`, with a manifest that has the coverage
    of rosters. Reads facts by season as store_facts left them; a season after `completed` has no outcomes and no reports of absences. The loop is over target seasons."""
    spark, done = scans.spark, {}
    have = [r["season"] for r in stored_facts(spark, facts_path).select("season").distinct().collect()]
    for year in range(first, last + 1):
        own = Scans(spark, scans.folder)  # what this season reads, and not what others do
        schedules, charts = own.scan("schedules", range(min(have), year + 1)), own.scan("depth_charts", [year])
        absent = archive.absences(own.scan("injuries", [year]), own.scan("rosters_weekly", [year])) if year <= completed else None
        past = stored_facts(spark, facts_path, before=year)
        known = stored_facts(spark, facts_path, before=year + 1) if year <= completed else past
        day = _season_days(schedules.where(F.col("season") == year), as_of).first()["as_of"]
        forecast = archive.forecast(known, schedules, charts, year, day, absent)
        trained = archive.training(past, sorted(y for y in have if min(have) < y < year))
        trained = trained.join(F.broadcast(_season_days(schedules).select(F.col("season").alias("target_season"), F.col("as_of").alias("forecast_as_of"))), "target_season")
        own.read["facts"] = past
        told = {"target_year": year, "history_through_season": year - 1, "forecast_as_of": day, "positions": ",".join(archive.POSITIONS), "scoring": "standard_non_ppr"}
        every = F.lit(True)
        frames = [(archive_columns(trained), {"training": (ARCHIVE_TRAINING, every)}), (archive_columns(forecast), {"forecast": (ARCHIVE_FORECAST, every)})]
        done[year] = publish(frames, f"{path}/{year}", own.sources(), told, after=lambda written: coverage_rows(written["forecast"], archive.POSITIONS))
    return done


def injury_report(scans: Scans, path: str, first: int, last: int, positions: Sequence[str] = ("QB", "RB", "WR", "TE"), window: int = 10) -> dict:
    """Impact of reported injuries of some seasons as a CSV in `path`; gives the numbers of events, of those played and of games missed. Seasons without reports have no events."""
    years = range(first, last + 1)
    stats, injuries = (scans.scan(t, years, arrival=True) for t in ("player_stats", "injuries"))
    games = []
    if "QB" in positions:
        quarterbacks = football.quarterback_games(stats, scans.scan("schedules", years), scans.scan("players"), scans.scan("plays", years)).withColumn("score", football.quarterback_score())
        games.append(quarterbacks.withColumn("position", F.lit("QB")))
    others = [p for p in positions if p != "QB"]
    if others:
        games.append(football.receiving_games(stats, scans.scan("schedules", years), others).withColumn("score", football.receiving_points()))
    pick = [F.col("player_id").alias("entity"), F.col("target_season").alias("season"), F.col("target_week").alias("week"), "position", "score"]
    every = [g.select(*pick) for g in games]
    # a player of two positions has a pace of each
    parts = [football.injury_impact(g, injuries, window).join(g.select("entity", "position").distinct(), "entity") for g in every]
    out = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
    return _told_csv(out, path, {"events": F.count(F.lit(1)), "played_while_reported": F.count_if("played"), "missed_games": F.count_if(~F.col("played"))})


def injury_snapshot(scans: Scans, feed_path: str, path: str) -> dict:
    """The landed feed of injuries with the players that are known, as a CSV in `path`; gives the numbers of players, of records seen and of each status."""
    feed = io.injury_feed(scans.spark, feed_path)
    known = football.injury_snapshot(feed, scans.scan("players"))
    told = _told_csv(known, path, {"players": F.count(F.lit(1))})
    counts = scans.spark.read.option("header", True).csv(path).groupBy("status").agg(F.count(F.lit(1)).alias("n")).collect()  # a row a status
    return told | {"records_seen": feed.count(), "by_status": {r["status"]: r["n"] for r in sorted(counts)}}


def _told_csv(frame: DataFrame, path: str, counts: Mapping[str, object]) -> dict:
    """Writes a CSV and gives what was counted in that pass."""
    seen = Observation()
    io.write_csv(frame.observe(seen, *(c.alias(k) for k, c in counts.items())), path)
    return {"output": path} | dict(seen.get)
