"""Provenance: scans that record what they read, and manifests of forecasts and archives."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import io


class Scans:
    """Reads tables of a folder and keeps every frame under the name of what was asked for (`table:seasons`), so that a manifest can name all sources."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")
        self.read: dict[str, DataFrame] = {}

    def scan(self, table: str, seasons: Sequence[int] | None = None, season: str = "season", arrival: bool = False) -> DataFrame:
        """The rows, with the order in which they arrived if that is asked for."""
        frame = io.scan(self.spark, f"{self.folder}/{table}.parquet", seasons, season)
        self.read[table if seasons is None else f"{table}:{'-'.join(map(str, seasons))}"] = frame
        return io.with_arrival(frame) if arrival else frame

    def sources(self) -> list[tuple[str, DataFrame]]:
        return sorted(self.read.items())


def forecast_manifest(scans: Scans, outputs: Sequence[tuple[str, DataFrame]], history_through_season: int, as_of: str | None, parameters: dict[str, str] | None = None) -> DataFrame:
    """Rows of every source that was read and every output, with the last season of history and the day that the forecast is of."""
    told = {"history_through_season": str(history_through_season), "forecast_as_of": as_of or ""} | (parameters or {})
    return io.manifest(scans.sources(), outputs, told)


def roster_counts(forecast: DataFrame, positions: Sequence[str]) -> DataFrame:
    """position, players, teams, expected_teams: how much of each position the archive's roster covers; positions without players have 0."""
    teams = F.broadcast(forecast.agg(F.countDistinct("team").alias("expected_teams")))
    wanted = forecast.sparkSession.createDataFrame([(p,) for p in positions], "position string").crossJoin(teams)
    found = forecast.groupBy("position").agg(F.countDistinct("player_id").alias("players"), F.countDistinct("team").alias("teams"))
    zero = F.lit(0).cast("bigint")
    return wanted.join(found, "position", "left").select("position", F.coalesce("players", zero).alias("players"), F.coalesce("teams", zero).alias("teams"), "expected_teams")


def coverage_rows(forecast: DataFrame, positions: Sequence[str]) -> list[dict]:
    """Rows of role coverage for a manifest: a position's players as n_rows, the teams that have one in `parameters`."""
    told = F.to_json(F.create_map(F.lit("teams"), F.col("teams").cast("string"), F.lit("expected_teams"), F.col("expected_teams").cast("string")))
    return [{"role": "coverage", "name": r["position"], "n_rows": r["players"], "schema": None, "fingerprint": None, "parameters": r["told"]} for r in roster_counts(forecast, positions).withColumn("told", told).collect()]


def archive_manifest(scans: Scans, training: DataFrame, forecast: DataFrame, positions: Sequence[str], parameters: dict[str, str]) -> DataFrame:
    """The manifest of an archive: sources and outputs, and a row of role coverage for each position."""
    files = io.manifest(scans.sources(), [("training", training), ("forecast", forecast)], parameters)
    return files.unionByName(io.manifest_of(forecast.sparkSession, coverage_rows(forecast, positions), parameters))
