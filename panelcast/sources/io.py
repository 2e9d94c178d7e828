"""Files: season scans, Parquet, CSV and JSON sinks, prediction files, fingerprints and manifests."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .contracts import ContractError, check_output

MANIFEST_VERSION = 1


#: The column that tells in which order rows arrived.
ARRIVAL = "_arrival"


def scan(spark: SparkSession, path: str, seasons: Sequence[int] | None = None, season: str = "season") -> DataFrame:
    """A table's rows of some seasons; the filter reaches the scan."""
    rows = spark.read.parquet(path)
    return rows if seasons is None else rows.where(F.col(season).isin(list(seasons)))


def with_arrival(frame: DataFrame) -> DataFrame:
    """Adds ARRIVAL to a frame of files: a later file after an earlier one (by time, then path), and a later row of a file after an earlier one."""
    at = F.struct("_metadata.file_modification_time", "_metadata.file_path", "_metadata.row_index")
    return frame.select("*", at.alias(ARRIVAL))


def fingerprint(frame: DataFrame, name: str) -> DataFrame:
    """One row: name, n_rows, schema, fingerprint. Hashes of rows are added up, so that the order of rows doesn't matter."""
    h = F.xxhash64(*(F.col(f"`{c}`") for c in frame.columns))
    return frame.agg(F.count(F.lit(1)).alias("n_rows"), F.coalesce(F.sum(h.cast("decimal(38,0)")), F.lit(0)).cast("string").alias("_s"), F.coalesce(F.bit_xor(h), F.lit(0)).cast("string").alias("_x")).select(
        F.lit(name).alias("name"), "n_rows", F.lit(frame.schema.simpleString()).alias("schema"), F.sha2(F.concat_ws(":", "n_rows", "_s", "_x"), 256).alias("fingerprint"))


def write_dataset(frame: DataFrame, path: str, schema=None, nullable: Sequence[str] = ()) -> None:
    """Parquet with zstd. An empty frame is refused; the committer makes the folder appear whole."""
    if schema is not None:
        check_output(frame, schema, nullable)
    if frame.isEmpty():
        raise ContractError(path, ["is empty"])
    frame.write.mode("overwrite").option("compression", "zstd").parquet(path)


def read_dataset(spark: SparkSession, path: str, expected: str | None = None, schema=None, nullable: Sequence[str] = ()) -> DataFrame:
    """A written dataset, after its schema and, if given, its fingerprint are checked."""
    frame = spark.read.parquet(path)
    if schema is not None:
        check_output(frame, schema, nullable, path)
    if expected is not None and fingerprint(frame, path).first()["fingerprint"] != expected:
        raise ContractError(path, ["has another fingerprint than expected"])
    return frame


def write_partitions(frame: DataFrame, path: str, by: str) -> None:
    """Parquet in a folder for each value of a column (of few values). Folders of the frame's own values are replaced, others stay."""
    rows = frame.repartition(by)
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(by).option("compression", "zstd").parquet(path)


def write_csv(frame: DataFrame, path: str) -> None:
    frame.write.mode("overwrite").option("header", True).csv(path)


def write_diagnostics(frame: DataFrame, path: str) -> None:
    """JSON lines; NaN, which JSON has no sign for, is written as null."""
    clean = {f.name: F.nanvl(F.col(f.name), F.lit(None).cast(f.dataType)) for f in frame.schema if f.dataType.simpleString() in ("double", "float")}
    (frame.withColumns(clean) if clean else frame).write.mode("overwrite").json(path)


def prediction_columns(frame: DataFrame, identity: Sequence[str], context: Sequence[str] = ()) -> DataFrame:
    """Identity, the context that the frame has, and the predictions with their interval if there is one."""
    wanted = [*identity, *context, "prediction", "prediction_lower", "prediction_upper"]
    return frame.select([c for c in wanted if c in frame.columns])


def model_name(path: Column) -> Column:
    """The file's or folder's name without its ending and "-predictions", dashes as blanks: in capitals if it has up to four letters, else each word with a capital."""
    stem = F.regexp_extract(path, r"([^/]+?)(?:-predictions)?(?:\.parquet)?/?(?:part-[^/]*)?$", 1)
    name = F.trim(F.replace(F.url_decode(stem), F.lit("-"), F.lit(" ")))
    return F.when(F.length(name) <= 4, F.upper(name)).otherwise(F.initcap(name))


def read_predictions(spark: SparkSession, paths: Sequence[str]) -> DataFrame:
    """Prediction files of several models, each with its model's name from the path, and columns that only some have. No paths, and a path without rows, are errors."""
    if not paths:
        raise ValueError("no prediction files")
    frames = [spark.read.parquet(p).withColumn("model", model_name(F.lit(p))) for p in paths]
    for path, frame in zip(paths, frames, strict=True):
        if frame.isEmpty():
            raise ValueError(f"{path} holds no predictions")
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def digest(n_rows: int, total, xor) -> str:
    """A fingerprint from its pieces: rows, and the sum and exclusive-or of their hashes; none is 0."""
    return hashlib.sha256(f"{n_rows}:{0 if total is None else total}:{0 if xor is None else xor}".encode()).hexdigest()


def manifest_of(spark: SparkSession, rows: Sequence[dict], parameters: Mapping[str, object]) -> DataFrame:
    """A manifest from facts that are known already: a few rows (role, name, n_rows, schema, fingerprint, and parameters where they have their own)."""
    told = json.dumps({k: str(v) for k, v in sorted(parameters.items())}, separators=(",", ":"))
    cells = [(r["role"], r["name"], int(r["n_rows"]), r["schema"], r["fingerprint"], r.get("parameters", told), MANIFEST_VERSION) for r in rows]
    return spark.createDataFrame(cells, "role string, name string, n_rows bigint, schema string, fingerprint string, parameters string, version int")


def manifest(sources: Sequence[tuple[str, DataFrame]], outputs: Sequence[tuple[str, DataFrame]], parameters: dict[str, str]) -> DataFrame:
    """One row for each source and output: role, name, n_rows, schema, fingerprint, and the run's parameters and version."""
    rows = [fingerprint(f, n).withColumn("role", F.lit(role)) for role, many in (("source", sources), ("output", outputs)) for n, f in many]
    out = rows[0]
    for r in rows[1:]:
        out = out.unionByName(r)
    told = F.create_map(*(F.lit(str(x)) for pair in sorted(parameters.items()) for x in pair)) if parameters else F.create_map().cast("map<string,string>")
    return out.select("role", "name", "n_rows", "schema", "fingerprint", F.to_json(told).alias("parameters"), F.lit(MANIFEST_VERSION).alias("version"))


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    frame = spark.read.json(path)
    if not frame.where(F.col("version") != MANIFEST_VERSION).isEmpty():
        raise ContractError(path, ["is of another version"])
    return frame


FEED = """injuries array<struct<abbreviation:string,injuries:array<struct<status:string,shortComment:string,longComment:string,date:string,
details:struct<type:string>,athlete:struct<id:string,displayName:string,team:struct<abbreviation:string>,links:array<struct<href:string>>>>>>>"""


def injury_feed(spark: SparkSession, path: str) -> DataFrame:
    """The nested feed as flat rows: athlete_id (its id, or the one in a link), player_name, team, status, body_part, comment, reported_at. Records without an id or status are skipped."""
    teams = spark.read.schema(FEED).option("multiLine", True).option("mode", "PERMISSIVE").json(path).select(F.explode("injuries").alias("t"))
    rows = teams.select(F.col("t.abbreviation").alias("of"), F.explode("t.injuries").alias("i"))
    linked = F.nullif(F.regexp_extract(F.array_join(F.transform("i.athlete.links", lambda x: x["href"]), " "), r"/id/(\d+)", 1), F.lit(""))
    return rows.select(
        F.coalesce("i.athlete.id", linked).alias("athlete_id"), F.col("i.athlete.displayName").alias("player_name"), F.coalesce("i.athlete.team.abbreviation", "of").alias("team"), F.col("i.status").alias("status"),
        F.col("i.details.type").alias("body_part"), F.coalesce("i.shortComment", "i.longComment").alias("comment"), F.col("i.date").alias("reported_at"),
    ).where("athlete_id is not null and status is not null")


def known_players(feed: DataFrame, crosswalk: DataFrame) -> DataFrame:
    """Feed rows of players in the crosswalk (athlete_id, player_id); others are skipped."""
    return feed.join(crosswalk.where("athlete_id is not null and player_id is not null").dropDuplicates(["athlete_id"]), "athlete_id")
