"""Datasets that appear whole or not at all: written aside, checked by what was counted while they were written, moved into place, manifest last.

All outputs of one frame (train and test, say) are written by one job, partitioned by a marker; nulls, forbidden values, rows and fingerprint of each are observed in that pass,
so that no frame is worked out or read a second time. An output that breaks its contract, or is empty, leaves the folder as it was.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field
from functools import reduce
from uuid import uuid4

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import io
from .contracts import ContractError, same_schema

MANIFEST = "manifest"
_OUTPUT = "_output"


@dataclass(frozen=True)
class Output:
    """The exact schema of a written table, the columns that may be null, and the values that some may have."""

    name: str
    schema: T.StructType
    nullable: Sequence[str] = field(default=())
    allowed: Mapping[str, Sequence] = field(default_factory=dict)

    def tests(self) -> dict[str, Column]:
        """Problem -> the rows that have it."""
        found = {f"{f.name} has nulls": F.col(f"`{f.name}`").isNull() for f in self.schema if f.name not in self.nullable}
        return found | {f"{c} has other values than {', '.join(map(str, v))}": ~F.col(f"`{c}`").isin(list(v)) for c, v in self.allowed.items()}


class Folder:
    """File operations in the store of a path, whichever Hadoop reads."""

    def __init__(self, spark: SparkSession, path: str):
        self.jvm, self.path = spark.sparkContext._jvm, path.rstrip("/")
        self.fs = self._at("").getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _at(self, name: str):
        return self.jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}" if name else self.path)

    def exists(self, name: str) -> bool:
        return self.fs.exists(self._at(name))

    def names(self) -> list[str]:
        return sorted(x.getPath().getName() for x in self.fs.listStatus(self._at(""))) if self.exists("") else []

    def delete(self, name: str) -> None:
        self.fs.delete(self._at(name), True)

    def make(self, name: str) -> None:
        self.fs.mkdirs(self._at(name))

    def move(self, name: str, to: str) -> None:
        if not self.fs.rename(self._at(name), self._at(to)):
            raise OSError(f"{self.path}: {name} couldn't be moved to {to}")


def facts(frame: DataFrame, output: Output, where: Column) -> list[tuple[str, Column]]:
    """What is counted of the rows that go to an output: rows, the pieces of the fingerprint, and rows of each problem."""
    h = F.when(where, F.xxhash64(*(F.col(f"`{f.name}`") for f in output.schema)))
    pieces = [("rows", F.count_if(where)), ("sum", F.sum(h.cast("decimal(38,0)"))), ("xor", F.bit_xor(h))]
    return pieces + [(f"p{k}", F.count_if(where & test)) for k, test in enumerate(output.tests().values())]


def judge(output: Output, told: Mapping[str, object]) -> list[str]:
    if not told["rows"]:
        return [f"{output.name} is empty"]
    return [f"{output.name}: {label} ({told[f'p{k}']} rows)" for k, label in enumerate(output.tests()) if told[f"p{k}"]]


def fingerprint_of(told: Mapping[str, object]) -> str:
    """The fingerprint that io.fingerprint gives the same rows."""
    return io.digest(told["rows"], told["sum"], told["xor"])


def written_aside(frame: DataFrame, outputs: Mapping[str, tuple[Output, Column]], folder: Folder, aside: str) -> dict[str, dict]:
    """Writes the rows of each output (name -> contract and condition) under `aside` in one job and gives what was counted. Rows that no output takes are left out."""
    for out, _ in outputs.values():
        same_schema(frame, out.schema, out.name)
    marker = reduce(lambda rest, k: F.when(outputs[k][1], k).otherwise(rest), reversed(list(outputs)), F.lit(None).cast("string"))
    marked = frame.withColumn(_OUTPUT, marker).where(F.col(_OUTPUT).isNotNull())
    counted, seen = [], Observation(f"publish-{uuid4().hex}")
    for k, (out, _) in enumerate(outputs.values()):
        counted += [(k, name, c) for name, c in facts(frame, out, F.col(_OUTPUT) == list(outputs)[k])]
    watched = marked.observe(seen, *(c.alias(f"{k}.{name}") for k, name, c in counted))
    watched.write.partitionBy(_OUTPUT).option("compression", "zstd").parquet(f"{folder.path}/{aside}")
    found = seen.get
    return {name: {n: found[f"{k}.{n}"] for j, n, _ in counted if j == k} for k, name in enumerate(outputs)}


def publish(frames: Sequence[tuple[DataFrame, Mapping[str, tuple[Output, Column]]]], path: str, sources: Sequence[tuple[str, DataFrame]] = (), parameters: Mapping[str, object] | None = None, after: Callable[[dict[str, DataFrame]], list[dict]] | None = None) -> DataFrame:
    """Writes the outputs of each frame to `path/<name>` and a manifest beside them; returns the manifest, read back.

    The old outputs stay until all new ones are written and pass. A reader that goes by the manifest never takes a half-replaced folder for a whole one: the
    old manifest goes first, and the new one comes last. `after` gives more rows for the manifest from the outputs as they were written.
    """
    spark = frames[0][0].sparkSession
    folder, aside = Folder(spark, path), f"_aside-{uuid4().hex}"
    folder.make("")
    try:
        told: dict[str, tuple[Output, dict]] = {}
        for k, (frame, outputs) in enumerate(frames):
            found = written_aside(frame, outputs, folder, f"{aside}/{k}")
            told |= {name: (outputs[name][0], found[name]) for name in outputs}
        problems = [p for out, found in told.values() for p in judge(out, found)]
        if problems:
            raise ContractError(path, problems)
        rows = [source_row(name, frame) for name, frame in sources]
        rows += [{"role": "output", "name": n, "n_rows": x["rows"], "schema": out.schema.simpleString(), "fingerprint": fingerprint_of(x)} for n, (out, x) in told.items()]
        if after is not None:
            rows += after({name: spark.read.parquet(f"{folder.path}/{aside}/{k}/{_OUTPUT}={name}") for k, (_, outputs) in enumerate(frames) for name in outputs})
        io.manifest_of(spark, rows, parameters or {}).coalesce(1).write.json(f"{folder.path}/{aside}/{MANIFEST}")
        folder.delete(MANIFEST)
        for k, (_, outputs) in enumerate(frames):
            for name in outputs:
                folder.delete(name)
                folder.move(f"{aside}/{k}/{_OUTPUT}={name}", name)
        folder.move(f"{aside}/{MANIFEST}", MANIFEST)
    finally:
        folder.delete(aside)
    return io.read_manifest(spark, f"{folder.path}/{MANIFEST}")


def source_row(name: str, frame: DataFrame) -> dict:
    """A source by its files: names, sizes and times, and rows as the footers have them; no column is read. A frame that isn't of files is summed up by its rows."""
    try:
        files = frame.select("_metadata.file_name", "_metadata.file_size", F.col("_metadata.file_modification_time").cast("double").alias("at"))
    except AnalysisException:  # no such hidden column
        one = io.fingerprint(frame, name).first()
        return {"role": "source", "name": name, "n_rows": one["n_rows"], "schema": one["schema"], "fingerprint": one["fingerprint"]}
    each = files.groupBy("file_name", "file_size", "at").agg(F.count(F.lit(1)).alias("n"))
    mark = F.xxhash64("file_name", "file_size", "at", "n")
    one = each.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("rows"), F.sum(mark.cast("decimal(38,0)")).alias("sum"), F.bit_xor(mark).alias("xor")).first()
    return {"role": "source", "name": name, "n_rows": one["rows"], "schema": frame.schema.simpleString(), "fingerprint": io.digest(one["rows"], one["sum"], one["xor"])}


def read_published(spark: SparkSession, path: str, name: str, output: Output | None = None, check: bool = True) -> DataFrame:
    """An output of a published folder, under its contract and with the fingerprint that the manifest has. Without a manifest the folder isn't whole, and reading fails."""
    if not Folder(spark, path).exists(MANIFEST):
        raise ContractError(path, ["has no manifest, so that it isn't whole"])
    told = io.read_manifest(spark, f"{path}/{MANIFEST}").where((F.col("role") == "output") & (F.col("name") == name)).first()
    if told is None:
        raise ContractError(path, [f"has no output {name}"])
    frame = spark.read.parquet(f"{path}/{name}")
    if output is not None:
        same_schema(frame, output.schema, output.name)
    if check and io.fingerprint(frame, name).first()["fingerprint"] != told["fingerprint"]:
        raise ContractError(f"{path}/{name}", ["has another fingerprint than its manifest"])
    return frame
