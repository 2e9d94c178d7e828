"""Exact dedup by stateful streaming.

The rows of new files land as (file, locator, id, digest) of the normalised text in one folder, and a stream over that folder aggregates them by digest; its keyed
state sits on disk (RocksDB), never expires and holds, for each digest, the smallest identifier with the locator (file and row) of its content, and the number of
rows. Rows whose digest is held by more than one row are hits: their full normalised bytes are read again, from the files that hits name, and compared, so that a
digest collision never merges different texts.

Under a state's path, digests, state and the stream's progress outlive a call: a later call, in the same session or another, reads only files that it hasn't
read, and holds their rows against all rows before. The stream's input is the same folder in every call. Files are told by the full path that Spark
has for them, however a call spells it.
"""

from __future__ import annotations

import re
from urllib.parse import unquote
from uuid import uuid4

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.publish import Folder
from .common import WS_RE, new_path, stage

STATE_CONF = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
    "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true",
    "spark.sql.streaming.stateStore.rocksdb.maxMemoryUsageMB": "200",
    # else each of many small stores sets megabytes of disk aside
    "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",
}
#: Hits are broadcast up to so many rows (a locator is about 100 bytes); beyond, they are joined by a shuffle.
BROADCAST_HITS = 200_000


def normalised(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), WS_RE, " ")


ROWS = "file string, locator string, id {kind}, sha string, digest string"


def _file() -> Column:
    return F.col("_metadata.file_path")


def _locator() -> Column:
    return F.concat_ws("#", _file(), F.col("_metadata.row_index").cast("string"))


def _paths(files: DataFrame) -> list[str]:
    """Files as paths to read; Spark's driver lists the files of whatever it reads, too. Signs that a pattern would have are escaped."""
    return sorted(re.sub(r"([\[\]{}*?\\])", r"\\\1", unquote(r["file"])) for r in files.collect())


def _first() -> Column:
    """Smallest id first, null ids last, and the locator between rows of the same id."""
    return F.min(F.struct(F.col("id").isNull().alias("no_id"), "id", "locator")).alias("keep")


def _run(stream) -> None:
    stream.trigger(availableNow=True).start().awaitTermination()


def land(spark: SparkSession, table: DataFrame, state: str, id_col: str, text_col: str, digest_chars: int) -> DataFrame:
    """(file, locator, id, sha, digest) of every row of this and earlier calls. Rows of files that aren't there yet are written aside and moved to the others at once."""
    kind = dict(table.select(F.col(f"`{id_col}`").alias("id")).dtypes)["id"]
    folder, schema = Folder(spark, state), ROWS.format(kind=kind)
    landed = spark.read.schema(schema).option("recursiveFileLookup", True).parquet(f"{state}/digests") if folder.exists("digests") else None
    files = table.select(_file().alias("file")).distinct()
    if landed is not None:
        files = files.join(landed.select("file").distinct(), "file", "left_anti")
    new = _paths(files)
    folder.make("digests")
    if new:
        rows = spark.read.schema(table.schema).parquet(*new).select(_file().alias("file"), _locator().alias("locator"), F.col(f"`{id_col}`").alias("id"), F.sha2(normalised(F.col(f"`{text_col}`")), 256).alias("sha"))
        name = uuid4().hex
        rows.withColumn("digest", F.substring("sha", 1, digest_chars)).write.parquet(f"{state}/aside-{name}")
        folder.move(f"aside-{name}", f"digests/{name}")
    return spark.read.schema(schema).option("recursiveFileLookup", True).parquet(f"{state}/digests")


def digest_state(digests: DataFrame, state: str, files_per_batch: int) -> DataFrame:
    """(digest, keep, n): the last state of every key, from the updates that each batch of the stream wrote, in this and earlier calls."""
    spark, out = digests.sparkSession, f"{state}/updates"
    held = {k: spark.conf.get(k, None) for k in STATE_CONF}
    keyed = spark.readStream.schema(digests.schema).option("recursiveFileLookup", True).option("maxFilesPerTrigger", files_per_batch).parquet(f"{state}/digests").groupBy("digest").agg(_first(), F.count(F.lit(1)).alias("n"))

    def put(batch: DataFrame, number: int) -> None:
        # a batch that is run again after a failure takes its own place
        batch.write.mode("overwrite").parquet(f"{out}/batch={number}")

    try:
        for k, v in STATE_CONF.items():
            spark.conf.set(k, v)
        _run(keyed.writeStream.outputMode("update").foreachBatch(put).option("checkpointLocation", f"{state}/keyed-log"))
    finally:
        for k, v in held.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    if digests.limit(1).isEmpty():
        return spark.createDataFrame([], keyed.schema)
    rows = spark.read.schema(f"{_ddl(keyed)}, batch bigint").parquet(out)
    if rows.select("batch").distinct().limit(2).count() == 1:
        return rows.select("digest", "keep", "n")
    return rows.groupBy("digest").agg(F.max_by(F.struct("keep", "n"), "batch").alias("s")).select("digest", "s.keep", "s.n")


def _ddl(df: DataFrame) -> str:
    return ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in df.schema)


def dedup(spark: SparkSession, path: str, id_col: str = "doc_id", text_col: str = "text", digest_chars: int = 64, files_per_batch: int = 500, state: str | None = None) -> DataFrame:
    """One row per row of the Parquet table at `path`: id, keep_id, group_size, kept, text_sha256.

    Without `state` the table is held against itself. With it, a shared folder, also against all rows of earlier calls with that folder, whose
    own results stand: a smaller id that comes later takes the place of the one that was kept. `path` may be any spelling of a file, a folder or a pattern, also of tables of
    earlier calls: it is the files that count. Files that a call has read must stay as they are, as hits are compared byte by byte; a file isn't read into the state twice, and
    `digest_chars`, the columns' names and the kind of ids must stay the same. Null text counts as empty. A null
    id sorts after all others. Of repeated rows of one id, one (the first by file and row) is kept. Other columns are not read. An empty table gives an
    empty result. `digest_chars` is the length of the hex digest that keys the state; the byte check makes the result the same at any length.
    """
    folder = state.rstrip("/") if state else new_path(spark, "dedup-state")
    table = spark.read.parquet(path.rstrip("/"))
    digests = land(spark, table, folder, id_col, text_col, digest_chars)
    state = digest_state(digests, folder, files_per_batch)
    own = digests.join(table.select(_file().alias("file")).distinct(), "file", "left_semi")
    shared = state.where("n > 1").select("digest").join(own.select("digest").distinct(), "digest", "left_semi")
    hits = stage(digests.join(shared, "digest", "left_semi").select("file", "locator", "id", "digest"), "hits")
    found = _paths(hits.select("file").distinct())
    texts = spark.read.schema(table.select(F.col(f"`{text_col}`")).schema).parquet(*found) if found else table
    text = texts.select(_locator().alias("locator"), F.col(f"`{text_col}`").alias("text"))
    few = hits.count() <= BROADCAST_HITS
    read = text.join(F.broadcast(hits.drop("file")) if few else hits.drop("file"), "locator").withColumn("body", normalised(F.col("text"))).drop("text")
    equal = read.groupBy("digest", "body").agg(_first(), F.count(F.lit(1)).alias("n"))
    several = equal.groupBy("digest").agg(F.count(F.lit(1)).alias("bodies"), F.first("keep").alias("keep"), F.first("n").alias("n"))
    checked = stage(several, "checked")
    out = own.join(checked.where("bodies = 1"), "digest", "left").select("id", "locator", "sha", "digest", "keep", "n")
    if not checked.where("bodies > 1").isEmpty():
        apart = read.join(checked.where("bodies > 1").select("digest"), "digest", "left_semi")
        sizes = apart.groupBy("digest", "body").agg(_first(), F.count(F.lit(1)).alias("n"))
        apart = apart.join(sizes, ["digest", "body"]).join(own.select("locator", "sha"), "locator").select("id", "locator", "sha", "digest", "keep", "n")
        out = out.join(checked.where("bodies > 1").select("digest"), "digest", "left_anti").select(apart.columns).union(apart)
    single = F.col("keep").isNull()
    return out.select(
        F.col("id").alias(id_col), F.when(single, F.col("id")).otherwise(F.col("keep.id")).alias("keep_id"), F.coalesce("n", F.lit(1).cast("bigint")).alias("group_size"),
        (single | (F.col("keep.locator") == F.col("locator"))).alias("kept"), F.col("sha").alias("text_sha256"),
    )
