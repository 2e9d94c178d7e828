"""What the corpus operators share: reading, staging in the shared folder, and word expressions."""

from __future__ import annotations

from uuid import uuid4

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import reach_workers, shared_folder

#: White space of every word contract: blank and the five ASCII controls from tab to carriage return.
WS = " \t\n\x0b\x0c\r"
WS_RE = r"[\x20\x09-\x0D]+"
WORD_CHAR_RE = r"[^\x20\x09-\x0D]"


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return reach_workers(spark).read.parquet(f"{sf_dir}/{table}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; only where it is unset on a local master (tests) one of our own."""
    return shared_folder(spark)


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid4().hex}"


def stage(df: DataFrame, name: str) -> DataFrame:
    """Cuts lineage: written as Parquet to the shared folder, which outlives any executor, and read again."""
    path = new_path(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def words(text: Column) -> Column:
    """Array of the maximal runs of non-white characters; null and blank texts have none."""
    bare = F.btrim(F.coalesce(text, F.lit("")), F.lit(WS))
    return F.when(bare == "", F.array().cast("array<string>")).otherwise(F.split(bare, WS_RE))


def integer_id(docs: DataFrame, id_col: str) -> DataFrame:
    """The same rows. Operators that gather ids in arrays of 64-bit integers take no others."""
    kind = docs.select(F.col(f"`{id_col}`")).schema[0].dataType
    if not isinstance(kind, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)):
        raise TypeError(f"ids must be integers, not {kind.simpleString()}; number the rows first")
    return docs
