"""Several small frames as one nested JSON document: each part an array of structs, read back under a schema."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Rows that a part may have: a document is one row of one task.
MOST_ROWS = 100_000


def _clean(field: T.StructField) -> Column:
    c = F.col(f"`{field.name}`")
    return (F.nanvl(c, F.lit(None).cast(field.dataType)) if isinstance(field.dataType, (T.DoubleType, T.FloatType)) else c).alias(field.name)


def schema_of(parts: Mapping[str, DataFrame]) -> T.StructType:
    return T.StructType([T.StructField(name, T.ArrayType(frame.schema)) for name, frame in parts.items()])


def document(parts: Mapping[str, DataFrame]) -> DataFrame:
    """One row with an array of structs for each part, in the order of their columns. NaN, which JSON has no sign for, is null. A part of more than MOST_ROWS rows is refused."""
    out = None
    for name, frame in parts.items():
        rows = frame.select(F.struct(*map(_clean, frame.schema)).alias("r")).limit(MOST_ROWS + 1)
        size = F.count(F.lit(1))
        found = F.when(size > MOST_ROWS, F.raise_error(F.lit(f"{name} has more than {MOST_ROWS} rows")).cast(T.ArrayType(frame.schema))).otherwise(F.sort_array(F.collect_list("r")))
        one = rows.agg(found.alias(name))
        out = one if out is None else out.crossJoin(one)
    return out


def write_document(parts: Mapping[str, DataFrame], path: str) -> None:
    document(parts).coalesce(1).write.mode("overwrite").option("ignoreNullFields", False).json(path)


def read_document(spark: SparkSession, path: str, schema: T.StructType) -> dict[str, DataFrame]:
    """The parts of a document as frames; reading one that doesn't fit the schema fails."""
    rows = spark.read.schema(schema).option("mode", "FAILFAST").json(path)
    return {f.name: rows.select(F.inline(F.col(f"`{f.name}`"))) for f in schema}
