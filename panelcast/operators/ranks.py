"""Ranks over more rows than one task should order.

Rows are cut into ranges of the value, ranked within each, and what the ranges ahead hold is added. Groups are few; ranges are as many
as the cluster has cores, 64 at least. The tables beside the rows have a row for each group, or group and range.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import staged

LEAST_RANGES = 64


def range_count(frame: DataFrame) -> int:
    return max(LEAST_RANGES, frame.sparkSession.sparkContext.defaultParallelism)


def beside(frame: DataFrame, table: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Adds the columns of a small table by keys, of which null is one, too."""
    names = [f"_key_{k}" for k in range(len(keys))]
    small = table.withColumnsRenamed(dict(zip(keys, names, strict=True)))
    on = [F.col(f"`{k}`").eqNullSafe(F.col(n)) for k, n in zip(keys, names, strict=True)]
    return frame.join(F.broadcast(small), on, "left").drop(*names)


def cut(frame: DataFrame, group: Sequence[str], value: str) -> DataFrame:
    """Adds `_range`, from 0 up with the value: of about as many rows each, and equal values share one. Nulls are in range -1, before all others."""
    n = range_count(frame)
    step = int(n**0.5)
    at = F.array(*(F.lit(k / n) for k in range(1, n)))
    edges = frame.groupBy(*group).agg(F.percentile_approx(value, at, F.lit(10 * n)).alias("_edges"))
    # every step-th edge tells the stretch of edges in which a value lies, so that a row is held against few of them
    edges = edges.withColumn("_coarse", F.filter("_edges", lambda e, k: k % step == step - 1))
    smaller = lambda c: F.coalesce(F.size(F.filter(c, lambda e: e < F.col(value))), F.lit(0))
    rows = beside(frame, edges, group).withColumn("_start", smaller("_coarse") * step)
    below = F.col("_start") + smaller(F.slice("_edges", F.col("_start") + 1, step))
    return rows.withColumn("_range", F.when(F.col(value).isNull(), -1).otherwise(below)).drop("_edges", "_coarse", "_start")


def ahead(frame: DataFrame, keys: Sequence[str], amount: Column, order: Column) -> DataFrame:
    """keys, _range, _ahead, _total: the sum of an amount over the ranges before each one, and over all. Few rows, combined before the shuffle."""
    sums = frame.groupBy(*keys, "_range").agg(amount.alias("_here"))
    of = Window.partitionBy(*keys)
    before = F.sum("_here").over(of.orderBy(order).rowsBetween(Window.unboundedPreceding, -1))
    return sums.select(*keys, "_range", F.coalesce(before, F.lit(0)).alias("_ahead"), F.sum("_here").over(of).alias("_total"))


def ordinal(frame: DataFrame, group: Sequence[str], value: str, ties: Sequence[str | Column], name: str = "rank") -> DataFrame:
    """Adds the ordinal rank in the group by falling value, nulls last, ties by rising `ties`.

    Rows are dealt by ranges of group, value and ties together, so that neither a large group nor a value that most rows have makes a large task, and staged with their
    range. The frame is read twice, once to find the ranges: stage it first if it is dear.
    """
    order = [F.desc_nulls_last(value), *ties]
    ranged = staged(frame.repartitionByRange(*(F.col(f"`{g}`").asc() for g in group), *order).withColumn("_range", F.spark_partition_id()), "ranges")
    front = ahead(ranged, group, F.count(F.lit(1)), F.asc("_range"))
    own = F.row_number().over(Window.partitionBy(*group, "_range").orderBy(*order))
    ranked = beside(ranged.withColumn("_own", own), front, [*group, "_range"])
    return ranked.withColumn(name, (F.col("_own") + F.col("_ahead")).cast("bigint")).drop("_own", "_ahead", "_total", "_range")


def running(counts: DataFrame, group: Sequence[str], value: str, count: str = "c") -> DataFrame:
    """counts: a row for each group and value. Adds `_upto`, the rows of the group up to and with the value, and `_total`, all of its rows."""
    ranged = cut(counts, group, value)
    front = ahead(ranged, group, F.sum(count), F.asc("_range"))
    own = F.sum(count).over(Window.partitionBy(*group, "_range").orderBy(value).rowsBetween(Window.unboundedPreceding, 0))
    return beside(ranged.withColumn("_own", own), front, [*group, "_range"]).withColumn("_upto", F.col("_own") + F.col("_ahead")).drop("_own", "_ahead", "_range")


def quantiles(frame: DataFrame, features: Sequence[str], parts: int) -> dict[str, list[float]]:
    """Of each feature the values at ranks ceil(k n / parts) of its n values, k from 0 (the smallest value) to parts (the largest); none where all are null.

    Exact: values are counted, and the counts summed in ranges of the value. A row of a few numbers a feature comes back; the frame is read once.
    """
    each = F.explode(F.array(*(F.struct(F.lit(k).alias("_f"), F.col(f"`{f}`").cast("double").alias("_v")) for k, f in enumerate(features))))
    counts = frame.select(each.alias("_x")).select("_x.*").where("_v IS NOT NULL").groupBy("_f", "_v").agg(F.count(F.lit(1)).alias("c"))
    upto = running(staged(counts, "values"), ["_f"], "_v")
    ranks = F.array(*(F.struct(F.lit(k).alias("k"), F.greatest(F.lit(1), F.expr(f"({k} * _total + {parts - 1}) DIV {parts}")).alias("at")) for k in range(parts + 1)))
    held = F.filter(ranks, lambda x: (x["at"] > F.col("_upto") - F.col("c")) & (x["at"] <= F.col("_upto")))
    got = upto.select("_f", "_v", F.explode(held["k"]).alias("_k")).collect()
    found = {(r["_f"], r["_k"]): r["_v"] for r in got}
    return {f: [found[k, j] for j in range(parts + 1) if (k, j) in found] for k, f in enumerate(features)}


def by_hash(frame: DataFrame, group: Sequence[str], digest: Column, ties: Sequence[str], name: str) -> DataFrame:
    """Adds the ordinal rank in the group by a 64-bit hash. Its leading bits are the range, so that no edges are looked for."""
    bits = max(1, (range_count(frame) - 1).bit_length())
    rows = frame.withColumn("_hash", digest).withColumn("_range", F.shiftright("_hash", 64 - bits))
    front = ahead(rows, group, F.count(F.lit(1)), F.asc("_range"))
    own = F.row_number().over(Window.partitionBy(*group, "_range").orderBy("_hash", *ties))
    return beside(rows.withColumn(name, own), front, [*group, "_range"]).withColumn(name, F.col(name) + F.col("_ahead")).drop("_hash", "_range", "_ahead", "_total")
