"""Panels: one row per entity and period. Windows are by entity, so that one shuffle serves all features of a panel."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

PERIOD = ("season", "week")


def by_entity(entity: Sequence[str] = ("entity",), period: Sequence[str] = PERIOD):
    return Window.partitionBy(*entity).orderBy(*period)


def last_write(facts: DataFrame, key: Sequence[str], sequence: Sequence[str], within: Sequence[str] | None = None) -> DataFrame:
    """Of the rows of a key the one with the largest sequence stays. An aggregate: rows are combined before the shuffle.

    With `within`, the first columns of the key, rows are dealt by these and the newest is picked in the key's order, so that windows
    by the same columns that come next need neither a shuffle nor a sort of their own.
    """
    if within is not None:
        newest = F.row_number().over(Window.partitionBy(*key).orderBy(*(F.desc(s) for s in sequence)))
        return facts.repartition(*within).withColumn("_nth", newest).where("_nth = 1").drop("_nth")
    rest = [c for c in facts.columns if c not in key]
    newest = facts.groupBy(*key).agg(F.max_by(F.struct(*rest), F.struct(*sequence)).alias("_row"))
    return newest.select(*key, *(F.col("_row")[c].alias(c) for c in rest)).select(facts.columns)


def history_features(facts: DataFrame, fields: Sequence[str], prefix: str, entity: Sequence[str] = ("entity",), period: Sequence[str] = PERIOD, length: int = 10) -> DataFrame:
    """Adds the last value and the mean of up to `length` earlier rows of each field, and the period of the newest row that they use.

    The row itself is never part of its features. A first row has nulls.
    """
    w = by_entity(entity, period)
    before = w.rowsBetween(-length, -1)
    added = {f"{prefix}_through_{p}": F.lag(p).over(w) for p in period}
    for f in fields:
        added[f"{prefix}_last_1_{f}"] = F.lag(f).over(w)
        added[f"{prefix}_last_{length}_{f}"] = F.avg(f).over(before)
    return facts.withColumns(added)


def with_history(features: DataFrame, prefix: str, period: Sequence[str] = PERIOD) -> DataFrame:
    """Drops rows without an earlier one."""
    return features.where(F.col(f"{prefix}_through_{period[0]}").isNotNull())


def top_rows(facts: DataFrame, group: Sequence[str], order: Sequence[Column], count: int, rank: str = "rank") -> DataFrame:
    """The first `count` rows of each group with their ordinal rank."""
    if count < 1:
        raise ValueError("count must be 1 or more")
    return facts.withColumn(rank, F.row_number().over(Window.partitionBy(*group).orderBy(*order)).cast("bigint")).where(F.col(rank) <= count)


def last_means(facts: DataFrame, group: Sequence[str], period: Sequence[str], value: str, lengths: Sequence[int]) -> DataFrame:
    """Means of the newest rows of each group, for several lengths at once."""
    newest = top_rows(facts, group, [F.desc(p) for p in period], max(lengths), "_rank")
    return newest.groupBy(*group).agg(*(F.avg(F.when(F.col("_rank") <= n, F.col(value))).alias(f"last_{n}_{value}") for n in lengths))


def within_limits(facts: DataFrame, group: Sequence[str], category: str, order: Sequence[Column], limits: Mapping[str, int]) -> DataFrame:
    """Rows whose ordinal rank in their group is within their category's limit; categories without one are dropped."""
    table = F.create_map(*(F.lit(x) for pair in limits.items() for x in pair))
    ranked = facts.withColumn("rank", F.row_number().over(Window.partitionBy(*group).orderBy(*order)).cast("bigint"))
    return ranked.where(F.col("rank") <= table[F.col(category)])


def group_totals(facts: DataFrame, group: Sequence[str], values: Sequence[str], where: Column | None = None) -> DataFrame:
    """Sums over a group, of all rows or of those that a condition picks; nulls count as 0."""
    rows = facts if where is None else facts.where(where)
    return rows.groupBy(*group).agg(*(F.sum(F.coalesce(F.col(v), F.lit(0))).alias(f"total_{v}") for v in values))


def season_profile(facts: DataFrame, value: str, entity: Sequence[str] = ("entity",), period: Sequence[str] = PERIOD) -> DataFrame:
    """For each entity and season what is known at the season's end: rows and mean so far, the last value, means of 5 and 10, and the season's own.

    One pass over the panel: the cumulative windows share one sort, and the last row of a season holds its state.
    """
    w = by_entity(entity, period)
    ever = w.rowsBetween(Window.unboundedPreceding, 0)
    own = Window.partitionBy(*entity, period[0])
    rows = facts.withColumns({
        "career_games": F.count(value).over(ever), "career_mean": F.avg(value).over(ever), "last_1": F.col(value),
        "last_5": F.avg(value).over(w.rowsBetween(-4, 0)), "last_10": F.avg(value).over(w.rowsBetween(-9, 0)),
        "season_games": F.count(value).over(own), "season_mean": F.avg(value).over(own),
        "_nth": F.row_number().over(own.orderBy(*(F.desc(p) for p in period[1:]))),
    })
    state = rows.where("_nth = 1").drop("_nth")
    return state.withColumn("next_season", F.lead(period[0]).over(Window.partitionBy(*entity).orderBy(period[0])))


def target_features(profile: DataFrame, targets: DataFrame, period: Sequence[str] = PERIOD) -> DataFrame:
    """For each target year the newest state before it: valid for years after its season, up to and with the next season that the entity has."""
    s = period[0]
    return profile.join(F.broadcast(targets), (F.col(s) < F.col("target_year")) & (F.col("target_year") <= F.coalesce("next_season", F.lit(9999))))
