"""Games and rosters: sides, grids, gaps, depth, shares."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalar import rank_discount, ratio_or_zero


def two_rows(games: DataFrame, keep: Sequence[str], sides: Mapping[str, tuple[str, str]]) -> DataFrame:
    """One row for each side of a game, in one scan. sides: output column -> (home column, away column); adds home (1 or 0)."""
    row = lambda side, home: F.struct(*(F.col(v[side]).alias(k) for k, v in sides.items()), F.lit(home).cast("bigint").alias("home"))
    return games.select(*keep, F.explode(F.array(row(0, 1), row(1, 0))).alias("_s")).select(*keep, "_s.*")


def resolve_side(team: Column, home: Column, away: Column, if_home: Column, if_away: Column) -> Column:
    """The value of the side that a team is on; null if it is on neither."""
    return F.when(team == home, if_home).when(team == away, if_away)


def grid_gaps(present: DataFrame, left: DataFrame, right: DataFrame) -> DataFrame:
    """Combinations of two small dimension tables that have no row. The grid is of the dimensions' sizes, not of the facts'."""
    keys = [*left.columns, *right.columns]
    return left.crossJoin(F.broadcast(right)).join(present.select(*keys).distinct(), keys, "left_anti")


def fill_gaps(gaps: DataFrame, candidates: DataFrame, keys: Sequence[str], order: Sequence[Column], count: int = 1) -> DataFrame:
    """For every gap the best candidates of its keys."""
    best = candidates.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)).cast("bigint")).where(F.col("rank") <= count)
    return gaps.join(best, list(keys))


def depth_filter(slots: DataFrame, group: Sequence[str], category: str, rank: str, starters: Sequence[str], limits: Mapping[str, int]) -> DataFrame:
    """Of starter categories the rows of least rank in their group; of others those within a limit."""
    least = F.min(rank).over(Window.partitionBy(*group, category))
    table = F.create_map(*(F.lit(x) for pair in limits.items() for x in pair))
    return slots.withColumn("_least", least).where(F.when(F.col(category).isin(list(starters)), F.col(rank) == F.col("_least")).otherwise(F.col(rank) <= table[F.col(category)])).drop("_least")


def shares(rows: DataFrame, group: Sequence[str], weight: Column, rank: Column, name: str = "share") -> DataFrame:
    """Discounted weights as parts of their group's sum; 0 where that is 0. Groups are summed up first (combined before the shuffle), so that none is gathered in a task."""
    rows = rows.withColumn("_w", F.coalesce(weight, F.lit(0.0)) * rank_discount(rank))
    sums = rows.groupBy(*(F.col(g).alias(f"_of_{g}") for g in group)).agg(F.sum("_w").alias("_sum"))
    same = [F.col(g).eqNullSafe(F.col(f"_of_{g}")) for g in group]
    return rows.join(sums, same).withColumn(name, ratio_or_zero(F.col("_w"), F.col("_sum"))).drop("_w", "_sum", *(f"_of_{g}" for g in group))


def match_report(facts: DataFrame, dimension: DataFrame, on: Sequence[str]) -> DataFrame:
    """One row: facts, and facts without a match. A job raises if the second isn't 0."""
    marked = facts.join(dimension.select(*on).distinct().withColumn("_hit", F.lit(1)), list(on), "left")
    return marked.agg(F.count(F.lit(1)).alias("n_rows"), F.count_if(F.col("_hit").isNull()).alias("n_unmatched"))


def must_match(facts: DataFrame, dimension: DataFrame, on: Sequence[str], what: str = "row") -> DataFrame:
    """An inner join that fails on the first fact without a match, as it runs."""
    joined = facts.join(dimension.withColumn("_hit", F.lit(True)), list(on), "left")
    guard = F.when(F.col("_hit").isNull(), F.raise_error(F.concat(F.lit(f"no match for {what} "), F.concat_ws(", ", *on)))).otherwise(F.col("_hit"))
    return joined.withColumn("_hit", guard.cast("boolean")).where("_hit").drop("_hit")


def holder_changes(games: DataFrame, group: str, season: str, order: Sequence[Column], holder: str) -> DataFrame:
    """The holder of the earliest game of each group and season, and whether it differs from the season before; false if either is unknown."""
    first = games.groupBy(group, season).agg(F.min_by(holder, F.struct(*order)).alias("holder"))
    before = first.select(group, (F.col(season) + 1).alias(season), F.col("holder").alias("before"))
    return first.join(before, [group, season], "left").withColumn("changed", F.coalesce(F.col("holder") != F.col("before"), F.lit(False))).drop("before")


def newest_if_empty(facts: DataFrame, season: str, wanted: int) -> DataFrame:
    """Rows of the season before the wanted one, or of the newest earlier season if that has none."""
    pick = facts.where(F.col(season) < wanted).agg(F.coalesce(F.max(F.when(F.col(season) == wanted - 1, F.col(season))), F.max(season)).alias("_pick"))
    return facts.join(F.broadcast(pick), F.col(season) == F.col("_pick")).drop("_pick")
