"""What was known before or on a day or period: cohort means, snapshots, cut-off histories."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .panel import PERIOD, top_rows


def period_number(period: Sequence[str] = PERIOD) -> Column:
    return F.col(period[0]) * 100 + F.col(period[1])


def cohort_means(facts: DataFrame, cohort: Column, fields: Sequence[str], period: Sequence[str] = PERIOD) -> DataFrame:
    """For every period of the facts, the means of the cohort's rows strictly before it, and the newest period among them.

    The cohort is summed by period first, so that the running window is over periods and not over rows.
    """
    sums = facts.groupBy(*period).agg(
        F.count(F.when(cohort, 1)).alias("_n"), *(F.sum(F.when(cohort, F.col(f))).alias(f"_{f}") for f in fields), F.max(F.when(cohort, period_number(period))).alias("_through")
    )
    before = Window.orderBy(period_number(period)).rangeBetween(Window.unboundedPreceding, -1)
    n = F.sum("_n").over(before)
    out = sums.select(
        *period, n.alias("cohort_rows"), *((F.sum(f"_{f}").over(before) / F.when(n > 0, n)).alias(f"cohort_{f}") for f in fields), F.max("_through").over(before).alias("cohort_through")
    )
    return out.where("cohort_rows > 0")


def snapshot(facts: DataFrame, day: str, on: Column, group: Sequence[str] = ()) -> DataFrame:
    """The rows of the newest day up to and with `on`: of the table, or of each group. By an aggregate, not a window."""
    past = facts.where(F.col(day) <= on)
    newest = past.groupBy(*group).agg(F.max(day).alias("_newest"))
    if not group:
        return past.join(F.broadcast(newest), F.col(day) == F.col("_newest")).drop("_newest")
    return past.join(newest, list(group)).where(F.col(day) == F.col("_newest")).drop("_newest")


def before_cutoff(facts: DataFrame, entity: Sequence[str], cutoff: Column, count: int, period: Sequence[str] = PERIOD) -> DataFrame:
    """Up to `count` rows of each entity strictly before a cut-off, newest first."""
    return top_rows(facts.where(period_number(period) < cutoff), entity, [F.desc(p) for p in period], count)


def forecast_day(games: DataFrame, day: str, season: str, asked: Column) -> DataFrame:
    """For each season the day asked for, or the day before the first game if that is earlier."""
    return games.groupBy(season).agg(F.least(asked, F.date_sub(F.min(day), 1)).alias("as_of"))
