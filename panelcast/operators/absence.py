"""Absences: statuses of a period, missed games, pace and streak before a report."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .panel import PERIOD


def joined_statuses(reports: Sequence[DataFrame], key: Sequence[str], status: str = "status") -> DataFrame:
    """The distinct statuses of a key over several reports, sorted and joined by " / "."""
    every = reports[0].select(*key, status)
    for r in reports[1:]:
        every = every.unionByName(r.select(*key, status))
    return every.groupBy(*key).agg(F.array_join(F.sort_array(F.collect_set(status)), " / ").alias(status))


def attach_outcomes(targets: DataFrame, outcomes: DataFrame, absences: DataFrame, key: Sequence[str], score: str = "score", status: str = "status") -> DataFrame:
    """Outcomes and statuses of frozen targets; missed: no outcome, and a status."""
    out = targets.join(outcomes.select(*key, score), list(key), "left").join(absences.select(*key, status), list(key), "left")
    return out.withColumn("missed", F.col(score).isNull() & F.col(status).isNotNull())


def pace_and_streak(games: DataFrame, reports: DataFrame, entity: str = "entity", period: Sequence[str] = PERIOD, score: str = "score", window: int = 10, last_week: int | None = None) -> DataFrame:
    """For each report: played, the mean score of up to `window` games before it (over seasons), the weeks since the last game
    of this season (by weeks of play), the score and its distance from the pace. Entities need both games and reports.

    Games and reports have one row a key each. Both are read once and dealt by entity once; all that follows are windows on that.
    """
    season, week = period
    key = [entity, season, week]
    more = [c for c in reports.columns if c not in key]
    kinds, none = dict(reports.dtypes), lambda kind: F.lit(None).cast(kind)
    kinds[score] = dict(games.dtypes)[score]
    played = games.select(*key, score, *(none(kinds[c]).alias(c) for c in more), F.lit(False).alias("_told"))
    told = reports.select(*key, none(kinds[score]).alias(score), *more, F.lit(True).alias("_told"))
    one = played.unionByName(told).repartition(entity).groupBy(*key).agg(F.max(score).alias(score), *(F.max_by(c, "_told").alias(c) for c in more), F.max("_told").alias("_told"))
    every = Window.partitionBy(entity)
    w = every.orderBy(season, week)
    upto, past = w.rowsBetween(Window.unboundedPreceding, 0), w.rowsBetween(Window.unboundedPreceding, -1)
    own = Window.partitionBy(entity, season).orderBy(week).rowsBetween(Window.unboundedPreceding, -1)
    there = F.col(score).isNotNull()
    rows = one.withColumns({"_both": F.max(there).over(every) & F.max("_told").over(every), "_nth": F.count(score).over(upto)}).where("_both")
    # the mean of the games with the last numbers; rows without a game have no score and their last game's number
    rows = rows.withColumn("_pace", F.when(there, F.avg(score).over(every.orderBy("_nth").rangeBetween(-(window - 1), 0))))
    rows = rows.withColumns({
        "pace": F.last("_pace", ignorenulls=True).over(past),
        "weeks_missed": (F.col(week) - 1 - F.coalesce(F.max(F.when(there, F.col(week))).over(own), F.lit(0))).cast("bigint"),
        "played": there,
    })
    out = rows.where("_told").withColumn("delta", F.col(score) - F.col("pace")).drop("_pace", "_told", "_both", "_nth")
    return out if last_week is None else out.where(F.col(week) <= last_week)


def status_counts(reports: DataFrame, status: str, played: Column) -> DataFrame:
    return reports.groupBy(status).agg(F.count(F.lit(1)).alias("reports"), F.count_if(played).alias("played"), F.count_if(~played).alias("missed"))


def covered(reports: DataFrame, season: str, first: int, last: int) -> DataFrame:
    """Rows of covered seasons; others are dropped without a word, and nothing left is an empty frame."""
    return reports.where(F.col(season).between(first, last))
