"""Column expressions of panels: defaults, scores, tiers, labels. All are built-in Spark functions."""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence
from functools import reduce
from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Report texts and how severe they are.
SEVERITY = {"Questionable": 1, "Doubtful": 2, "Out": 3}
#: Codes of teams that moved, and their codes today.
TEAM_CODES = {"STL": "LA", "SD": "LAC", "OAK": "LV"}
#: Points for a number of points allowed, up to and with each bound; the last tier has no bound.
ALLOWED_TIERS = ((0, 10.0), (6, 7.0), (13, 4.0), (20, 1.0), (27, 0.0), (34, -1.0), (None, -4.0))
DAYS_A_YEAR = 365.2425


def literal_map(table: Mapping) -> Column:
    return F.create_map(*map(F.lit, chain(*table.items())))


def current_code(code: Column, aliases: Mapping[str, str] = TEAM_CODES) -> Column:
    """The code that a former code stands for today; any other as it is, null stays null."""
    return F.coalesce(literal_map(aliases)[code], code)


def number_or_zero(value: Column) -> Column:
    """Null is 0.0; text that is no number raises under ANSI mode."""
    return F.coalesce(value.cast("double"), F.lit(0.0))


def as_day(value: Column) -> Column:
    """A day from a date, a timestamp or ISO text of either."""
    return F.to_date(F.substring(value.cast("string"), 1, 10))


def required(value: Column, name: str | Column) -> Column:
    """The value, or an error that names the field; text of blanks alone is no value."""
    label = F.lit(name) if isinstance(name, str) else F.coalesce(name, F.lit("a value"))
    there = value.isNotNull() & (F.trim(value.cast("string")) != "")
    return F.when(there, value).otherwise(F.raise_error(F.concat(label, F.lit(" is required"))))


def weighted_score(terms: Mapping[str, float]) -> Column:
    """Sum of columns times weights; null counts as 0."""
    return reduce(lambda a, b: a + b, (number_or_zero(F.col(c)) * F.lit(float(w)) for c, w in terms.items()))


def tiered(value: Column, tiers: Sequence[tuple[float | None, float]] = ALLOWED_TIERS) -> Column:
    """Points of the first tier, in ascending order of bounds, that holds the value; the tier without bound takes the rest. Null stays null."""
    out, last = None, F.lit(None).cast("double")
    for bound, points in tiers:
        if bound is None:
            last = F.lit(float(points))
        else:
            test = value <= bound
            out = F.when(test, float(points)) if out is None else out.when(test, float(points))
    return F.when(value.isNotNull(), out.otherwise(last))


def ratio_or_zero(part: Column, whole: Column) -> Column:
    return F.when(whole > 0, part / whole).otherwise(F.lit(0.0))


def age_years(born: Column, on: Column) -> Column:
    return F.datediff(on, born) / DAYS_A_YEAR


def experience(season: Column, first: Column) -> Column:
    """Seasons since the first; none if it isn't known or lies ahead."""
    return F.greatest(season - F.coalesce(first, season), F.lit(0))


def participated(score: Column, usage: Iterable[Column]) -> Column:
    """A score other than 0 or any usage."""
    return (F.coalesce(score, F.lit(0.0)) != 0) | (reduce(lambda a, b: a + b, (F.coalesce(u, F.lit(0.0)) for u in usage)) > 0)


def one_hot(value: Column, categories: Sequence[str], prefix: str) -> dict[str, Column]:
    return {f"{prefix}_{c.lower()}": F.coalesce((value == c).cast("double"), F.lit(0.0)) for c in categories}


def severity(text: Column, table: Mapping[str, int] = SEVERITY) -> Column:
    """Null for a text that isn't listed."""
    return literal_map(table)[text]


def flags(tests: Mapping[str, Column], between: str = "; ") -> Column:
    """Labels of the tests that hold, joined; none gives the empty string."""
    return F.concat_ws(between, *(F.when(t, F.lit(label)) for label, t in tests.items()))


def agreement(models: Column, spread: Column, tight: float, mixed: float) -> Column:
    return F.when(models <= 1, "Single model").when(spread <= tight, "Tight").when(spread <= mixed, "Mixed").otherwise("Wide")


def rank_discount(rank: Column) -> Column:
    return 1 / F.sqrt(F.greatest(rank, F.lit(1)).cast("double"))


def first_present(columns: Sequence[str], wanted: Sequence[tuple[str, str]]) -> tuple[Column, Column]:
    """Of (column, label) pairs the first whose column the frame has: its values and its label; nulls if it has none."""
    for name, label in wanted:
        if name in columns:
            return F.col(name).cast("double"), F.lit(label)
    return F.lit(None).cast("double"), F.lit(None).cast("string")


def feature_names(prefix: str, fields: Sequence[str], lengths: Sequence[int] = (1, 10)) -> list[str]:
    return [f"{prefix}_last_{n}_{f}" for n in lengths for f in fields]


def totals(columns: Iterable[str]) -> Column:
    """Sum of counters; null counts as 0."""
    return reduce(lambda a, b: a + b, (F.coalesce(F.col(c), F.lit(0)) for c in columns))
