"""Scores of football positions, as weights of the stat columns that a frame must have."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .scalar import number_or_zero, tiered, weighted_score

#: Points for each unit of a stat. Yards are given as points a yard.
QUARTERBACK = {
    "passing_yards": 1 / 25, "passing_touchdowns": 4, "passing_interceptions": -2, "rushing_yards": 1 / 10,
    "rushing_touchdowns": 6, "two_point_conversions": 2, "fumbles": -2,
}
RECEIVING = {
    "rushing_yards": 1 / 10, "rushing_touchdowns": 6, "receiving_yards": 1 / 10, "receiving_touchdowns": 6,
    "two_point_conversions": 2, "fumbles": -2,
}
KICKER = {"field_goals_0_39": 3, "field_goals_40_49": 4, "field_goals_50_plus": 5, "extra_points": 1, "field_goals_missed": 0, "extra_points_missed": 0}
DEFENSE = {"sacks": 1, "interceptions": 2, "fumble_recoveries": 2, "touchdowns": 6, "safeties": 2, "blocked_kicks": 2}
DEFENDER = {"solo_tackles": 1, "assisted_tackles": 0.5, "sacks": 4, "interceptions": 6, "passes_defended": 2, "fumbles_forced": 2, "touchdowns": 6}


def quarterback_score(weights: dict = QUARTERBACK) -> Column:
    return weighted_score(weights)


def receiving_score(reception: float = 0.0, weights: dict = RECEIVING) -> Column:
    """reception: 0, 0.5 or 1 points a catch."""
    return weighted_score(weights) + number_or_zero(F.col("receptions")) * F.lit(float(reception))


def kicker_score(weights: dict = KICKER) -> Column:
    return weighted_score(weights)


def defense_score(weights: dict = DEFENSE, special_teams: bool = False) -> Column:
    """Points for plays and for few points allowed; special_teams also counts special-teams touchdowns."""
    extra = number_or_zero(F.col("special_teams_touchdowns")) * F.lit(6.0) if special_teams else F.lit(0.0)
    return weighted_score(weights) + tiered(F.col("points_allowed")) + extra


def defender_score(weights: dict = DEFENDER) -> Column:
    return weighted_score(weights)
