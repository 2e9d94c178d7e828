"""The registered queries and the SQL that each must agree with."""

from __future__ import annotations

from . import board_queries, model_queries, panel_queries  # noqa: F401  they register their queries
from .views import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
