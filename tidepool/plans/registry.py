"""The registered queries and their SQL twins."""

from __future__ import annotations

from tidepool.plans.oracles import SQL as ORACLES
from tidepool.plans.queries import QUERIES

__all__ = ["ORACLES", "QUERIES"]
