"""All queries of the library, by importing the modules that register them."""

from __future__ import annotations

from . import alerts, derived, evaluation, extend, ingest, models, monitoring, profiles, quality, segments, transactions
from .registry import ORACLE, QUERIES

__all__ = ["ORACLE", "QUERIES", "alerts", "derived", "evaluation", "extend", "ingest", "models", "monitoring", "profiles", "quality", "segments", "transactions"]
