"""All queries of the engine."""

from __future__ import annotations

from . import admin, analysis, answers, content, governed, guides, indexed, lifecycle, models, search, tabular  # noqa: F401
from .registry import ORACLE_SQL, QUERIES  # noqa: F401
