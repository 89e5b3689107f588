"""All registered queries."""

from __future__ import annotations

from inkstone.plans import (  # noqa: F401
    fusion_queries,
    lexicon_queries,
    line_queries,
    log_queries,
    page_queries,
    quality_queries,
    text_queries,
)
from inkstone.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
