"""All registered queries by name, with their SQL twins."""

from __future__ import annotations

from . import queries_retrieval, queries_sampling, queries_scores, queries_training  # noqa: F401
from .registry import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
