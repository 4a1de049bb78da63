"""All queries of the library, by import."""

from . import job_queries, metric_queries, split_queries, text_queries  # noqa: F401
from .registry import ORACLE, QUERIES

__all__ = ["ORACLE", "QUERIES"]
