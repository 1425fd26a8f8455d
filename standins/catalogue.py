"""All registered queries."""

from standins import (  # noqa: F401
    file_queries,
    letter_queries,
    score_queries,
    timeline_queries,
    work_queries,
)
from standins.registry import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
