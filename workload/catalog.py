"""All registered queries and their SQL."""

from workload import (  # noqa: F401
    cleaning_queries,
    decision_queries,
    learning_queries,
    source_queries,
    text_queries,
)
from workload.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
