"""Named queries over the test tables and their reference SQL."""

from tonemill.plans import q_io, q_models, q_views, queries  # noqa: F401  (register the queries)
from tonemill.plans.registry import ORACLE, QUERIES

__all__ = ["ORACLE", "QUERIES"]
