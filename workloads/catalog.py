"""All registered queries."""

from . import q_merge, q_parse, q_plan, q_rollup, q_runs, q_stream  # noqa: F401  (registration)
from .registry import QUERIES, runner

__all__ = ["QUERIES", "runner"]
