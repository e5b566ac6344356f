"""DataFrame-to-DataFrame operators, by area."""

from . import catalogue, diff, hierarchy, maintain, merge, parse, planning, rollup, status

__all__ = ["catalogue", "diff", "hierarchy", "maintain", "merge", "parse", "planning", "rollup", "status"]
