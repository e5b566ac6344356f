"""End-to-end jobs composed from operators."""

from .collect import CollectResult, assemble_into, assemble_scores, collect_run, push_merge
from .run import RunPlan, plan_runs, run_status

__all__ = ["CollectResult", "RunPlan", "assemble_into", "assemble_scores", "collect_run", "plan_runs", "push_merge", "run_status"]
