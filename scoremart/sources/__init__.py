from .control import (
    active_jobs,
    completed_keys,
    covered_pairs,
    failed_jobs,
    manifest_rows,
    queue_rows,
    read_documents,
    read_lines,
    task_map_rows,
)
from .groups import parse_group_defs, read_group_defs
from .results import latest_per_dir, scan_result_files, stage_result_files, stream_result_files
from .score_table import ScoreTable, TableChange
from .tables import export_form, publish_view, read_scores, write_scores

__all__ = [
    "ScoreTable",
    "TableChange",
    "active_jobs",
    "completed_keys",
    "covered_pairs",
    "export_form",
    "failed_jobs",
    "latest_per_dir",
    "manifest_rows",
    "parse_group_defs",
    "publish_view",
    "queue_rows",
    "read_documents",
    "read_group_defs",
    "read_lines",
    "read_scores",
    "scan_result_files",
    "stage_result_files",
    "stream_result_files",
    "task_map_rows",
    "write_scores",
]
