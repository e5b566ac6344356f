"""Declared schemas of every table the library reads or writes."""

from __future__ import annotations

from pyspark.sql import types as T

_STR, _LONG, _DBL, _BOOL = T.StringType(), T.LongType(), T.DoubleType(), T.BooleanType()


def _struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(name, dtype) for name, dtype in fields.items()])


#: Composite key of a score row.  ``step`` is the only nullable member.
KEY = ["model", "step", "task", "metric", "metric_filter"]

EVAL_CONFIG = _struct(
    lm_eval_version=_STR,
    git_hash=_STR,
    transformers_version=_STR,
    model_name=_STR,
    model_source=_STR,
    max_length=_LONG,
    total_eval_time_seconds=_DBL,
    tokenizer_pad_token=_STR,
    tokenizer_eos_token=_STR,
    tokenizer_bos_token=_STR,
    eot_token_id=_LONG,
    chat_template=_STR,
    chat_template_sha=_STR,
    system_instruction=_STR,
    system_instruction_sha=_STR,
)

TASK_CONFIG = _struct(
    task_version=_STR,
    task_hash=_STR,
    dataset_path=_STR,
    output_type=_STR,
    dataset_name=_STR,
    repeats=_LONG,
    doc_to_text=_STR,
    doc_to_target=_STR,
    doc_to_choice=_STR,
    generation_kwargs=_STR,
    should_decontaminate=_BOOL,
)

#: The score fact table.  ``eval_date`` is a zone-less timestamp holding UTC, so results
#: do not depend on the session time zone.
SCORE = _struct(
    model=_STR,
    step=_LONG,
    task=_STR,
    metric=_STR,
    metric_filter=_STR,
    score=_DBL,
    score_stderr=_DBL,
    task_type=_STR,
    parent_task=_STR,
    task_display_name=_STR,
    num_fewshot=_LONG,
    task_formulation=_STR,
    higher_is_better=_BOOL,
    language=_STR,
    n_samples=_LONG,
    subtask_tree=T.MapType(_STR, T.ArrayType(_STR)),
    train_batch_size=_LONG,
    tokens_trained=_LONG,
    eval_date=T.TimestampNTZType(),
    result_source=_STR,
    eval_config=EVAL_CONFIG,
    task_config=TASK_CONFIG,
    model_path=_STR,
    is_checkpoint=_BOOL,
    model_display_name=_STR,
)

#: One job (model at one checkpoint) of one run.
MANIFEST_ENTRY = _struct(
    model_key=_STR,
    label=_STR,
    step=_LONG,
    model_path=_STR,
    display_name=_STR,
    train_batch_size=_LONG,
    tokens_trained=_LONG,
)

#: One raw result file, whichever source delivered it.
RESULT_FILE = T.StructType(
    [
        T.StructField("model_key", _STR),
        T.StructField("label", _STR),
        T.StructField("dir", _STR),
        T.StructField("path", _STR),
        T.StructField("mtime", T.TimestampType()),
        T.StructField("content", _STR),
    ]
)

#: Typed view of a result document.  Task and metric names are data, so they are map
#: keys; values keep their JSON type as variants because "0.5" and 0.5 differ, and because
#: each field has its own rule for other types (operators/lenient.py).
RESULT_DOC = """
    results map<string, map<string, variant>>,
    configs map<string, variant>,
    group_subtasks map<string, array<string>>,
    higher_is_better map<string, map<string, variant>>,
    `n-shot` map<string, variant>,
    `n-samples` map<string, variant>,
    versions map<string, string>,
    task_hashes map<string, variant>,
    date variant,
    lm_eval_version variant, git_hash variant, transformers_version variant,
    model_name variant, model_source variant, max_length variant,
    total_evaluation_time_seconds variant,
    tokenizer_pad_token variant, tokenizer_eos_token variant, tokenizer_bos_token variant,
    eot_token_id variant, chat_template variant, chat_template_sha variant,
    system_instruction variant, system_instruction_sha variant,
    _corrupt string
"""
