"""Catalogue, work planning and status."""

from __future__ import annotations

from pyspark.sql import functions as F

from scoremart import functions as fn
from scoremart.operators import catalogue as c
from scoremart.operators import hierarchy as h
from scoremart.operators import planning as p
from scoremart.operators import status as s
from scoremart.plans.run import plan_runs

from .q_rollup import nation_suites
from .registry import query

# ── catalogue ────────────────────────────────────────────────────────────────────────

_CAT = dict(
    typed="""SELECT *, CASE WHEN steps_text = '' THEN [] ELSE CAST(string_split(steps_text, ',') AS BIGINT[]) END AS steps,
        CASE tokens_text WHEN '5B,6.5B,7.25B' THEN [5000000000, 6500000000, 7250000000] WHEN '5B,6B' THEN [5000000000, 6000000000]
             WHEN '1.5T' THEN [1500000000000] END AS toks FROM entries""",
    resolved="""SELECT e.*, l.name AS label, CAST(regexp_extract(l.name, '(\\d+)', 1) AS BIGINT) AS raw_step, concat(e.path, '/', l.name) AS full_path
        FROM typed e JOIN listing l ON e.path = l.base AND regexp_matches(l.name,
            CASE WHEN checkpoint_pattern LIKE 'check%' THEN '^checkpoint_\\d+$' ELSE '^iter\\d+.*$' END)
        WHERE checkpoint_pattern IS NOT NULL AND (steps IS NULL OR list_contains(steps, CAST(regexp_extract(l.name, '(\\d+)', 1) AS BIGINT)))
        UNION ALL SELECT *, 'main', NULL, path FROM typed WHERE checkpoint_pattern IS NULL""",
    jobs="""SELECT run_id, concat(regexp_replace(coalesce(model_key, config_key), '[^a-zA-Z0-9_-]', '-', 'g'), '--', label) AS task_key,
        coalesce(model_key, config_key) AS model_key, label, raw_step + step_offset AS step, full_path AS model_path, display_name, train_batch_size,
        coalesce(CASE WHEN tokens_is_list THEN CASE WHEN list_position(steps, raw_step) > 0 THEN toks[list_position(steps, raw_step)] END
                 ELSE toks[1] END, train_batch_size * raw_step) AS tokens_trained FROM resolved""",
)


@query("build_manifest", "SELECT run_id, task_key, model_key, label, step, model_path, display_name, train_batch_size, tokens_trained FROM jobs", **_CAT)
def _(d):
    return c.build_manifest(d.entry_rows(), d.listing)


@query("resolve_checkpoints", "SELECT run_id, config_key, label, raw_step, full_path FROM resolved", **_CAT)
def _(d):
    return c.resolve_checkpoints(d.entry_rows(), d.listing).select("run_id", "config_key", "label", "raw_step", "full_path")


@query("unmatched_patterns", """SELECT run_id, config_key, path, checkpoint_pattern FROM typed WHERE checkpoint_pattern IS NOT NULL
        AND (run_id, config_key) NOT IN (SELECT (run_id, config_key) FROM resolved)""", **_CAT)
def _(d):
    return c.unmatched_patterns(d.entry_rows(), d.listing)


@query("manifest_key", """SELECT p_partkey, concat(regexp_replace(p_name, '[^a-zA-Z0-9_-]', '-', 'g'), '--',
        regexp_replace(p_brand, '[^a-zA-Z0-9_-]', '-', 'g')) AS task_key FROM part""")
def _(d):
    return d.part.select("p_partkey", fn.manifest_key("p_name", "p_brand").alias("task_key"))


@query("duplicate_manifest_keys", "SELECT run_id, task_key, count(*) AS n FROM jobs GROUP BY run_id, task_key HAVING count(*) > 1", **_CAT)
def _(d):
    return c.duplicate_manifest_keys(c.build_manifest(d.entry_rows(), d.listing))


@query("parse_human_int", """SELECT p_partkey, CASE p_size % 8 WHEN 0 THEN NULL WHEN 1 THEN p_partkey * 1000 WHEN 2 THEN NULL
        WHEN 3 THEN p_size * 1000 ELSE CAST((p_size * 100 + p_partkey % 100) * CASE p_size % 8 WHEN 4 THEN 10 WHEN 5 THEN 10000
        WHEN 6 THEN 10000000 ELSE 10000000000 END AS BIGINT) END AS n FROM part""")
def _(d):
    return d.part.select("p_partkey", fn.parse_human_int(human_text()).alias("n"))


def human_text():
    """Token counts as people write them: with units, separators, blanks and junk."""
    size, key = F.col("p_size"), F.col("p_partkey").cast("string")
    decimal = F.concat(size.cast("string"), F.lit("."), F.lpad((F.col("p_partkey") % 100).cast("string"), 2, "0"))
    kind = size % 8
    unit = F.when(kind == 4, "K").when(kind == 5, "m").when(kind == 6, "B").otherwise("T")
    return (
        F.when(kind == 0, F.lit("  "))
        .when(kind == 1, F.concat(key, F.lit("_000 ")))
        .when(kind == 2, F.lit("many"))
        .when(kind == 3, F.concat(size.cast("string"), F.lit("k")))
        .otherwise(F.concat(decimal, unit))
    )


_N = """SELECT p_partkey, CASE p_size % 6 WHEN 0 THEN NULL WHEN 1 THEN p_partkey WHEN 2 THEN p_partkey * 12345
    WHEN 3 THEN (p_partkey + 1) * 50000000 WHEN 4 THEN (p_partkey + 1) * 12500000000 ELSE p_size * 1000000000000 END AS n FROM {part}"""


@query("format_tokens", """SELECT p_partkey, CASE WHEN n IS NULL THEN '-' WHEN n >= 1000000000000 THEN concat(printf('%g', n / 1000000000000), 'T')
        WHEN n >= 1000000000 THEN concat(printf('%g', n / 1000000000), 'B') WHEN n >= 1000000 THEN concat(printf('%g', n / 1000000), 'M')
        ELSE format('{:,}', n) END AS shown FROM counts""", counts=_N)
def _(d):
    return d.sql(_N).select("p_partkey", fn.format_tokens("n").alias("shown"))


@query("catalogue_checks", """
    SELECT run_id, config_key, 'error' AS severity, 'steps without checkpoint_pattern' AS rule FROM typed WHERE steps IS NOT NULL AND checkpoint_pattern IS NULL
    UNION ALL SELECT run_id, config_key, 'error', 'empty steps' FROM typed WHERE len(steps) = 0
    UNION ALL SELECT run_id, config_key, 'error', 'tokens list without steps' FROM typed WHERE tokens_is_list AND steps IS NULL
    UNION ALL SELECT run_id, config_key, 'error', 'tokens list length differs from steps' FROM typed WHERE tokens_is_list AND len(toks) <> len(steps)
    UNION ALL SELECT run_id, config_key, 'warning', 'checkpoint model without token metadata' FROM typed
        WHERE checkpoint_pattern IS NOT NULL AND train_batch_size IS NULL AND toks IS NULL
    UNION ALL SELECT run_id, config_key, 'warning', 'model without token count' FROM typed WHERE checkpoint_pattern IS NULL AND toks IS NULL""", **_CAT)
def _(d):
    return c.catalogue_checks(d.entry_rows())


@query("catalogue_report", """SELECT run_id, task_key, display_name, label, model_path,
        model_path IN (SELECT base FROM listing UNION SELECT concat(base, '/', name) FROM listing) AS found,
        CASE WHEN coalesce(train_batch_size, 0) = 0 THEN '-' ELSE CAST(train_batch_size AS VARCHAR) END AS batch_size,
        CASE WHEN tokens_trained IS NULL THEN '-' WHEN tokens_trained >= 1000000000000 THEN concat(printf('%g', tokens_trained / 1000000000000), 'T')
             WHEN tokens_trained >= 1000000000 THEN concat(printf('%g', tokens_trained / 1000000000), 'B')
             WHEN tokens_trained >= 1000000 THEN concat(printf('%g', tokens_trained / 1000000), 'M') ELSE format('{:,}', tokens_trained) END AS tokens_trained
        FROM jobs""", **_CAT)
def _(d):
    return c.catalogue_report(d.entry_rows(), d.listing)


# ── expected tasks ───────────────────────────────────────────────────────────────────

_SUITE_PARTS = """SELECT n_nationkey AS n, CASE WHEN l_partkey IS NOT NULL THEN concat('part_', l_partkey)
        WHEN o_orderkey IS NOT NULL THEN concat('order_', o_orderkey) WHEN c_custkey IS NOT NULL THEN concat('cust_', c_custkey)
        ELSE concat('nation_', n_nationkey) END AS task,
        {{'c': coalesce(c_custkey, 0), 'o': coalesce(o_orderkey, 0), 'l': coalesce(l_linenumber, 0)}} AS way
    FROM nation LEFT JOIN customer ON c_nationkey = n_nationkey LEFT JOIN orders ON o_custkey = c_custkey
    LEFT JOIN lineitem ON l_orderkey = o_orderkey"""


def suite_parts(d):
    """All leaf tasks of all nations as a task map of one run; the path is the position."""
    return h.expand_suites(nation_suites(d), d.big_child).select(
        F.lit("all").alias("run_id"), "suite", "suite_pos", "task", F.col("path").alias("pos")
    )


@query("dedup_tasks_first_seen", """SELECT task, concat('nation_', arg_min(n, {'n': n, 'way': way})) AS suite FROM parts GROUP BY task""", parts=_SUITE_PARTS)
def _(d):
    return p.first_seen_tasks(suite_parts(d)).select("task", "suite")


@query("suite_task_counts", """SELECT run_id, suite, count(*) AS n_listed, count_if(first_pos = suite_pos) AS n_new, count_if(first_pos <> suite_pos) AS n_duplicate
        FROM (SELECT *, min(suite_pos) OVER (PARTITION BY run_id, task) AS first_pos FROM task_map) m GROUP BY run_id, suite""")
def _(d):
    return p.suite_task_counts(d.task_map)


_TASKS = """SELECT concat(replace(p_name, ' ', '_'), CASE p_size % 7 WHEN 0 THEN '_code' WHEN 1 THEN '_cot' WHEN 2 THEN '_gen' WHEN 3 THEN '_mc'
        WHEN 4 THEN '_rc' WHEN 5 THEN '' ELSE CAST(p_partkey AS STRING) END) AS task, p_partkey,
    CASE p_type WHEN 'ECONOMY' THEN NULL WHEN 'SMALL' THEN '' ELSE p_brand END AS dataset_path FROM {part}"""


@query("task_sort_order", """SELECT p_partkey, task, CASE WHEN task LIKE '%\\_code' ESCAPE '\\' THEN 0 WHEN task LIKE '%\\_cot' ESCAPE '\\' THEN 1
        WHEN task LIKE '%\\_gen' ESCAPE '\\' THEN 2 WHEN task LIKE '%\\_mc' ESCAPE '\\' THEN 3 WHEN task LIKE '%\\_rc' ESCAPE '\\' THEN 4 ELSE 5 END AS sort_class,
        regexp_extract(task, '(_[^_]*)$', 1) AS sort_suffix FROM tasks""", tasks=_TASKS)
def _(d):
    return p.order_tasks(d.sql(_TASKS)).select("p_partkey", "task", "sort_class", "sort_suffix")


_DATASET = "CASE WHEN dataset_path IS NULL THEN '__unknown__' WHEN dataset_path = '' THEN concat('__custom__', task) ELSE dataset_path END"


@query("dataset_group_sizes", f"SELECT {_DATASET} AS dataset, count(*) AS n_tasks FROM tasks GROUP BY 1", tasks=_TASKS)
def _(d):
    return p.dataset_group_sizes(d.sql(_TASKS))


# ── coverage ─────────────────────────────────────────────────────────────────────────

_COVER = dict(
    expected="SELECT DISTINCT run_id, task FROM task_map",
    cov="""SELECT DISTINCT m.run_id, m.task_key, s.task FROM manifest m JOIN shared s ON m.model_key = s.model AND m.step IS NOT DISTINCT FROM s.step
        JOIN expected e ON e.run_id = m.run_id AND e.task = s.task""",
    on_disk="""SELECT DISTINCT m.run_id, m.task_key, k.task FROM manifest m JOIN disk k ON m.model_key = k.model_key AND m.label = k.label
        JOIN expected e ON e.run_id = m.run_id AND e.task = k.task""",
    job_cover="""SELECT m.run_id, m.task_key, m.pos, (SELECT count(*) FROM expected e WHERE e.run_id = m.run_id) AS n_expected,
        (SELECT count(*) FROM on_disk o WHERE o.task_key = m.task_key) AS n_disk,
        (SELECT count(*) FROM cov c WHERE c.task_key = m.task_key AND c.task NOT IN (SELECT task FROM on_disk o WHERE o.task_key = m.task_key)) AS n_shared_only
        FROM manifest m""",
    remaining="""SELECT m.run_id, m.task_key, e.task, e.first_at FROM manifest m JOIN (SELECT run_id, task, min({{'s': suite_pos, 'p': pos}}) AS first_at
        FROM task_map GROUP BY run_id, task) e ON m.run_id = e.run_id
        WHERE (m.task_key, e.task) NOT IN (SELECT (task_key, task) FROM on_disk UNION SELECT (task_key, task) FROM cov)""",
)


def on_disk(d):
    return p.covered_on_disk(d.manifest, d.task_map, d.disk)


def covered(d):
    return p.covered_in_scores(d.manifest, d.task_map, d.shared)


def job_cover(d):
    return p.job_coverage(d.manifest, d.task_map, on_disk(d), covered(d))


@query("covered_in_scores", "SELECT run_id, task_key, task FROM cov", **_COVER)
def _(d):
    return covered(d)


@query("coverage_document", "SELECT run_id, task_key, string_agg(task, ',' ORDER BY task) AS tasks FROM cov GROUP BY run_id, task_key", **_COVER)
def _(d):
    return p.coverage_document(covered(d)).select("run_id", "task_key", F.array_join("tasks", ",").alias("tasks"))


@query("fully_covered_keys", """SELECT run_id, task_key FROM (SELECT m.run_id, m.task_key, (SELECT count(*) FROM expected e WHERE e.run_id = m.run_id) AS n,
        (SELECT count(DISTINCT s.task) FROM scores s JOIN expected e ON e.task = s.task AND e.run_id = m.run_id
         WHERE s.model = m.model_key AND s.step IS NOT DISTINCT FROM m.step AND s.side = 'F') AS have FROM manifest m) x
        WHERE n = have AND (run_id, task_key) NOT IN (SELECT (run_id, task_key) FROM completed)""", **_COVER)
def _(d):
    wide = p.covered_in_scores(d.manifest, d.task_map, d.scores.filter("side = 'F'"))
    return p.fully_covered_keys(wide, d.task_map, d.completed)


@query("covered_on_disk", "SELECT run_id, task_key, task FROM on_disk", **_COVER)
def _(d):
    return on_disk(d)


@query("coverage_counts", """SELECT run_id, CAST(sum(n_expected) AS BIGINT) AS total, CAST(sum(n_disk) AS BIGINT) AS on_disk, CAST(sum(n_shared_only) AS BIGINT) AS shared_only,
        count_if(n_disk + n_shared_only = n_expected) AS jobs_covered, count_if(n_disk + n_shared_only <> n_expected) AS jobs_remaining
        FROM job_cover GROUP BY run_id""", **_COVER)
def _(d):
    return p.coverage_counts(job_cover(d))


@query("run_summary", """SELECT run_id, count(*) AS jobs, max(n_expected) AS tasks_per_job, CAST(sum(n_disk) AS BIGINT) AS on_disk,
        CAST(sum(n_shared_only) AS BIGINT) AS shared_only, count_if(n_disk + n_shared_only <> n_expected) AS jobs_to_evaluate,
        CAST(sum(n_expected - n_disk - n_shared_only) AS BIGINT) AS tasks_to_evaluate FROM job_cover GROUP BY run_id""", **_COVER)
def _(d):
    return p.run_summary(job_cover(d))


@query("locally_complete_keys", """SELECT run_id, task_key FROM job_cover WHERE n_expected > 0 AND n_disk + n_shared_only = n_expected
        AND (run_id, task_key) NOT IN (SELECT (run_id, task_key) FROM completed)""", **_COVER)
def _(d):
    return p.locally_complete_keys(job_cover(d), d.completed)


_OPEN = """SELECT run_id, task_key, pos FROM manifest WHERE (run_id, task_key) NOT IN (SELECT (run_id, task_key) FROM completed)
    AND (run_id, task_key) NOT IN (SELECT (run_id, task_key) FROM active)"""


@query("keys_to_submit", "SELECT run_id, task_key, pos FROM open_jobs", open_jobs=_OPEN)
def _(d):
    return p.keys_to_submit(d.manifest, d.completed, d.active).select("run_id", "task_key", "pos")


_QUEUED = "SELECT a.* FROM active a JOIN manifest m ON a.run_id = m.run_id AND a.task_key = m.task_key"


@query("submit_summary", """SELECT run_id, 'total' AS measure, count(*) AS n FROM manifest GROUP BY run_id
    UNION ALL SELECT run_id, 'completed', count(*) FROM completed GROUP BY run_id
    UNION ALL SELECT run_id, concat('queued ', lower(state)), count(*) FROM queued GROUP BY run_id, state
    UNION ALL SELECT run_id, 'in queue', count(DISTINCT task_key) FROM queued GROUP BY run_id
    UNION ALL SELECT run_id, 'to submit', count(*) FROM open_jobs GROUP BY run_id""", queued=_QUEUED, open_jobs=_OPEN)
def _(d):
    return p.submit_summary(d.manifest, d.completed, d.active)


def remaining(d):
    return p.remaining_tasks(d.manifest, d.task_map, on_disk(d), covered(d))


@query("remaining_tasks", "SELECT run_id, task_key, string_agg(task, ',' ORDER BY first_at) AS tasks FROM remaining GROUP BY run_id, task_key", **_COVER)
def _(d):
    return remaining(d).filter(F.size("remaining") > 0).select("run_id", "task_key", F.array_join("remaining", ",").alias("tasks"))


@query("plan_batches", """SELECT run_id, task_key, CAST(rn // eff AS INTEGER) AS batch_no, string_agg(task, ',' ORDER BY rn) AS tasks FROM (
        SELECT *, row_number() OVER (PARTITION BY run_id, task_key ORDER BY first_at) - 1 AS rn,
        CASE WHEN n <= 2 THEN 1 ELSE least(8, CAST(ceil(n / 2) AS BIGINT)) END AS eff
        FROM (SELECT *, count(*) OVER (PARTITION BY run_id, task_key) AS n FROM remaining) c) b GROUP BY run_id, task_key, rn // eff""", **_COVER)
def _(d):
    return p.plan_batches(remaining(d), parallel=2, batch=8)


# The catalogue without entries that break a rule, each under its own name.
_VALID = {
    **_CAT,
    "typed": "SELECT * REPLACE (CAST(NULL AS VARCHAR) AS model_key) FROM (" + _CAT["typed"] + """) t
        WHERE (steps IS NULL OR (checkpoint_pattern IS NOT NULL AND len(steps) > 0))
          AND NOT (tokens_is_list AND (steps IS NULL OR len(toks) <> len(steps)))""",
}


@query("plan_runs", """SELECT run_id, task_key, CAST(rn // eff AS INTEGER) AS batch_no, string_agg(task, ',' ORDER BY rn) AS tasks FROM (
        SELECT *, row_number() OVER (PARTITION BY run_id, task_key ORDER BY first_at) - 1 AS rn,
        CASE WHEN n <= 4 THEN 1 ELSE least(8, CAST(ceil(n / 4) AS BIGINT)) END AS eff
        FROM (SELECT *, count(*) OVER (PARTITION BY run_id, task_key) AS n FROM
            (SELECT j.run_id, j.task_key, e.task, e.first_at FROM unique_jobs j JOIN (SELECT run_id, task, min({'s': suite_pos, 'p': pos}) AS first_at
                 FROM task_map GROUP BY run_id, task) e ON j.run_id = e.run_id
             LEFT JOIN scores s ON s.side = 'F' AND s.metric = 'f1' AND s.model = j.model_key AND s.step IS NOT DISTINCT FROM j.step AND s.task = e.task
             WHERE s.task IS NULL AND (j.run_id, j.task_key) NOT IN (SELECT (run_id, task_key) FROM completed)
                AND (j.run_id, j.task_key) NOT IN (SELECT (run_id, task_key) FROM active)) r) c) b GROUP BY run_id, task_key, rn // eff""",
       **_VALID, unique_jobs="SELECT *, coalesce(model_path, '') AS p FROM jobs")
def _(d):
    entries = d.entry_rows().withColumn("model_key", F.lit(None).cast("string"))  # named by entry, so keys are unique
    errors = c.catalogue_checks(entries).filter("severity = 'error'").select("run_id", "config_key")
    lost = c.unmatched_patterns(entries, d.listing).select("run_id", "config_key")
    entries = entries.join(errors.unionByName(lost), ["run_id", "config_key"], "left_anti")
    plan = plan_runs(entries, d.listing, d.task_map, d.shared, d.disk, d.completed, d.active, parallel=4, batch=8)
    return plan.batches


# ── status ───────────────────────────────────────────────────────────────────────────


@query("suite_progress", """SELECT m.run_id, m.task_key, t.suite, count(*) AS total,
        count_if((m.task_key, t.task) IN (SELECT (task_key, task) FROM on_disk)) AS done
        FROM manifest m JOIN task_map t ON m.run_id = t.run_id GROUP BY m.run_id, m.task_key, t.suite""", **_COVER)
def _(d):
    return s.suite_progress(d.manifest, d.task_map, on_disk(d))


@query("unique_progress", "SELECT run_id, task_key, n_disk AS local, n_shared_only AS shared_only, n_expected AS total FROM job_cover", **_COVER)
def _(d):
    return s.unique_progress(job_cover(d))


STATUS = dict(
    **_COVER,
    last_queue="SELECT * FROM active QUALIFY row_number() OVER (PARTITION BY run_id, task_key ORDER BY pos DESC) = 1",
    last_fail="""SELECT run_id, job_key, o_orderstatus FROM failed_lines WHERE o_orderpriority <> '4-NOT SPECIFIED'
        QUALIFY row_number() OVER (PARTITION BY run_id, job_key ORDER BY line_order DESC) = 1""",
    states="""SELECT j.run_id, j.task_key, CASE WHEN c.task_key IS NOT NULL OR n_disk + n_shared_only = n_expected THEN 'completed'
        WHEN q.state = 'PENDING' THEN 'pending' WHEN q.state IS NOT NULL THEN 'running' WHEN f.job_key IS NOT NULL THEN 'failed'
        ELSE 'not_started' END AS state, q.job_id, q.state AS q_state, f.o_orderstatus, n_disk, n_shared_only, n_expected
        FROM job_cover j LEFT JOIN completed c ON c.run_id = j.run_id AND c.task_key = j.task_key
        LEFT JOIN last_queue q ON q.run_id = j.run_id AND q.task_key = j.task_key
        LEFT JOIN last_fail f ON f.run_id = j.run_id AND f.job_key = j.task_key""",
)


def failed(d):
    from scoremart.sources import failed_jobs

    return failed_jobs(d.failed_lines.select("run_id", "line", "line_order"))


def states(d):
    return s.job_states(job_cover(d), d.completed, d.active, failed(d))


@query("job_state", "SELECT run_id, task_key, state FROM states", **STATUS)
def _(d):
    return states(d).select("run_id", "task_key", "state")


@query("job_info", """SELECT run_id, task_key, CASE WHEN q_state IS NOT NULL THEN concat(job_id, ' ', q_state) WHEN state = 'failed' THEN
        CASE o_orderstatus WHEN 'P' THEN 'eval_failures' WHEN 'O' THEN 'health_check_failed' ELSE 'manual_cancellation' END ELSE '' END AS info FROM states""", **STATUS)
def _(d):
    return states(d).select("run_id", "task_key", "info")


@query("status_rollup", """SELECT run_id, CAST(sum(n_disk + n_shared_only) AS BIGINT) AS tasks_done,
        CAST(sum(n_expected - n_disk - n_shared_only) AS BIGINT) AS tasks_remaining,
        round(100.0 * sum(n_disk + n_shared_only) / sum(n_expected), 4) AS pct, count_if(state = 'completed') AS completed, count_if(state = 'running') AS running,
        count_if(state = 'pending') AS pending, count_if(state = 'failed') AS failed, count_if(state = 'not_started') AS not_started
        FROM states GROUP BY run_id""", **STATUS)
def _(d):
    return s.status_rollup(states(d)).withColumn("pct", F.round("pct", 4))


@query("active_jobs_of_run", "SELECT run_id, task_key, job_id, state, pos FROM queued WHERE job_id IS NOT NULL", queued=_QUEUED)
def _(d):
    return s.active_jobs_of_run(d.manifest, d.active).select("run_id", "task_key", "job_id", "state", "pos")


@query("latest_job_per_key", "SELECT run_id, task_key, job_id, state FROM last_queue", **STATUS)
def _(d):
    return s.latest_job_per_key(d.active)
