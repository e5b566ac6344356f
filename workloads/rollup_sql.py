"""Check SQL of the group roll-up, written level by level for the derived task graph."""

from __future__ import annotations

_KEY = "model, step, task, metric, metric_filter"

LATEST = f"""SELECT * FROM scores QUALIFY row_number() OVER (PARTITION BY {_KEY}
    ORDER BY eval_date DESC NULLS LAST, side DESC, result_source DESC, score DESC NULLS LAST, n_samples DESC) = 1"""

_COLS = """model, step, task, metric, metric_filter, score, n_samples, eval_date, language, higher_is_better, model_path,
    model_display_name, train_batch_size, tokens_trained"""


def _level(children: str, groups: str) -> str:
    first = lambda c, empty: f"arg_min({c}, child_pos) FILTER (WHERE {c} <> {empty})"
    agreed = lambda c: f"CASE WHEN min({c}) = max({c}) THEN min({c}) END"
    return f"""SELECT model, step, grp AS task, metric, 'none' AS metric_filter,
        CASE WHEN any_value(weight_by_size) AND max(w) > 1 THEN sum(score * w) / sum(w) ELSE sum(score) / count(*) END AS score,
        CAST(sum(w) AS BIGINT) AS n_samples, max(eval_date) AS eval_date, {agreed('language')} AS language,
        {agreed('higher_is_better')} AS higher_is_better, {first('model_path', "''")} AS model_path,
        coalesce({first('model_display_name', "''")}, model) AS model_display_name,
        {first('train_batch_size', '0')} AS train_batch_size,
        coalesce({first('tokens_trained', '0')}, {first('train_batch_size', '0')} * step) AS tokens_trained
        FROM (SELECT c.*, e.grp, e.weight_by_size, e.child_pos, CASE WHEN coalesce(c.n_samples, 0) = 0 THEN 1 ELSE c.n_samples END AS w
              FROM ({children}) c JOIN edges e ON c.task = e.child AND c.metric = e.metric AND c.metric_filter = e.metric_filter
              WHERE e.grp IN ({groups}) AND c.score IS NOT NULL) x
        GROUP BY model, step, grp, metric
        HAVING count(*) = (SELECT count(*) FROM edges a WHERE a.grp = x.grp AND a.metric = x.metric)"""


#: Tables up to ``rolled``; they expect ``latest`` (one leaf row per key).
ROLLED = {
    "leaf": "SELECT * FROM latest",
    "reported": "SELECT DISTINCT task, metric FROM leaf UNION SELECT grp, metric FROM group_metric",
    "pref": """SELECT task, metric, CASE WHEN bool_or(metric_filter = 'none') THEN 'none'
        ELSE arg_min(metric_filter, {{'m': model, 's': coalesce(step, -1), 'f': metric_filter}}) END AS metric_filter FROM leaf GROUP BY task, metric""",
    "applicable": """SELECT gc.grp, gm.metric, gm.weight_by_size, gc.child, gc.child_pos FROM group_child gc
        JOIN group_metric gm ON gc.grp = gm.grp JOIN reported r ON r.task = gc.child AND r.metric = gm.metric WHERE gc.grp <> 'lone'""",
    "edges": "SELECT a.*, coalesce(p.metric_filter, 'none') AS metric_filter FROM applicable a LEFT JOIN pref p ON p.task = a.child AND p.metric = a.metric",
    "r0": _level(f"SELECT {_COLS} FROM leaf", "SELECT grp FROM group_child WHERE grp LIKE 'region%'"),
    "r1": _level(f"SELECT {_COLS} FROM leaf UNION ALL SELECT {_COLS} FROM r0", "'west', 'world'"),
    "r2": _level(f"SELECT {_COLS} FROM leaf UNION ALL SELECT {_COLS} FROM r0 UNION ALL SELECT {_COLS} FROM r1", "'small'"),
    "rolled": f"""SELECT {_COLS}, CASE WHEN task IN ('world', 'small') THEN 'eval_suite' ELSE 'task_group' END AS task_type
        FROM (SELECT * FROM r0 UNION ALL SELECT * FROM r1 UNION ALL SELECT * FROM r2) u""",
}
