"""DuckDB SQL for the operators that SQL can express; it follows the stated results, not the operators' methods."""

from __future__ import annotations

from .quality_rules import PRIOR, RATIOS, REACH, WIDTH

_SPREADS = "\n    UNION ALL ".join(
    f"SELECT r, lang, source, '{name}' AS ratio, CASE WHEN {below} > 0 THEN 10000 * {above} // {below} ELSE 0 END AS v FROM base"
    for name, above, below in (
        ("symbols", "n_symbols", "n_words"),
        ("dup_lines", "n_dup_lines", "n_lines"),
        ("repeats", "n_repeat_words", "n_words"),
        ("upper", "n_upper", "word_chars"),
    )
)
_SLACK = " ".join(f"WHEN '{name}' THEN {slack}" for name, slack in RATIOS.items())


def _fences(keys: str, counts: str) -> str:
    """Fence of each group of bucket counts."""
    return f"""SELECT {keys}, ratio, quartile + {WIDTH} * (quartile - low) + CASE ratio {_SLACK} END AS fence
    FROM (SELECT {keys}, ratio, min(bucket) FILTER (100 * upto >= 25 * docs) AS quartile, min(bucket) FILTER (100 * upto >= 5 * docs) AS low
        FROM (SELECT *, sum(n) OVER (PARTITION BY {keys}, ratio ORDER BY bucket) AS upto, sum(n) OVER (PARTITION BY {keys}, ratio) AS docs
              FROM {counts}) c GROUP BY ALL) q"""


ADAPTIVE_RULES = f"""
WITH rows AS (SELECT row_number() OVER () AS r, doc_id, lang, source, coalesce(text, '') AS text FROM documents),
words AS (SELECT r, regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+') AS w FROM rows),
places AS (SELECT r, w, unnest(range(1, len(w) - 1)) AS i FROM words WHERE len(w) >= 3),
windows AS (SELECT r, i, count(*) OVER (PARTITION BY r, w[i], w[i + 1], w[i + 2]) AS n FROM places),
repeated AS (SELECT r, count(DISTINCT k) AS n FROM (SELECT r, unnest([i, i + 1, i + 2]) AS k FROM windows WHERE n > 1) x GROUP BY r),
lines AS (SELECT r, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS l FROM rows),
base AS (
    SELECT rows.r, doc_id, lang, source, len(w) AS n_words, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0)::BIGINT AS word_chars,
        length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS n_symbols,
        len(l) - len(list_distinct(l)) AS n_dup_lines, coalesce(repeated.n, 0) AS n_repeat_words, len(l) AS n_lines,
        length(regexp_replace(text, '[^A-Z]', '', 'g')) AS n_upper
    FROM rows JOIN words USING (r) JOIN lines USING (r) LEFT JOIN repeated USING (r)),
judged AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM base),
ratios AS ({_SPREADS}),
sketch AS (
    SELECT ratios.lang, ratios.source, ratio, v // width * width AS bucket, count(*) AS n
    FROM (SELECT *, CAST(pow(2, greatest(length(bin(v)) - 6, 0)) AS BIGINT) AS width FROM ratios) ratios
    JOIN judged USING (r) WHERE NOT base_failed GROUP BY ALL),
language AS (SELECT lang, ratio, bucket, sum(n) AS n FROM sketch GROUP BY ALL),
sizes AS (SELECT lang, ratio, sum(n) AS docs FROM language GROUP BY ALL),
blend AS (
    SELECT lang, source, ratio, bucket, sum(n) AS n FROM (
        SELECT s.lang, s.source, s.ratio, s.bucket, s.n * d.docs AS n
        FROM sketch s JOIN sizes d ON s.lang IS NOT DISTINCT FROM d.lang AND s.ratio = d.ratio
        UNION ALL SELECT g.lang, g.source, l.ratio, l.bucket, {PRIOR} * l.n
        FROM (SELECT DISTINCT lang, source FROM sketch) g JOIN language l ON g.lang IS NOT DISTINCT FROM l.lang) x GROUP BY ALL),
own AS ({_fences("lang, source", "blend")}),
wide AS ({_fences("lang", "language")}),
fence AS (
    SELECT own.lang, own.source, own.ratio, least(own.fence, {REACH} * wide.fence) AS fence
    FROM own JOIN wide ON own.lang IS NOT DISTINCT FROM wide.lang AND own.ratio = wide.ratio),
above AS (
    SELECT DISTINCT r FROM ratios JOIN fence ON ratios.lang IS NOT DISTINCT FROM fence.lang
        AND ratios.source IS NOT DISTINCT FROM fence.source AND ratios.ratio = fence.ratio
    WHERE v > fence)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
    NOT base_failed AND r NOT IN (SELECT r FROM above) AS kept
FROM judged"""


def jaccard_components(words: int, percent: int) -> str:
    """All pairs that share a shingle, by exact similarity; components as reachability over links."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return f"""
WITH RECURSIVE words AS (
    SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{upper}', '{upper.lower()}'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
shingles AS (
    SELECT DISTINCT doc_id, array_to_string(w[i : i + {words - 1}], ' ') AS s
    FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - {words - 2}, 2))) AS i FROM words WHERE len(w) > 0) x),
sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
links AS (
    SELECT a.doc_id AS a, b.doc_id AS b FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id <> b.doc_id
    JOIN sizes x ON x.doc_id = a.doc_id JOIN sizes y ON y.doc_id = b.doc_id
    GROUP BY a.doc_id, b.doc_id HAVING 100 * count(*) >= {percent} * (any_value(x.n) + any_value(y.n) - count(*))),
reach AS (SELECT a, b FROM links UNION SELECT reach.a, links.b FROM reach JOIN links ON reach.b = links.a)
SELECT words.doc_id, coalesce(any_value(n), 0) AS n_shingles, least(words.doc_id, coalesce(min(reach.b), words.doc_id)) AS component_id
FROM words LEFT JOIN sizes ON sizes.doc_id = words.doc_id LEFT JOIN reach ON reach.a = words.doc_id GROUP BY words.doc_id"""


FILTER_AUDIT = """
WITH words AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
marks AS (SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS toxic FROM labels GROUP BY doc_id),
failed AS (
    SELECT part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic,
        CASE WHEN len(w) < 50 THEN 1 ELSE 0 END + CASE WHEN 100 * len(list_distinct(w)) < 65 * len(w) THEN 2 ELSE 0 END
        + CASE WHEN 100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 5 * length(text) THEN 4 ELSE 0 END
        + CASE WHEN regexp_matches(text, '[#$%&*|]') THEN 8 ELSE 0 END
        + CASE WHEN words.doc_id > min(words.doc_id) OVER (PARTITION BY text) THEN 16 ELSE 0 END AS mask
    FROM words LEFT JOIN marks ON words.doc_id = marks.doc_id),
masks AS (SELECT part, mask, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM failed GROUP BY part, mask),
bits AS (SELECT unnest(range(5)) AS b),
orders AS (
    SELECT [a.b, b.b, c.b, d.b, e.b] AS o FROM bits a, bits b, bits c, bits d, bits e
    WHERE len(list_distinct([a.b, b.b, c.b, d.b, e.b])) = 5),
steps AS (
    SELECT list_aggregate(list_transform(o, lambda x: substr('ABCDE', x + 1, 1)), 'string_agg', '') AS filter_order, s AS step,
        (1 << o[s]) AS bit, CAST(list_sum(list_transform(o[1 : s], lambda x: 1 << x)) AS BIGINT) AS upto
    FROM (SELECT o, unnest(range(1, 6)) AS s FROM orders) x),
counted AS (
    SELECT part, filter_order, step, bit,
        sum(CASE WHEN mask & upto = 0 THEN n ELSE 0 END) AS kept, sum(CASE WHEN mask & upto = bit THEN n ELSE 0 END) AS removed,
        sum(CASE WHEN mask & bit > 0 AND mask & upto <> bit THEN n ELSE 0 END) AS redundant,
        sum(CASE WHEN mask = bit THEN n ELSE 0 END) AS unique_fails,
        sum(CASE WHEN mask & upto = bit THEN good ELSE 0 END) AS good_lost, sum(CASE WHEN mask & upto = bit THEN toxic ELSE 0 END) AS toxic_lost
    FROM masks, steps GROUP BY part, filter_order, step, bit)
SELECT part, filter_order, CAST(step AS INTEGER) AS step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed,
    CAST(redundant AS BIGINT) AS redundant, CAST(unique_fails AS BIGINT) AS unique_fails, CAST(good_lost AS BIGINT) AS good_lost,
    CAST(toxic_lost AS BIGINT) AS toxic_lost, CAST(sum(removed) OVER (PARTITION BY part, bit) AS BIGINT) AS shapley
FROM counted"""


def merkle(levels: int) -> str:
    """Leaves, nodes and proofs of all trees, level by level; ``levels`` must suffice for the largest tree."""
    field = lambda c: f"CASE WHEN {c} IS NULL THEN '-' ELSE strlen(CAST({c} AS VARCHAR)) || ':' || CAST({c} AS VARCHAR) END"
    leaf = lambda text: "sha256(" + " || ".join(field(c) for c in ("doc_id", "source", "lang", "n_chars", text)) + ")"
    byte = "list_reduce([x, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, i: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)"
    crc = f"list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda d: ord(d)::BIGINT)), lambda a, b: xor(a >> 8, {byte.replace('[x,', '[xor(a, b) & 255,')}))"

    def trees(name: str, start: str) -> str:
        """Nodes per level, then the siblings of each first-level node on all levels."""
        parts = [f"{name}_0 AS (SELECT tree, pos, n, node FROM {start})"]
        for k in range(levels):
            parts.append(
                f"{name}_{k + 1} AS (SELECT tree, pos // 3 AS pos, any_value((n + 2) // 3) AS n, "
                f"CASE WHEN any_value(n) > 1 THEN sha256(string_agg(node, '' ORDER BY pos)) ELSE any_value(node) END AS node "
                f"FROM {name}_{k} GROUP BY tree, pos // 3)"
            )
            parts.append(
                f"{name}_near_{k} AS (SELECT a.tree, a.pos, coalesce(string_agg(b.node, '' ORDER BY b.pos) FILTER (b.pos < a.pos), '') AS l, "
                f"coalesce(string_agg(b.node, '' ORDER BY b.pos) FILTER (b.pos > a.pos), '') AS r FROM {name}_{k} a "
                f"JOIN {name}_{k} b ON a.tree = b.tree AND a.pos // 3 = b.pos // 3 GROUP BY a.tree, a.pos)"
            )
        joins = " ".join(
            f"JOIN {name}_near_{k} s{k} ON s{k}.tree = x.tree AND s{k}.pos = x.pos // {3**k}" for k in range(levels)
        )
        steps = ", ".join(f"{{'l': s{k}.l, 'r': s{k}.r, 'on': x.n > {3**k}}}" for k in range(levels))
        parts.append(
            f"{name} AS (SELECT x.*, top.node AS root, list_filter([{steps}], lambda s: s['on']) AS steps FROM {start} x {joins} "
            f"JOIN {name}_{levels} top ON top.tree = x.tree AND top.pos = 0)"
        )
        return ",\n".join(parts)

    folded = "list_reduce(list_prepend({'l': '', 'r': '', 'x': actual}, list_transform(steps, lambda s: {'l': s['l'], 'r': s['r'], 'x': ''})), lambda a, s: {'l': '', 'r': '', 'x': sha256(s['l'] || a['x'] || s['r'])})['x']"
    return f"""
WITH marked AS (SELECT *, coalesce(xor({crc}, 4294967295) % 2 = 0, false) AS cut FROM documents),
changed AS (SELECT *, CASE WHEN cut THEN replace(text, chr(10), '') ELSE text END AS kept FROM marked),
rows AS (SELECT coalesce('s' || source, '') AS tree, doc_id, {leaf("text")} AS node, {leaf("kept")} AS actual FROM changed),
placed AS (SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, node) - 1 AS pos, count(*) OVER (PARTITION BY tree) AS n FROM rows),
{trees("sources", "placed")},
subroots AS (SELECT '' AS tree, tree AS of, any_value(root) AS node, row_number() OVER (ORDER BY tree) - 1 AS pos, count(*) OVER () AS n FROM sources GROUP BY tree),
{trees("whole", "subroots")},
proven AS (SELECT doc_id, sources.node AS leaf, actual, sources.root AS subroot, whole.root AS root, list_concat(sources.steps, whole.steps) AS steps
    FROM sources JOIN whole ON whole.of = sources.tree)
SELECT doc_id, leaf, subroot, root, sha256(coalesce(list_aggregate(list_transform(steps, lambda s: s['l'] || s['r']), 'string_agg', ''), '')) AS proof_sha256,
    {folded} AS folded_root, {folded} = root AS verified
FROM proven"""


MERKLE = merkle(levels=14)
