"""Scalar expressions on names, dates and token counts.  All stay JVM-side."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Task-name prefix -> ISO 639-3 code, first match wins.
LANGUAGE_PREFIXES = [("deu_", "deu"), ("german_", "deu"), ("eng_", "eng"), ("fin_", "fin")]
DEFAULT_LANGUAGE = "eng"

# Task-name suffixes in scheduling order.
SUFFIX_ORDER = ["_code", "_cot", "_gen", "_mc", "_rc"]

# Unit suffixes of token counts.
UNITS = {"K": 10**3, "M": 10**6, "B": 10**9, "T": 10**12}


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def detect_language(task: Column | str) -> Column:
    task = _col(task)
    return F.coalesce(
        *[F.when(task.startswith(prefix), F.lit(code)) for prefix, code in LANGUAGE_PREFIXES],
        F.lit(DEFAULT_LANGUAGE),
    )


def clean_display_name(alias: Column, task: Column) -> Column:
    """Alias without surrounding blanks and hyphens; a missing or empty alias gives the task."""
    alias = F.coalesce(alias, F.lit(""))
    stripped = F.regexp_replace(alias, "^[ -]+|[ -]+$", "")
    return F.when(alias == "", task).otherwise(stripped)


def sanitize(name: Column | str) -> Column:
    return F.regexp_replace(_col(name), "[^a-zA-Z0-9_-]", "-")


def manifest_key(model: Column | str, label: Column | str) -> Column:
    return F.concat_ws("--", sanitize(model), sanitize(label))


def checkpoint_regex(pattern: Column | str) -> Column:
    """Anchored regex of a checkpoint directory pattern: ``{step}`` is digits, ``*`` anything."""
    escaped = F.regexp_replace(_col(pattern), "([^A-Za-z0-9_])", r"\\$1")
    with_step = F.replace(escaped, F.lit(r"\{step\}"), F.lit(r"(\d+)"))
    return F.concat(F.lit("^"), F.replace(with_step, F.lit(r"\*"), F.lit(".*")), F.lit("$"))


def parse_human_int(text: Column | str) -> Column:
    """``100B``, ``1.5M``, ``2_000`` -> bigint.  Blank is null; so is anything unreadable."""
    cleaned = F.replace(F.trim(_col(text).cast("string")), F.lit("_"), F.lit(""))
    unit = F.upper(F.right(cleaned, F.lit(1)))
    factor = F.coalesce(*[F.when(unit == u, F.lit(n).cast("decimal(13,0)")) for u, n in UNITS.items()])
    number = F.substring(cleaned, F.lit(1), F.length(cleaned) - 1)
    scaled = F.bround(number.try_cast("decimal(24,9)") * factor).try_cast("bigint")
    whole = F.when(cleaned.rlike(r"^[+-]?\d+$"), cleaned.try_cast("bigint"))
    return F.when(cleaned == "", F.lit(None).cast("bigint")).when(factor.isNotNull(), scaled).otherwise(whole)


def format_tokens(n: Column | str) -> Column:
    """Short display of a token count: ``36T``, ``5.507T``, ``100B``, ``1,500``, ``-`` for null.

    Six significant digits of the quotient, rounded as a double would be: where its decimal
    value is exactly half-way, the side on which the double lies decides, and if it is exact
    the even digit.
    """
    n = _col(n)
    units = ["T", "B", "M"]
    pick = lambda values: F.coalesce(*[F.when(n >= UNITS[u], F.lit(v)) for u, v in zip(units, values)])
    size = pick([UNITS[u] for u in units])
    ratio = n.cast("decimal(20,0)") / size.cast("decimal(13,0)")
    # The more digits before the point, the fewer after it.
    shift = F.coalesce(*[F.when(ratio < 10 ** (6 - k), F.lit(10**k)) for k in range(5, 0, -1)], F.lit(1))
    shifted = ratio * shift.cast("decimal(6,0)")
    floor = F.floor(shifted)
    rest = shifted - floor
    half = F.lit("0.5").cast("decimal(2,1)")
    # Times 2^52 (2^42 for large quotients) the double is a whole number: an exact comparison.
    bits = F.when(ratio < 1024, F.lit(2**52)).when(ratio < 10**6, F.lit(2**42)).otherwise(F.lit(1))
    double = ((n / size) * bits).cast("bigint").cast("decimal(20,0)") * size.cast("decimal(13,0)")
    exact = n.cast("decimal(20,0)") * bits.cast("decimal(16,0)")
    down = (rest < half) | ((rest == half) & ((double < exact) | ((double == exact) & (floor % 2 == 0))))
    whole = F.when(down, floor).otherwise(floor + 1)
    digits = F.regexp_replace((whole / shift).cast("decimal(20,5)").cast("string"), r"\.?0+$", "")
    return (
        F.when(n.isNull(), F.lit("-"))
        .when(size.isNull(), F.format_number(n, 0))
        .otherwise(F.concat(digits, pick(units)))
    )


def suffix_class(task: Column | str) -> tuple[Column, Column]:
    """(rank, suffix) by which tasks are ordered ahead of their name."""
    task = _col(task)
    known = [F.when(task.endswith(s), F.lit(i)) for i, s in enumerate(SUFFIX_ORDER)]
    rank = F.coalesce(*known, F.lit(len(SUFFIX_ORDER)))
    suffix = F.when(
        rank < len(SUFFIX_ORDER),
        F.element_at(F.array(*[F.lit(s) for s in SUFFIX_ORDER]), F.least(rank + 1, F.lit(len(SUFFIX_ORDER)))),
    ).otherwise(F.regexp_extract(task, r"(_[^_]*)$", 1))
    return rank, suffix


def iso_utc(ts: Column | str) -> Column:
    """ISO-8601 text in UTC of a zone-less UTC timestamp; micros only when there are any."""
    ts = _col(ts)
    base = F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss")
    micros = F.date_format(ts, "SSSSSS")
    return F.concat(base, F.when(micros != "000000", F.concat(F.lit("."), micros)).otherwise(F.lit("")), F.lit("+00:00"))
