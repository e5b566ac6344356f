"""Lenient typing of JSON values: a value is taken as it is, converted, or a reason to reject its file.

Every rule gives the converted value, null for null and for what it rejects; :func:`rejects` tells those apart.  Numbers in
text count as numbers where a number is wanted, numbers are never text, and truth values may be written as words.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words for truth values.
TRUE_WORDS = ["1", "on", "t", "true", "y", "yes"]
FALSE_WORDS = ["0", "f", "false", "n", "no", "off"]
_WHOLE = r"^\s*[+-]?[0-9]+(_[0-9]+)*(\.0+)?\s*$"
_NUMBER = r"(?i)^\s*[+-]?(([0-9]+(_[0-9]+)*\.?[0-9]*|\.[0-9]+)(e[+-]?[0-9]+)?|inf|infinity|nan)\s*$"


def kind(value: Column) -> Column:
    return F.schema_of_variant(value)


def is_missing(value: Column) -> Column:
    return value.isNull() | (kind(value) == "VOID")


def _is_number(value: Column) -> Column:
    return kind(value).rlike("^(BIGINT|DOUBLE|FLOAT|DECIMAL)")


def plain_text(value: Column) -> Column:
    """Text only."""
    return F.when(kind(value) == "STRING", F.try_variant_get(value, "$", "string"))


def number(value: Column) -> Column:
    """Numbers, truth values as 0 and 1, and text that reads as a number."""
    text = F.try_variant_get(value, "$", "string")
    read = F.when(text.rlike(_NUMBER), F.translate(F.trim(text), "_", "").try_cast("double"))
    return F.when(kind(value) == "STRING", read).otherwise(F.try_variant_get(value, "$", "double"))


def whole_number(value: Column) -> Column:
    """Numbers without a fraction, of any notation."""
    text = F.try_variant_get(value, "$", "string")
    digits = F.translate(F.regexp_replace(F.trim(text), r"\.0+$", ""), "_", "")
    read = F.when(text.rlike(_WHOLE), digits.try_cast("bigint"))
    real = F.try_variant_get(value, "$", "double")
    exact = F.when((F.floor(real) == real) & (F.abs(real) < float(2**63)), real.cast("decimal(38,0)").try_cast("bigint"))
    return (
        F.when(kind(value) == "BIGINT", F.try_variant_get(value, "$", "bigint"))
        .when(kind(value) == "STRING", read)
        .when(kind(value) == "BOOLEAN", F.try_variant_get(value, "$", "boolean").cast("bigint"))
        .when(_is_number(value), exact)
    )


def truth_value(value: Column) -> Column:
    """Truth values, 0 and 1, and the words for them."""
    word = F.lower(F.try_variant_get(value, "$", "string"))
    read = F.when(word.isin(TRUE_WORDS), F.lit(True)).when(word.isin(FALSE_WORDS), F.lit(False))
    real = F.try_variant_get(value, "$", "double")
    return (
        F.when(kind(value) == "BOOLEAN", F.try_variant_get(value, "$", "boolean"))
        .when(kind(value) == "STRING", read)
        .when(_is_number(value), F.when(real == 1, F.lit(True)).when(real == 0, F.lit(False)))
    )


#: Kinds that a rule always has a place for.  Telling a value's kind is the costly part, so most values take one look.
_SURE = {plain_text: ["STRING"], number: ["BIGINT", "DOUBLE", "BOOLEAN"], whole_number: ["BIGINT", "BOOLEAN"], truth_value: ["BOOLEAN"]}


def rejects(rule: Callable[[Column], Column], value: Column) -> Column:
    """Whether ``rule`` has no place for the value."""
    return F.coalesce(~kind(value).isin("VOID", *_SURE[rule]) & rule(value).isNull(), F.lit(False))


def is_nested(value: Column) -> Column:
    return F.coalesce(kind(value).rlike("^(ARRAY|OBJECT)"), F.lit(False))


def counts_as_nothing(value: Column) -> Column:
    """Null, false, zero, and empty text, lists and objects."""
    text = F.try_variant_get(value, "$", "string")
    empty = (
        F.when(kind(value) == "BOOLEAN", text == "false")
        .when(kind(value) == "STRING", text == "")
        .when(_is_number(value), F.try_variant_get(value, "$", "double") == 0)
        .when(kind(value).startswith("OBJECT"), F.size(F.map_keys(F.try_variant_get(value, "$", "map<string,variant>"))) == 0)
        .otherwise(F.size(F.try_variant_get(value, "$", "array<variant>")) == 0)
    )
    return is_missing(value) | F.coalesce(empty, F.lit(False))
