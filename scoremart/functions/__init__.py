from .joins import null_safe_join
from .text import (
    checkpoint_regex,
    clean_display_name,
    detect_language,
    format_tokens,
    iso_utc,
    manifest_key,
    parse_human_int,
    sanitize,
    suffix_class,
)

__all__ = [
    "checkpoint_regex",
    "clean_display_name",
    "detect_language",
    "format_tokens",
    "iso_utc",
    "manifest_key",
    "null_safe_join",
    "parse_human_int",
    "sanitize",
    "suffix_class",
]
