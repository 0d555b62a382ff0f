"""Column functions: every one returns a built-in Spark expression."""

from tidemark.functions.casts import to_bool, to_day, to_instant, to_int, to_long
from tidemark.functions.paths import (
    batch_date_from_path,
    batch_hour_from_path,
    decode_key,
    region_from_path,
    scanned_file,
)
from tidemark.functions.ratio import safe_pct
from tidemark.functions.text import is_blank, strip, utc_iso

__all__ = [
    "batch_date_from_path",
    "batch_hour_from_path",
    "decode_key",
    "is_blank",
    "region_from_path",
    "safe_pct",
    "scanned_file",
    "strip",
    "to_bool",
    "to_day",
    "to_instant",
    "to_int",
    "to_long",
    "utc_iso",
]
