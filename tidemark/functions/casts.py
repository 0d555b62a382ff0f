"""Casts that turn bad text into NULL instead of failing the job."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed formats of the source files. ``X`` reads the trailing zone, so the instant does not
# depend on the session zone.
CSV_DAY = "yy.dd.MM"
JSON_INSTANT = "yyyy-MM-dd'T'HH:mm:ssX"
CSV_INSTANT = "yyyy-MM-dd'T'HH:mm:ss.SSSX"

# Shapes of text that the casts below can accept. A failing ``try_`` function raises and catches
# an exception per row, which costs a hundred times the cast: text of another shape is turned away
# first. The shapes are wide, the cast decides.
_INT = r"^[\s\p{Cntrl}]*[+-]?0*[0-9]{1,10}[\s\p{Cntrl}]*$"
_BIGINT = r"^[\s\p{Cntrl}]*[+-]?0*[0-9]{1,19}[\s\p{Cntrl}]*$"
_FLAG = r"(?i)^[\s\p{Cntrl}]*(t|true|y|yes|1|f|false|n|no|0)[\s\p{Cntrl}]*$"
_SHAPES = {
    CSV_DAY: r"^\d\d\.\d\d\.\d\d$",
    JSON_INSTANT: r"^[+-]?\d{4,}-\d\d-\d\dT\d\d:\d\d:\d\d(Z|[+-]\d\d(\d\d)?)$",
    CSV_INSTANT: r"^[+-]?\d{4,}-\d\d-\d\dT\d\d:\d\d:\d\d\.\d{3}(Z|[+-]\d\d(\d\d)?)$",
}


def _shaped(text: Column, shape: str | None, value: Column) -> Column:
    return value if shape is None else F.when(text.rlike(shape), value)


def safe_cast(value: Column, kind: str) -> Column:
    """Trimmed text as ``kind``, NULL where it is not one."""
    text = F.trim(value)
    shape = {"int": _INT, "bigint": _BIGINT, "boolean": _FLAG}.get(kind)
    return _shaped(text, shape, text.try_cast(kind))


def to_int(value: Column) -> Column:
    return safe_cast(value, "int")


def to_long(value: Column) -> Column:
    return safe_cast(value, "bigint")


def to_bool(value: Column) -> Column:
    return safe_cast(value, "boolean")


def to_day(value: Column, fmt: str = CSV_DAY) -> Column:
    text = F.trim(value)
    return _shaped(text, _SHAPES.get(fmt), F.try_to_date(text, fmt))


def to_instant(value: Column, fmt: str = JSON_INSTANT) -> Column:
    """Padding is not accepted here; trim the text first where its source pads it."""
    return _shaped(value, _SHAPES.get(fmt), F.try_to_timestamp(value, F.lit(fmt)))
