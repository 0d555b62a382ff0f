"""Guarded ratios."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def safe_pct(part: Column, whole: Column, places: int = 2) -> Column:
    """``part`` as a percentage of ``whole``, NULL when ``whole`` is zero.

    The division runs in decimal arithmetic, so ties round half up; the result is a double.
    """
    hundred = F.lit("100.0").cast("decimal(4,1)")
    return F.round(part * hundred / F.nullif(whole, F.lit(0)), places).cast("double")
