"""Composite jobs: layer to layer."""

from tidemark.layout import Layout
from tidemark.plans.dimension import merge_reference, upsert_each, upsert_reference
from tidemark.plans.gold import (
    category_engagement,
    category_performance,
    category_region,
    silver_to_gold,
    video_rankings,
)
from tidemark.plans.jobs import run_latest
from tidemark.plans.silver import (
    bronze_csv_to_silver,
    bronze_json_to_silver,
    csv_to_rows,
    envelopes_to_rows,
    json_text_to_rows,
    silver_from_csv,
    silver_from_envelopes,
)
from tidemark.plans.snapshots import latest_snapshots

__all__ = [
    "Layout",
    "bronze_csv_to_silver",
    "bronze_json_to_silver",
    "category_engagement",
    "category_performance",
    "category_region",
    "csv_to_rows",
    "envelopes_to_rows",
    "json_text_to_rows",
    "latest_snapshots",
    "merge_reference",
    "run_latest",
    "silver_from_csv",
    "silver_from_envelopes",
    "silver_to_gold",
    "upsert_each",
    "upsert_reference",
    "video_rankings",
]
