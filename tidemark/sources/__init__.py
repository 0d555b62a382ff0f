"""Readers of every layer."""

from tidemark.sources.discovery import discover_latest_batch, list_files
from tidemark.sources.envelopes import read_envelopes, read_items_schemaless
from tidemark.sources.flat_csv import read_flat_csv
from tidemark.sources.reference import read_reference, reference_items, reference_status
from tidemark.sources.tables import read_or_empty, read_reference_table, read_stats

__all__ = [
    "discover_latest_batch",
    "list_files",
    "read_envelopes",
    "read_flat_csv",
    "read_items_schemaless",
    "read_or_empty",
    "read_reference",
    "read_reference_table",
    "read_stats",
    "reference_items",
    "reference_status",
]
