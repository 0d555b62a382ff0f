"""Writers, table maintenance, catalog and reports."""

from tidemark.sinks.catalog import (
    create_all_stats_view,
    create_csv_table,
    create_table,
    register_evolving,
    register_tables,
    register_views,
    repair_table,
)
from tidemark.sinks.landing import document_writer, land_envelopes, land_reference, with_metadata, write_documents
from tidemark.sinks.partitions import replace_affected, replace_dataset, write_partitions
from tidemark.sinks.report import envelope_report, report_json, run_summary

__all__ = [
    "create_all_stats_view",
    "create_csv_table",
    "create_table",
    "document_writer",
    "envelope_report",
    "land_envelopes",
    "land_reference",
    "register_evolving",
    "register_tables",
    "register_views",
    "repair_table",
    "replace_affected",
    "replace_dataset",
    "report_json",
    "run_summary",
    "with_metadata",
    "write_documents",
    "write_partitions",
]
