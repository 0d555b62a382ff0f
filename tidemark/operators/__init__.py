"""Reusable operators: DataFrames in, DataFrames out; keys, order and k are arguments."""

from tidemark.operators.keys import (
    affected_keys,
    batch_slice,
    keys_missing_from,
    latest_batch,
    latest_batch_df,
    lookup_dim,
    restrict_history,
    restrict_to,
)
from tidemark.operators.merge import concat_evolving, union_history, upsert
from tidemark.operators.quality import (
    describe_stage,
    preview,
    quality_counts,
    require_columns,
    require_nonblank,
    require_rows,
    require_unique_columns,
)
from tidemark.operators.ranking import canonical_dim, dedupe, keep_last, latest_by, top_k
from tidemark.operators.reshape import (
    conform,
    explode_items,
    extract_json,
    flatten_structs,
    normalize_columns,
)

__all__ = [
    "affected_keys",
    "batch_slice",
    "canonical_dim",
    "concat_evolving",
    "conform",
    "dedupe",
    "describe_stage",
    "explode_items",
    "extract_json",
    "flatten_structs",
    "keep_last",
    "keys_missing_from",
    "latest_batch",
    "latest_batch_df",
    "latest_by",
    "lookup_dim",
    "normalize_columns",
    "preview",
    "quality_counts",
    "require_columns",
    "require_nonblank",
    "require_rows",
    "require_unique_columns",
    "restrict_history",
    "restrict_to",
    "top_k",
    "union_history",
    "upsert",
]
