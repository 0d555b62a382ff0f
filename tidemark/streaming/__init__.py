"""Incremental arrival of reference files."""

from tidemark.streaming.reference_stream import stream_reference

__all__ = ["stream_reference"]
