"""Structured Streaming forms of the incremental operators."""

from lectern.streaming.streams import dedup, ingest, run, session_counts, signature_cache, upsert_stream, window_counts

__all__ = ["dedup", "ingest", "run", "session_counts", "signature_cache", "upsert_stream", "window_counts"]
