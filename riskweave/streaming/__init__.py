"""Streams: native ingest queries, and batch steps that fold new rows into stored state."""
