"""Streaming ingest over the batch functions."""
