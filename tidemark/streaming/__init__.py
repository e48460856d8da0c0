"""Structured Streaming jobs: ingest, lake, hourly bars, incremental mart refresh, alerts."""
