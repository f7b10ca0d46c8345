"""Structured Streaming jobs: order ingest and weekly consumption."""
