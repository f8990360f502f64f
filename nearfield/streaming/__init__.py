"""Structured Streaming jobs: paced ingest, staged evaluation, live top-k, request windows."""
