"""Structured Streaming jobs: copy events, rates, change feed, log tail."""
