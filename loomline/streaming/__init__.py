"""Structured Streaming: rate limits, dedup, event-time windows, runs to completion."""
