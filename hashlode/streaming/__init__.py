"""Structured Streaming: captured packets, registry upserts, rolling dedup, request matching."""
