"""Structured Streaming: change feeds and debounced rebuilds."""
