"""Structured Streaming: URL states, progress, logs."""
