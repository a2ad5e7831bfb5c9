"""Keyed stateful forcing, for batch and Structured Streaming."""
