"""Structured Streaming watchers."""
