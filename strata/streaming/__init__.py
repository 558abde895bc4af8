"""Streaming: sources, windows, event handlers, dead letters and run metrics."""
