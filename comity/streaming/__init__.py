"""Structured Streaming: score-and-append, and daily activity counts."""
