"""Structured Streaming into a store."""

from tidemark.streaming.sink import write_stream

__all__ = ["write_stream"]
