"""Continuous collection with Structured Streaming."""

from .incremental import ScoreStream, completion_index, parse_stream

__all__ = ["ScoreStream", "completion_index", "parse_stream"]
