"""Streaming adapter: search micro-batches of queries with ``foreachBatch``."""

from quarry.streaming.search_stream import search_batch, start_search_stream

__all__ = ["search_batch", "start_search_stream"]
