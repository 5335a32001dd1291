"""Incremental form of the event -> panel aggregate (the reference itself
has no streaming; this runs the same operator on a Structured Streaming
source)."""

from .incremental import stream_event_panel, start_panel_query

__all__ = ["stream_event_panel", "start_panel_query"]
