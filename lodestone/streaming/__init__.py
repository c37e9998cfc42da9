"""Streaming: chunking of files as they arrive, and counts of events in windows."""
