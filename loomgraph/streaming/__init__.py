"""Structured Streaming: folder watching and event windows."""
