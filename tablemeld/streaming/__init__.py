"""Incremental harmonization with Structured Streaming."""
