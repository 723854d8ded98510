"""Incremental bronze from change events."""
