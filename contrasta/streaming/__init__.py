"""Incremental and streaming scoring."""
