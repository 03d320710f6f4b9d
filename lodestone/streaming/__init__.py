"""Incremental indexing of file streams."""
