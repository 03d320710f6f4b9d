"""Readers, layouts, snapshots and sinks."""
