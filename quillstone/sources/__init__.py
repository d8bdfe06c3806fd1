"""Readers and writers."""

from quillstone.sources.tables import table

__all__ = ["table"]
