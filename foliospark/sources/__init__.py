"""Readers and writers: fixture tables, JSON lines, document blocks, graph exports."""

from foliospark.sources.tables import spread, table

__all__ = ["spread", "table"]
