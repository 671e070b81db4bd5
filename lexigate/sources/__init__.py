"""Table sources, fixtures, derived inputs and sinks."""

from lexigate.sources.tables import read_table, TABLES

__all__ = ["read_table", "TABLES"]
