"""Readers."""

from lekha.sources.tables import table

__all__ = ["table"]
