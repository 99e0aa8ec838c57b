"""Every operator as a registered query over the given tables."""

from __future__ import annotations

from importlib import import_module

_SECTIONS = ("ingest", "distincts", "frequencies", "statistics", "rollups", "streams", "compliance", "stored")


def load_all() -> None:
    for section in _SECTIONS:
        import_module(f"auditloom.catalog.{section}")
