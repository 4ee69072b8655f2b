"""The queries of the library, each with the SQL that states its result.

Every module of this subpackage that defines ``QUERIES`` (and ``ORACLES``) is
listed in ``MODULES``; keys must be unique.
"""

from __future__ import annotations

from importlib import import_module

MODULES: tuple[str, ...] = ("volumes", "reading", "analysis", "relations", "projects", "skills", "settings", "storage", "installs")


def _merged(attribute: str) -> dict:
    merged: dict = {}
    for name in MODULES:
        part = getattr(import_module(f"{__package__}.{name}"), attribute)
        clash = merged.keys() & part.keys()
        if clash:
            raise ValueError(f"queries defined twice: {sorted(clash)}")
        merged |= part
    return merged


def queries() -> dict:
    return _merged("QUERIES")


def oracles() -> dict[str, str]:
    return _merged("ORACLES")
