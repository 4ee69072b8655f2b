"""Operators for training-data pipelines; nothing else in the library imports them."""

from __future__ import annotations


def queries() -> dict:
    from storylake.llm import registry

    return dict(registry.QUERIES)


def oracles() -> dict[str, str]:
    from storylake.llm import registry

    return dict(registry.ORACLES)
