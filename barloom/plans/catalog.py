"""All registered queries with their check SQL."""

from __future__ import annotations

from importlib import import_module

_MODULES = ("feature_queries", "weekly_queries", "research_queries", "portfolio_queries", "system_queries")


def _merged(attribute: str) -> dict:
    out: dict = {}
    for name in _MODULES:
        part = getattr(import_module(f"{__package__}.{name}"), attribute)
        clash = set(out) & set(part)
        if clash:
            raise ValueError(f"registered twice: {sorted(clash)}")
        out.update(part)
    return out


def queries() -> dict:
    return _merged("QUERIES")


def oracles() -> dict:
    return _merged("ORACLES")
