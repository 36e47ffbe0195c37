"""All queries of the engine's own operators, with their SQL forms."""

from __future__ import annotations

from importlib import import_module

#: Modules of this package that define ``QUERIES`` and ``ORACLE_SQL``.
MODULES = ("dedup", "shards", "audits", "ordered", "events", "texts", "pages", "lookups")


def _collect(attribute: str) -> dict:
    out: dict = {}
    for name in MODULES:
        part = getattr(import_module(f"stepforge.plans.{name}"), attribute)
        clash = out.keys() & part.keys()
        if clash:
            raise ValueError(f"query names defined twice: {sorted(clash)}")
        out |= part
    return out


def queries() -> dict:
    return _collect("QUERIES")


def oracle_sql() -> dict[str, str]:
    return _collect("ORACLE_SQL")
