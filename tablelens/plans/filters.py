"""Filters of what is shown: columns by value type and type, results by status."""

from __future__ import annotations

# The level as which each status is shown.
SHOWN_AS = {"passed": "low", "warning": "medium", "error": "high", "failed": "high"}


def shown_columns(columns: list[dict], value_types: set[str], types: set[str]) -> list[dict]:
    """Both sets must have members; a column without a value type passes the first."""
    if not value_types or not types:
        return []
    return [c for c in columns if (not c.get("valueType") or c["valueType"] in value_types) and c.get("type") in types]


def matching_columns(columns: list[dict], value_types: set[str], types: set[str]) -> list[dict]:
    """An empty set shows all; with value types given, a column without one is left out."""
    return [c for c in columns if (not value_types or c.get("valueType") in value_types) and (not types or c.get("type") in types)]


def distinct_types(columns: list[dict]) -> dict[str, list[str]]:
    return {k: sorted({c[k] for c in columns if c.get(k)}) for k in ("valueType", "type")}


def shown_level(status: str) -> str:
    return SHOWN_AS.get(status, status)


def shown_results(results: list[dict], levels: frozenset[str] = frozenset({"high"})) -> list[dict]:
    return [r for r in results if shown_level(r["status"]) in levels]
