"""tablelens: a Spark-native table profiler and training-data toolkit."""

from __future__ import annotations

from importlib import import_module

_HOMES = {"Profiler": "profiler", "Registry": "registry", "ProfilingConfig": "types", "ProfilingResult": "types", "Rule": "types"}
__all__ = list(_HOMES)


def __getattr__(name: str):
    """The main names, loaded when they are asked for: Python workers of other parts need none of them."""
    if name in _HOMES:
        return getattr(import_module(f"tablelens.plans.{_HOMES[name]}"), name)
    raise AttributeError(name)
