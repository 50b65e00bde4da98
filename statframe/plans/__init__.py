"""Analysis flows over the operators, and the query registry."""

import importlib

_AREAS = ("quality", "tests", "models", "series", "cluster", "frames", "eda")


def load_all() -> None:
    """Import every module of registered queries."""
    for area in _AREAS:
        importlib.import_module(f"statframe.plans.queries_{area}")
