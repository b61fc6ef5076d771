"""Every registered query, grouped by subject."""

from importlib import import_module

MODULES = ["timeline", "measures", "notes", "conform", "models"]


def load_catalog():
    from tracewell.catalog.registry import ORACLES, QUERIES

    for module in MODULES:
        import_module(f"tracewell.catalog.{module}")
    return dict(QUERIES), dict(ORACLES)
