"""Queries over the test tables, each with its SQL oracle where SQL can say it."""

from importlib import import_module

MODULES = ["logs", "access", "hierarchy", "changes", "shapes", "graphs", "search", "communities", "storage"]


def load():
    """Import every query module and return (queries, oracles)."""
    for name in MODULES:
        import_module(f"thicket.queries.{name}")
    from thicket.queries.registry import ORACLES, QUERIES

    return dict(QUERIES), dict(ORACLES)
