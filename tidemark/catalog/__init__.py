"""Queries over the test tables, one per operator of the library."""

from importlib import import_module

MODULES = ("bars", "options", "boundaries", "live", "gateway", "files", "records", "calendars", "long", "commodities")


def load():
    """Import every module that registers queries and return the registry."""
    for name in MODULES:
        import_module(f"tidemark.catalog.{name}")
    from tidemark.catalog import registry

    return registry
