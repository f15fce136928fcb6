"""Named queries by theme."""

from importlib import import_module

THEMES = ["cleaning", "lookups", "panels", "spatial", "modelling", "sourcing", "products"]


def all_queries():
    """The registry with every theme loaded."""
    for theme in THEMES:
        import_module(f".{theme}", __name__)
    return import_module(".registry", __name__)
