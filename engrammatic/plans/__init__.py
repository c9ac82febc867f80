"""Query plans over the test tables, by area."""

from importlib import import_module

AREAS = ("relations", "retrieval", "scoring", "text", "dependencies", "vectors", "graph", "statistics", "entities", "ingestion", "streams", "api")


def load() -> None:
    """Imports every module of plans, which registers its queries."""
    for area in AREAS:
        import_module(f"{__name__}.{area}")
