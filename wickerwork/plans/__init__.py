"""Registered queries by family."""

from importlib import import_module

FAMILIES = ("ingest", "catalogue", "search", "baskets", "bundles", "outcomes", "trends", "prices", "corpus", "streams")


def load_all() -> None:
    for family in FAMILIES:
        import_module(f"wickerwork.plans.{family}")
