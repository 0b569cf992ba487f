"""Registered queries, grouped by the part of the library they exercise."""

from importlib import import_module

MODULES = ["pages", "sequences", "texts", "records", "extraction", "grids", "similarity", "values", "live"]


def load_all() -> None:
    for module in MODULES:
        import_module(f"{__name__}.{module}")
