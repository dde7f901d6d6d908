"""Registered queries. `load()` imports every module that registers some."""

from importlib import import_module

MODULES = ("basic", "ingestion", "detection", "evaluation", "files", "streams")


def load() -> None:
    for name in MODULES:
        import_module(f"{__name__}.{name}")
