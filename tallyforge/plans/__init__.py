"""Registered queries: operators bound to the test tables, with SQL to check them."""

from importlib import import_module

MODULES = ("sources", "flatten", "evidence", "graphs", "vocabulary", "selection", "duplicates",
           "audits", "features", "probes", "evaluation", "streams")


def load_all() -> None:
    for name in MODULES:
        import_module(f"{__name__}.{name}")
