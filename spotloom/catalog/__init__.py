"""Every operator as a query over the given tables, with its oracle text where SQL can state it."""

from __future__ import annotations

import importlib


MODULES = ("sources", "basics", "scoring", "vectors", "gaps", "jobs")


def load():
    from spotloom.catalog import core

    for name in MODULES:
        importlib.import_module(f"spotloom.catalog.{name}")
    return dict(core.QUERIES), dict(core.ORACLES)
