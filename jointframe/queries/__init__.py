"""Registered queries: operators applied to the given tables, with the SQL that checks them."""

from __future__ import annotations

import importlib
import pkgutil

from jointframe.registry import QUERIES, Query


def load_all() -> dict[str, Query]:
    for module in pkgutil.iter_modules(__path__):
        importlib.import_module(f"{__name__}.{module.name}")
    return QUERIES
