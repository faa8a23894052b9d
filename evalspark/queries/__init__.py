"""Every registered query with the SQL that checks it (None where SQL cannot express it)."""

import importlib
import pkgutil

REGISTRY: dict = {}
for _m in sorted(m.name for m in pkgutil.iter_modules(__path__)):
    if _m.endswith("_queries"):
        REGISTRY.update(importlib.import_module(f"{__name__}.{_m}").Q)
