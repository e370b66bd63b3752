"""Registered queries, one module per operator family."""

import importlib
import pkgutil


def load():
    from . import registry

    for mod in sorted(m.name for m in pkgutil.iter_modules(__path__)):
        importlib.import_module(f"{__name__}.{mod}")
    return registry
