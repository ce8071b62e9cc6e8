"""Registered queries over the given tables, each next to its SQL counterpart."""

from importlib import import_module
from pkgutil import iter_modules


def load_all() -> None:
    """Import every module of this package so that its queries register themselves."""
    for module in iter_modules(__path__):
        if module.name.endswith("_queries"):
            import_module(f"{__name__}.{module.name}")
