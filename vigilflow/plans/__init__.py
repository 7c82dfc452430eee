"""Query catalogue: importing a ``q_*`` module registers its queries."""

import importlib
import pkgutil


def load() -> None:
    for m in sorted(pkgutil.iter_modules(__path__), key=lambda m: m.name):
        if m.name.startswith("q_"):
            importlib.import_module(f"{__name__}.{m.name}")
