"""Importing this module registers the queries of the package."""

import importlib
import pkgutil
from pathlib import Path

from .common import ORACLES, QUERIES  # noqa: F401

for _m in sorted(m.name for m in pkgutil.iter_modules([str(Path(__file__).parent)])):
    if _m.startswith("q_"):
        importlib.import_module(f"{__package__}.{_m}")
