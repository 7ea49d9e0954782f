"""All named queries of the subpackage."""

import importlib
import pkgutil

from . import __name__ as package, __path__ as folder
from .registry import QUERIES, SQL

for found in pkgutil.iter_modules(folder):
    if found.name != "catalog":
        importlib.import_module(f"{package}.{found.name}")

import corpus_pipeline  # noqa: E402, F401  registers the pipeline

__all__ = ["QUERIES", "SQL"]
