"""Registered queries with their reference SQL, over the given tables."""
from .registry import ENTRIES  # noqa: F401
from . import (  # noqa: F401  (imports fill the registry)
    maps, scoring, neighbours, scene, tables, statistics, training, frames, files, reports)
