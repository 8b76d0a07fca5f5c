"""All registered queries and their SQL."""

from __future__ import annotations

from . import catalogue, catalogue_files, catalogue_graphs, catalogue_text  # noqa: F401  each registers its own
from .catalogue import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
