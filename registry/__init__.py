"""Named queries over the driver's tables."""

from . import analyses, graph, ingest, selections, structure  # noqa: F401
from .core import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
