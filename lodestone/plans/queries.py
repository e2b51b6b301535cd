"""All registered queries."""

from . import changes, extraction, graphs, relational, retrieval, scalars  # noqa: F401
from .registry import ORACLES, QUERIES, entry

__all__ = ["ORACLES", "QUERIES", "entry"]
