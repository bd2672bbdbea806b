"""Query catalogue."""

from __future__ import annotations

from . import analyses, frames, graphs, matrices, signals, sources  # noqa: F401
from .catalogue import ORACLES, QUERIES, Query


def all_queries() -> dict[str, Query]:
    return QUERIES


def all_oracles() -> dict[str, str]:
    return ORACLES
