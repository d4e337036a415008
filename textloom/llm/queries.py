"""All queries of the subpackage: importing this module registers them."""

from __future__ import annotations

from textloom.llm import (  # noqa: F401
    centroids,
    embeddings,
    linededup,
    mixing,
    packing,
    periodic,
    pii,
    quality,
    repeats,
    sharding,
    simhash,
    simple8b,
    toolcalls,
)
from textloom.llm.registry import ORACLE, QUERIES

__all__ = ["ORACLE", "QUERIES"]
