"""All queries of the core by name, and their SQL."""

from __future__ import annotations

from . import alignment, evaluation, geography, matrices, ranks, readings, spatial, texts

_PARTS = (ranks, matrices, geography, evaluation, alignment, readings, spatial, texts)

QUERIES = {name: f for part in _PARTS for name, f in part.QUERIES.items()}
ORACLES = {name: sql for part in _PARTS for name, sql in part.ORACLES.items()}
