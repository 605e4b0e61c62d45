"""All queries of the library, by name."""

from __future__ import annotations

from . import chunks, drawings, files, functions, graph, infer, ingest, merge, more, office, pipeline, quality, questions, rules, search, sheets, state  # noqa: F401  they register their queries
from .registry import ORACLES, QUERIES, Query


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
