"""All registered queries; importing the operator modules registers them."""

from __future__ import annotations

from ..operators import chunking, cleaning, context, dedup, evidence, fusion, governance, grids, openapi, relational, retrieval, review, rules, texts, vector_index
from ..streaming import citations, states, turns
from .registry import ORACLES, QUERIES, Query

MODULES = (relational, texts, dedup, retrieval, chunking, governance, evidence, cleaning, context, openapi, grids, rules, vector_index, fusion, review, turns, citations, states)


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
