"""All registered queries and their oracle SQL."""

from __future__ import annotations

from larkspur.plans import catalog, encoding, evaluation, learned, products, recommendation, search

_PLANS = (search, catalog, recommendation, evaluation, products, learned, encoding)
QUERIES = {k: v for p in _PLANS for k, v in p.QUERIES.items()}
ORACLE_SQL = {k: v for p in _PLANS for k, v in p.ORACLE_SQL.items()}
