"""All queries of this package and their SQL."""

from __future__ import annotations

from tellstone.llm import bytepairs, components, cooccurrence, lookalikes, mixing, neardup, neighbours, termcounts, truncation

_ALL = [neighbours, lookalikes, cooccurrence, components, neardup, termcounts, bytepairs, mixing, truncation]
QUERIES = {k: v for m in _ALL for k, v in m.QUERIES.items()}
SQL = {k: v for m in _ALL for k, v in m.SQL.items()}
