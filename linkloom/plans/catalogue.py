"""Registered queries of the linkage engine: name -> plan, and DuckDB SQL for each."""

from __future__ import annotations

from linkloom.plans.oracle import ORACLE_SQL
from linkloom.plans.queries import QUERIES

FLAGSHIP = "flagship_cosine_topk"

__all__ = ["FLAGSHIP", "ORACLE_SQL", "QUERIES"]
