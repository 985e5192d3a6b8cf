"""Registered queries: name -> function of (spark, folder), and name -> DuckDB SQL."""

from __future__ import annotations

# importing a module registers its queries
from .plans import control_queries, corpus_queries, model_queries, record_queries, source_queries, vector_queries  # noqa: F401
from .plans._base import ORACLES, QUERIES  # noqa: F401

FLAGSHIP = "corpus_profile"
