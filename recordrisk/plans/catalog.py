"""Importing this module registers every query."""

from recordrisk.plans import (  # noqa: F401
    clean_queries, encode_queries, evaluate_queries, flagship, model_queries, profile_queries,
    resample_queries, score_queries, source_queries)
from recordrisk.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
