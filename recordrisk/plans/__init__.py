"""Registered queries with their SQL counterparts, and the full training run."""
