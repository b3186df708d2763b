"""Registered queries: each runs an operator over whole benchmark tables."""

from binflow.queries.registry import ORACLES, QUERIES, load

__all__ = ["ORACLES", "QUERIES", "load"]
