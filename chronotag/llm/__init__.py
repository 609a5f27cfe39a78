"""Operators for preparing training data, and the queries that apply them to the given tables."""

from chronotag.llm.queries import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
