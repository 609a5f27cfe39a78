"""Queries over the test tables, each with the SQL that must give the same rows."""

from workload import events, features, jobs, sequences, series, streams, text
from workload.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES", "events", "features", "jobs", "sequences", "series", "streams", "text"]
