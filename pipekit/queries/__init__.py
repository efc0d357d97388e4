"""Registered queries over the test tables, each with the SQL it must agree with."""

from pipekit.queries import cleaning, quality, storage, streams, transforms, variants  # noqa: F401
from pipekit.queries.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
