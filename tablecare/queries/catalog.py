"""All registered queries."""

from tablecare.queries import quality, cleaning, features, evaluation, records, learning, streams  # noqa: F401
from tablecare.queries.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
