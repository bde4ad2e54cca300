"""All registered queries and their check SQL."""

from tidemark.catalog import calm, clean, features, indicators, keys, logs, quality, sampling, streams, trading, training  # noqa: F401
from tidemark.catalog.base import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
