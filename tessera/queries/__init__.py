"""Registers every query of the engine."""

from tessera.queries import chinese, mining, profiling, retrieval, sampling, scoring, texts  # noqa: F401
from tessera.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
