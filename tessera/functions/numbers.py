"""Weights and norms of the retrieval model."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def idf(n: Column, df: Column, kind: str = "plain") -> Column:
    """ln(n/df), or ln(n/(df+1)) if smooth (negative for a term of every document)."""
    return F.log(n / df if kind == "plain" else n / (df + 1))


def log_tf(tf: Column) -> Column:
    return 1 + F.log(tf)


def safe_norm(square_sum: Column) -> Column:
    """Root of a sum of squares; a vanishing norm counts as 1."""
    root = F.sqrt(square_sum)
    return F.when(root < 1e-9, 1.0).otherwise(root)


def rounded(c: Column, digits: int = 6) -> Column:
    return F.round(c, digits)
