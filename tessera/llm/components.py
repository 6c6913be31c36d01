"""Connected components of a link table by alternating large-star and small-star rounds.

Each round is two group-and-join steps over the links; the number of rounds grows
with the logarithm of the diameter. Nothing is collected: convergence is one row
(count and hash sum of the links). Every round is written to the shared folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import drop, materialise


def _with_least(links: DataFrame) -> DataFrame:
    """Adds the least neighbour of u. The unique side is exchanged under another key, so that a hub's links can be split."""
    least = links.groupBy("u").agg(F.min("v").alias("least")).select(F.bitwise_not("u").alias("not_u"), "least")
    return links.join(least, F.bitwise_not("u") == F.col("not_u"))


def connected_components(links: DataFrame, most_rounds: int = 100) -> DataFrame:
    """node, root (its component's least node) for every node that is not a root itself. links: long columns u, v."""
    links = materialise(links.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    state = None
    for _ in range(most_rounds):
        both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        star = _with_least(both).where("v > u").select(F.col("v").alias("u"), F.least("u", "least").alias("v")).distinct()
        large = materialise(star)
        drop(links)
        near = _with_least(large)
        links = materialise(near.where("v <> least").select(F.col("v").alias("u"), F.col("least").alias("v")).unionByName(near.select("u", F.col("least").alias("v"))).distinct())
        drop(large)
        new = tuple(links.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v") % 1_000_003), F.bit_xor(F.xxhash64("u", "v"))).first())
        if new == state or not new[0]:
            return links.select(F.col("u").alias("node"), F.col("v").alias("root"))
        state = new
    raise RuntimeError(f"no convergence after {most_rounds} rounds")
