"""Ranks over whole tables without gathering them in one task."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.session import materialise


def global_rank(df: DataFrame, *order: str) -> DataFrame:
    """Adds rank (0, 1, ...) by the order columns: rows are ranged on sampled splitters, counted per range and ranked inside each.

    The ranged rows are written to the shared folder, since both branches must see the same splitters.
    """
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = materialise(df.repartitionByRange(n, *order).withColumn("range_no", F.spark_partition_id()))
    before = ranged.groupBy("range_no").agg(F.count(F.lit(1)).alias("n"))
    before = before.select("range_no", (F.sum("n").over(W.orderBy("range_no")) - F.col("n")).alias("before"))  # a row per range
    inside = F.row_number().over(W.partitionBy("range_no").orderBy(*order)) - 1
    return ranged.withColumn("inside", inside).join(before, "range_no").withColumn("rank", F.col("before") + F.col("inside")).drop("range_no", "inside", "before")


def adjacent_pairs(words: DataFrame, group: str = "line", order: str = "pos", word: str = "word") -> DataFrame:
    """left, right, n of neighbouring words."""
    before = F.lag(word).over(W.partitionBy(group).orderBy(order))
    return words.select(before.alias("left"), F.col(word).alias("right")).where("left is not null").groupBy("left", "right").agg(F.count(F.lit(1)).alias("n"))
