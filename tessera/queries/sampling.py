"""Stratified, round-robin and evenly spaced samples."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.operators import sampling as SA
from tessera.queries import views as V
from tessera.registry import query
from tessera.sources.readers import first_rows

_HASH = "md5('42|' || o_orderkey), o_orderkey"


@query("stratified_sample", f"SELECT o_orderkey FROM (SELECT *, row_number() OVER (PARTITION BY o_orderpriority ORDER BY {_HASH}) > 80 AS extra FROM orders) ORDER BY extra, {_HASH} LIMIT 402")
def stratified_sample(spark, sf_dir) -> DataFrame:
    return SA.stratified(V.table(spark, sf_dir, "orders"), "o_orderpriority", "o_orderkey", 402).select("o_orderkey")


@query("round_robin_sample", f"WITH t AS (SELECT *, row_number() OVER (PARTITION BY o_orderpriority, o_custkey ORDER BY {_HASH}) AS turn FROM orders) SELECT o_orderkey, o_orderpriority, CAST(turn AS INTEGER) AS turn, CAST(row_number() OVER (PARTITION BY o_orderpriority ORDER BY turn, o_custkey, {_HASH}) AS INTEGER) AS draw FROM t QUALIFY draw <= 25")
def round_robin_sample(spark, sf_dir) -> DataFrame:
    return SA.round_robin(V.table(spark, sf_dir, "orders"), "o_orderpriority", "o_custkey", "o_orderkey", 25).select("o_orderkey", "o_orderpriority", "turn", "draw")


@query("quota_sample")
def quota_sample(spark, sf_dir) -> DataFrame:
    """Round-robin by quotas of 200 in all; only the sizes of the strata come to the driver."""
    orders = V.table(spark, sf_dir, "orders")
    sizes = {r.o_orderpriority: r["count"] for r in orders.groupBy("o_orderpriority").count().collect()}
    quota = spark.createDataFrame(list(SA.quotas(sizes, 200).items()), "o_orderpriority string, quota int")
    return SA.round_robin(orders, "o_orderpriority", "o_custkey", "o_orderkey", quota).select("o_orderkey", "o_orderpriority", "draw")


@query("sample_top_up", f"WITH c AS (SELECT * FROM orders WHERE o_orderkey < 40) SELECT o_orderkey FROM c UNION ALL (SELECT o_orderkey FROM orders WHERE o_orderkey NOT IN (SELECT o_orderkey FROM c) ORDER BY {_HASH} LIMIT (100 - (SELECT count(*) FROM c)))")
def sample_top_up(spark, sf_dir) -> DataFrame:
    orders = V.table(spark, sf_dir, "orders")
    return SA.top_up(orders, orders.where("o_orderkey < 40"), "o_orderkey", 100).select("o_orderkey")


@query("evenly_spaced", "WITH r AS (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) - 1 AS rank, count(*) OVER () AS n FROM orders) SELECT o_orderkey, rank FROM r WHERE rank IN (SELECT i * (n - 1) // 99 FROM range(100) t(i))")
def evenly_spaced(spark, sf_dir) -> DataFrame:
    return SA.evenly_spaced(V.table(spark, sf_dir, "orders"), "o_orderkey", 100).select("o_orderkey", F.col("rank").cast("long").alias("rank"))


@query("first_rows", "SELECT o_orderkey, o_orderstatus FROM orders ORDER BY o_orderkey LIMIT 5000")
def head(spark, sf_dir) -> DataFrame:
    return first_rows(V.table(spark, sf_dir, "orders"), "o_orderkey").select("o_orderkey", "o_orderstatus")
