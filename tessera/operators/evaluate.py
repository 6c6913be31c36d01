"""Retrieval metrics over judged results: query_id, rank (from 1), rel (0 or 1, null if not judged)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def judged(rows: DataFrame, drop_without_relevant: bool = True) -> DataFrame:
    """Judged rows; queries without a relevant result go, unless told otherwise (which lowers the averages)."""
    own = rows.where("rel is not null").select("query_id", "rank", F.col("rel").cast("int").alias("rel"))
    if not drop_without_relevant:
        return own
    return own.join(own.groupBy("query_id").agg(F.sum("rel").alias("n")).where("n > 0").select("query_id"), "query_id", "left_semi")


def _running(rows: DataFrame) -> DataFrame:
    w = W.partitionBy("query_id").orderBy("rank")
    at = F.row_number().over(w)
    return rows.withColumn("at", at).withColumn("hits", F.sum("rel").over(w.rowsBetween(W.unboundedPreceding, 0)))


def per_query(rows: DataFrame, ks: tuple[int, ...] = (5, 10), ndcg_at: int = 10) -> DataFrame:
    """query_id, n_rel, p_at_k for each k (always over k), ap and r_precision over the retrieved relevant, ndcg at ndcg_at with the ideal order of the same list."""
    run = _running(rows)
    ideal_at = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("rel"), "rank"))
    total = F.sum("rel").over(W.partitionBy("query_id"))
    run = run.withColumn("ideal_at", ideal_at).withColumn("total", total)
    gain = lambda at: F.sum(F.when(F.col(at) <= ndcg_at, F.col("rel") / F.log2(F.col(at) + 1)).otherwise(0.0))
    out = run.groupBy("query_id").agg(
        F.max("total").alias("n_rel"),
        *(F.round(F.sum(F.when(F.col("at") <= k, F.col("rel")).otherwise(0)) / F.lit(k), 6).alias(f"p_at_{k}") for k in ks),
        F.round(F.coalesce(F.avg(F.when(F.col("rel") == 1, F.col("hits") / F.col("at"))), F.lit(0.0)), 6).alias("ap"),
        F.round(F.when(F.max("total") > 0, F.sum(F.when(F.col("at") <= F.col("total"), F.col("rel")).otherwise(0)) / F.greatest(F.max("total"), F.lit(1))).otherwise(0.0), 6).alias("r_precision"),
        gain("at").alias("dcg"),
        gain("ideal_at").alias("idcg"),
    )
    return out.withColumn("ndcg", F.round(F.when(F.col("idcg") > 0, F.col("dcg") / F.when(F.col("idcg") > 0, F.col("idcg")).otherwise(1.0)).otherwise(0.0), 6)).drop("dcg", "idcg")


def averages(metrics: DataFrame) -> DataFrame:
    names = [c for c in metrics.columns if c not in ("query_id", "n_rel")]
    return metrics.agg(F.count(F.lit(1)).alias("n_queries"), *(F.round(F.avg(c), 6).alias({"ap": "map"}.get(c, c)) for c in names))


def interpolated(rows: DataFrame, points: int = 11) -> DataFrame:
    """query_id, level, precision: greatest precision at recall of at least each level; 0 where recall never gets there."""
    run = _running(rows)
    total = F.sum("rel").over(W.partitionBy("query_id"))
    run = run.withColumn("recall", F.when(total > 0, F.col("hits") / F.greatest(total, F.lit(1))).otherwise(0.0)).withColumn("prec", F.col("hits") / F.col("at"))
    levels = F.array(*(F.lit(round(i / (points - 1), 6)) for i in range(points)))
    spread = run.withColumn("level", F.explode(levels))
    return spread.groupBy("query_id", "level").agg(F.round(F.coalesce(F.max(F.when(F.col("recall") >= F.col("level") - 1e-9, F.col("prec"))), F.lit(0.0)), 6).alias("precision"))


def mean_curve(curve: DataFrame) -> DataFrame:
    return curve.groupBy("level").agg(F.round(F.avg("precision"), 6).alias("precision"))


def two_by_two(rows: DataFrame, k: int = 10) -> DataFrame:
    """query_id, retrieved_relevant, retrieved_nonrelevant (k less the relevant), missed_relevant."""
    run = _running(rows)
    inside = F.sum(F.when(F.col("at") <= k, F.col("rel")).otherwise(0))
    return run.groupBy("query_id").agg(inside.alias("retrieved_relevant"), (F.lit(k) - inside).alias("retrieved_nonrelevant"), (F.sum("rel") - inside).alias("missed_relevant"))
