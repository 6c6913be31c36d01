"""Quotas, stratified and round-robin samples, splits. Order comes from a hash of the id, never from a generator."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def hash_order(key: str, seed: str = "42") -> list[Column]:
    """An order that looks random and is the same in every engine: md5 of seed and id."""
    return [F.md5(F.concat(F.lit(f"{seed}|"), F.col(key).cast("string")).cast("binary")), F.col(key)]


def quotas(sizes: dict[str, int], total: int = 200) -> dict[str, int]:
    """Rows per stratum: one each, the rest by share in order of size, then adjusted to the total (or to all rows, if fewer)."""
    order = sorted(sizes, key=lambda k: (-sizes[k], k))
    whole, rest = sum(sizes.values()), total - len(sizes)
    out = dict.fromkeys(order, 1)
    for k in order:
        out[k] += min(max(1, int(sizes[k] / whole * rest)), sizes[k] - 1) if sizes[k] > 1 and rest > 0 else 0
    short = min(total, whole) - sum(out.values())
    for k in order if short > 0 else ():
        more = min(short, sizes[k] - out[k])
        out[k] += more
        short -= more
    while short < 0:
        before = short
        for k in reversed(order):
            if short < 0 and out[k] > 1:
                out[k] -= 1
                short += 1
        if short == before:
            break
    return out


def round_robin(df: DataFrame, stratum: str, group: str, key: str, quota: DataFrame | int, seed: str = "42") -> DataFrame:
    """Rows of each stratum drawn from its groups in turn, up to the stratum's quota (quota: stratum, quota, or one number)."""
    turn = F.row_number().over(W.partitionBy(stratum, group).orderBy(*hash_order(key, seed)))
    at = F.row_number().over(W.partitionBy(stratum).orderBy("turn", group, *hash_order(key, seed)))
    drawn = df.withColumn("turn", turn).withColumn("draw", at)
    if isinstance(quota, int):
        return drawn.where(F.col("draw") <= quota)
    return drawn.join(quota, stratum).where(F.col("draw") <= F.col("quota")).drop("quota")


def stratified(df: DataFrame, stratum: str, key: str, total: int = 400, seed: str = "42") -> DataFrame:
    """total // strata rows of each stratum (one at least), topped up from the others by hash, trimmed to the total."""
    strata = df.select(stratum).distinct().count()
    each = max(total // max(strata, 1), 1)
    inside = F.row_number().over(W.partitionBy(stratum).orderBy(*hash_order(key, seed)))
    first = df.withColumn("inside", inside).withColumn("extra", (F.col("inside") > each).cast("int"))
    return first.orderBy("extra", *hash_order(key, seed)).limit(total).drop("inside", "extra")


def top_up(df: DataFrame, chosen: DataFrame, key: str, total: int, seed: str = "42") -> DataFrame:
    """chosen and, by hash, as many of the rows it lacks as make the total."""
    missing = max(0, total - chosen.count())
    rest = df.join(chosen.select(key), key, "left_anti").orderBy(*hash_order(key, seed)).limit(missing)
    return chosen.unionByName(rest)


def split(df: DataFrame, label: str, key: str, share: float = 0.8, seed: str = "42") -> DataFrame:
    """Adds is_train: the first share of each class in hash order."""
    w = W.partitionBy(label)
    rank = F.row_number().over(w.orderBy(*hash_order(key, seed)))
    n = F.count(F.lit(1)).over(w)
    return df.withColumn("is_train", rank <= F.floor(n * share))


def evenly_spaced(df: DataFrame, key: str, n: int = 100) -> DataFrame:
    """Rows at floor(i * (rows - 1) / (n - 1)), i < n, in order of key. Ranks come from range partitions, not from one task."""
    from tessera.operators.ranking import global_rank

    total = df.count()
    if not total:
        return df.withColumn("rank", F.lit(0).cast("long"))
    wanted = sorted({i * (total - 1) // max(n - 1, 1) for i in range(n)})
    return global_rank(df, key).where(F.col("rank").isin(wanted))
