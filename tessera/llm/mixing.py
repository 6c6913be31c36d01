"""Mixing sources to target weights by systematic sampling, with DataFrame functions only.

Sources in code point order (null last) weigh ``WEIGHTS`` in turn and share ``SHARE``
times all words; a target stops at ``MOST`` times its source's words and the excess
is shared anew by weight until no target is above. Each document then expects
target / source words copies. Expected copies are prefix-summed within the source,
one offset drawn from a hash of the source is added, and a copy is emitted for every
integer boundary crossed. Prefixes run from small to large documents, so that
neighbours replace each other and the words taken come within about one document of
the target.

A source may hold any share of the rows: they are range-partitioned by source, size and
id on sampled splitters, counted per range, and ranked inside ranges of bounded size.

Defined results: a null text has size 0; a null source is a source of its own, last
in order; a source without words has target 0 and no copies; repeated rows and null ids are
ranked like others (equal rows are interchangeable); an empty table gives no rows. With
the same rows and seed, reruns agree whatever the partitioning.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.llm.common import materialise, n_words, shuffle_partitions

WEIGHTS = (3, 1, 2)
SHARE = 1.5
MOST = 2
SEED = "mix-1"


def _key(source: Column) -> Column:
    """A source as a text that is never null."""
    return F.coalesce(F.concat(F.lit("s"), source.cast("string")), F.lit("null"))


def _ranges(rows: DataFrame, *order: str) -> DataFrame:
    """rows with the number of their range, by sampled splitters over the order columns."""
    return materialise(rows.repartitionByRange(shuffle_partitions(rows.sparkSession), *order).withColumn("range_no", F.spark_partition_id()))


def ranked_sources(sizes: DataFrame) -> DataFrame:
    """Adds ord (0, 1, ... by code point, null last) to one row per source. Only counts per range meet in one task."""
    ranged = _ranges(sizes.withColumn("last", F.col("source").isNull()), "last", "source")
    before = ranged.groupBy("range_no").agg(F.count(F.lit(1)).alias("n"))
    before = before.select("range_no", (F.sum("n").over(W.orderBy("range_no")) - F.col("n")).alias("before"))
    inside = F.row_number().over(W.partitionBy("range_no").orderBy("last", "source")) - 1
    return ranged.withColumn("inside", inside).join(before, "range_no").withColumn("ord", F.col("before") + F.col("inside")).drop("last", "inside", "before", "range_no")


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: int = MOST) -> DataFrame:
    """source, key, source_size, target from source, key, source_size."""
    n = len(weights)
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.pmod(F.col("ord"), F.lit(n)) + 1).cast("int")).cast("double")
    ranked = materialise(ranked_sources(sizes).withColumn("weight", weight))
    cap = F.lit(most) * F.col("source_size")
    level = None
    while True:
        above = F.lit(False) if level is None else cap < F.lit(level) * F.col("weight")
        total, stopped, rest = ranked.agg(F.sum("source_size"), F.sum(F.when(above, cap).otherwise(0)), F.sum(F.when(above, 0.0).otherwise(F.col("weight")))).first()
        new = (share * total - stopped) / rest if rest else level or 0.0
        if new == level:
            break
        level = new
    return ranked.select("source", "key", "source_size", F.least(cap.cast("double"), F.lit(level) * F.col("weight")).alias("target"))


def offset(key: Column, seed: str = SEED) -> Column:
    """The random offset of a source, in [0, 1)."""
    return F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}|"), key).cast("binary")), 1, 8), 16, 10).cast("double") / 4294967296.0


def mix(documents: DataFrame, seed: str = SEED, carry: list[str] | None = None) -> DataFrame:
    """doc_id, source, size, source_size, target, copies and taken of every document, with the columns to carry along."""
    rows = documents.select(F.col("doc_id").alias("doc_id"), F.col("source").alias("source"), n_words(F.col("text")).alias("size"), *(F.struct(*carry).alias("carried") for _ in [0] if carry))
    small = rows.select("doc_id", "source", "size").withColumn("key", _key(F.col("source")))
    if carry:
        # The splitters are drawn and the wide rows ranged in the same exchange.
        small = rows.withColumn("key", _key(F.col("source")))
    ranged = _ranges(small, "key", "size", "doc_id")
    per_range = ranged.groupBy("key", "range_no").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("words"), F.first("source").alias("source"))
    per_range = materialise(per_range)
    before = F.sum("n").over(W.partitionBy("key").orderBy("range_no")) - F.col("n")
    goal = targets(per_range.groupBy("key").agg(F.first("source").alias("source"), F.sum("words").alias("source_size")).select("source", "key", "source_size"))
    cells = per_range.select("key", "range_no", before.alias("before")).join(goal.select("key", "source_size", "target"), "key")
    inside = F.row_number().over(W.partitionBy("key", "range_no").orderBy("size", "doc_id"))
    placed = ranged.withColumn("inside", inside).join(cells, ["key", "range_no"])
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    rank = F.col("before") + F.col("inside")
    u = offset(F.col("key"), seed)
    copies = (F.floor(rank * rate + u) - F.floor((rank - 1) * rate + u)).cast("long")
    out = placed.withColumn("copies", copies).withColumn("taken", F.col("copies") * F.col("size"))
    return out.select("doc_id", "source", "size", "source_size", "target", "copies", "taken", *(["carried"] if carry else []))


def mixed_documents(documents: DataFrame, seed: str = SEED) -> DataFrame:
    """The documents of the mix, each row as often as it is taken; columns unchanged. Documents without words are in it by the same rule."""
    columns = documents.columns
    rows = mix(documents, seed, carry=columns)
    return rows.where("copies > 0").withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).select(*(F.col("carried")[c].alias(c) for c in columns))


def oracle(seed: str = SEED, rounds: int = 12) -> str:
    """The same mix in SQL, with the sharing unrolled to so many rounds."""
    level = "l0 AS (SELECT 1.5 * (SELECT sum(source_size) FROM ranked) / (SELECT sum(weight) FROM ranked) AS lam)"
    for k in range(1, rounds):
        level += f""",
l{k} AS (SELECT CASE WHEN sum(CASE WHEN 2 * source_size < lam * weight THEN 0 ELSE weight END) = 0 THEN max(lam)
  ELSE (1.5 * sum(source_size) - sum(CASE WHEN 2 * source_size < lam * weight THEN 2 * source_size ELSE 0 END)) / sum(CASE WHEN 2 * source_size < lam * weight THEN 0 ELSE weight END) END AS lam
  FROM ranked, l{k - 1})"""
    return f"""
WITH rows_ AS (SELECT doc_id, coalesce('s' || source, 'null') AS key, source, CAST(coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0) AS BIGINT) AS size FROM documents),
sizes AS (SELECT key, source, CAST(sum(size) AS DOUBLE) AS source_size FROM rows_ GROUP BY key, source),
ranked AS (SELECT *, CAST([{', '.join(map(str, WEIGHTS))}][1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % {len(WEIGHTS)}] AS DOUBLE) AS weight FROM sizes),
{level},
goal AS (SELECT key, source_size, least(2 * source_size, lam * weight) AS target FROM ranked, l{rounds - 1}),
placed AS (SELECT doc_id, size, source_size, target, CASE WHEN source_size > 0 THEN target / source_size ELSE 0.0 END AS rate,
  row_number() OVER (PARTITION BY key ORDER BY size, doc_id) AS rank_,
  CAST(CAST(('0x' || substr(md5('{seed}|' || key), 1, 8)) AS BIGINT) AS DOUBLE) / 4294967296.0 AS u
  FROM rows_ JOIN goal USING (key))
SELECT doc_id, size, CAST(source_size AS BIGINT) AS source_size, target, CAST(floor(rank_ * rate + u) - floor((rank_ - 1) * rate + u) AS BIGINT) * size AS taken FROM placed"""
