"""Sharding to near equal bytes by sampled splitters, with DataFrame functions only.

Keys (hash of the text, so equal texts are neighbours) are sampled with probability in
proportion to size; weighted quantiles of the sample are the splitters of ``RANGES``
ranges. Ranges are measured, and one that is overfull (a hot key, an unlucky draw) is
subdivided by a hash of the id (of a row's own number where the id is null). Inside these cells, of bounded size, running sums of the
sizes place every record on the global byte axis, which is cut into equal shards.
Shard sizes then differ by about one record; the law is ``bytes``.

Defined results: a null text has no bytes (size 8) and a null crc; repeated rows, ties and null
ids are placed like others (equal rows are interchangeable); an empty table gives no rows.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.llm.common import materialise

SHARDS = 24
RANGES = 64
#: Expected number of sampled keys, the only rows that reach the driver.
SAMPLE = 16_384
#: A range beyond so many times the mean is subdivided.
OVERFULL = 2.0
#: Rows that a cell holds at most, about; larger ranges are subdivided too.
CELL_ROWS = 1_000_000
#: Bytes that a cell holds at most, about, so that a cell that carries its texts fits a task at any size of the input.
CELL_BYTES = 128 << 20
OVERHEAD = 8


def keyed(documents: DataFrame) -> DataFrame:
    """Adds size, key and a spread value that tells equal texts apart; to be materialised before it is used twice."""
    size = (F.coalesce(F.octet_length("text"), F.lit(0)) + OVERHEAD).cast("long")
    own = F.when(F.col("doc_id").isNull(), F.xxhash64(F.monotonically_increasing_id(), F.lit(29))).otherwise(F.xxhash64("doc_id", F.lit(23)))
    return documents.withColumn("size", size).withColumn("key", F.xxhash64("text")).withColumn("spread", own)


def draw(u: Column, size: Column, total: int, sample: int) -> Column:
    """Size-weighted draw: true with probability size * sample / total."""
    return (F.pmod(u, F.lit(1 << 40)) / float(1 << 40)) < size * (sample / total)


def splitters(rows: DataFrame, total: int, ranges: int = RANGES, sample: int = SAMPLE) -> list[int]:
    """Distinct keys at the weighted quantiles of a size-weighted sample. A record larger than total / sample is always drawn and keeps its weight."""
    drawn = rows.where(draw(F.xxhash64("key", "doc_id", F.lit(11)), F.col("size"), total, sample)).select("key", F.greatest("size", F.lit(total / sample)).alias("weight")).collect()
    drawn.sort()
    mass, out, at = sum(r.weight for r in drawn), [], 0.0
    for r in drawn:
        at += r.weight
        if at >= mass * (len(out) + 1) / ranges:
            out.append(r.key)
            at = max(at, 0.0)
            while len(out) < ranges and at >= mass * (len(out) + 1) / ranges:
                out.append(r.key)
    return sorted(set(out[: ranges - 1]))


def range_of(key: Column, cuts: list[int], base: int = 0) -> Column:
    """Number of cuts below the key, as a balanced tree of comparisons."""
    if not cuts:
        return F.lit(base)
    mid = len(cuts) // 2
    return F.when(key <= F.lit(cuts[mid]), range_of(key, cuts[:mid], base)).otherwise(range_of(key, cuts[mid + 1 :], base + mid + 1))


def ranged(rows: DataFrame, cuts: list[int]) -> DataFrame:
    """Adds range_no, the only place where the tree of comparisons stands."""
    return rows.withColumn("range_no", range_of(F.col("key"), cuts))


def _part(parts: dict[int, int], ranges: int) -> Column:
    """Subdivision of a row's range; 0 in ranges that are whole."""
    return F.pmod(F.col("spread"), F.element_at(F.array(*(F.lit(parts.get(k, 1)) for k in range(ranges))), F.col("range_no") + 1)).cast("int")


@dataclass
class Plan:
    """Where the cells are cut, and what stands before each of them."""

    cuts: list[int]
    parts: dict[int, int]
    ranges: int
    before: DataFrame
    total: int


def plan(rows: DataFrame, ranges: int = RANGES, sample: int = SAMPLE) -> tuple[Plan, DataFrame]:
    """The plan for narrow rows (doc_id, size, key, ...), and the rows with their cell."""
    count, total = rows.agg(F.count(F.lit(1)), F.sum("size")).first()
    cuts = splitters(rows, total, ranges, sample) if count else []
    rows = materialise(ranged(rows, cuts))
    parts = {}
    for r in rows.groupBy("range_no").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("bytes")).collect():  # one row a range
        load = max(r.n * ranges / count, r.bytes * ranges / total)
        parts[r.range_no] = max(math.ceil(load) if load > OVERFULL else 1, -(-r.n // CELL_ROWS), -(-r.bytes // CELL_BYTES))
    rows = rows.withColumn("part", _part(parts, ranges))
    per_cell = rows.groupBy("range_no", "part").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("bytes"))
    order = W.orderBy("range_no", "part").rowsBetween(W.unboundedPreceding, -1)  # of cells, not of rows
    before = per_cell.select("range_no", "part", F.coalesce(F.sum("bytes").over(order), F.lit(0)).alias("bytes_before"), F.coalesce(F.sum("n").over(order), F.lit(0)).alias("rows_before"))
    return Plan(cuts, parts, ranges, materialise(before), total or 0), rows


def placed(rows: DataFrame, at: Plan, shards: int = SHARDS) -> DataFrame:
    """Adds shard and rank (over all rows) to rows with key, size, doc_id and their cell."""
    inside = W.partitionBy("range_no", "part").orderBy("key", "doc_id", "spread").rowsBetween(W.unboundedPreceding, 0)
    out = rows.withColumn("bytes_in", F.sum("size").over(inside)).withColumn("rows_in", F.count(F.lit(1)).over(inside))
    out = out.join(at.before, ["range_no", "part"])
    shard = F.least(F.expr(f"({shards}L * (2 * (bytes_before + bytes_in) - size)) div {2 * max(at.total, 1)}L"), F.lit(shards - 1)).cast("int")
    return out.withColumn("shard", shard).withColumn("rank", F.col("rows_before") + F.col("rows_in") - 1).drop("range_no", "part", "bytes_in", "rows_in", "bytes_before", "rows_before")


def assign(documents: DataFrame, shards: int = SHARDS, ranges: int = RANGES, sample: int = SAMPLE) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard of every document."""
    rows = materialise(keyed(documents.select("doc_id", "text")).select("doc_id", "size", "key", "spread", F.crc32(F.col("text").cast("binary")).alias("text_crc32")))
    at, rows = plan(rows, ranges, sample)
    out = materialise(placed(rows, at, shards))
    first = out.groupBy("shard").agg(F.min("rank").alias("first_rank"))
    out = out.join(F.broadcast(first), "shard")  # one row a shard
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("rank") - F.col("first_rank")).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))


def sharded_documents(documents: DataFrame, shards: int = SHARDS, ranges: int = RANGES, sample: int = SAMPLE) -> DataFrame:
    """The documents with shard and slot. They are written once with what places them; texts then move once, in the exchange of the cells."""
    columns = documents.columns
    wide = materialise(keyed(documents.select("doc_id", "text", F.struct(*columns).alias("carried"))).drop("text"))
    at, narrow = plan(wide.select("doc_id", "size", "key", "spread"), ranges, sample)
    first = placed(narrow, at, shards).groupBy("shard").agg(F.min("rank").alias("first_rank"))
    wide = ranged(wide, at.cuts).withColumn("part", _part(at.parts, ranges))
    out = placed(wide, at, shards).join(F.broadcast(first), "shard")
    return out.select(*(F.col("carried")[c].alias(c) for c in columns), "shard", (F.col("rank") - F.col("first_rank")).cast("long").alias("slot"))
