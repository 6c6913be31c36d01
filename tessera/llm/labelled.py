"""A bounded, reproducible sample of labelled documents for training on the driver."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.llm.common import drop, materialise

#: Most bytes of text in a training sample. Documents beyond it stay out of training, in the order of the sample; every document is scored all the same.
SAMPLE_BYTES = 96 << 20


def fold(doc_id: Column, folds: int) -> Column:
    """crc32 of the id as text, modulo folds; null ids count as empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % folds


def sample(documents: DataFrame, labels: DataFrame, label: str, usable: Column, most: dict[int, int], sample_bytes: int = SAMPLE_BYTES) -> tuple[list[bytes], np.ndarray]:
    """Texts and labels of at most most[v] documents with label v, chosen by a hash of their id, and of sample_bytes bytes in all.

    Rows with null or other labels are left out; the ids of the sample (at most the
    sum of the bounds) are broadcast, so the documents are scanned once and not shuffled.
    An id with several labels has the greatest; an id with several texts has the one of
    least hash, so that reruns train on the same rows. Ids are numbers; others have no label.
    """
    spark = documents.sparkSession
    labelled = labels.where(usable).select(F.col("doc_id").cast("string").try_cast("long").alias("doc_id"), F.col(label).cast("int").alias("label")).where("doc_id is not null")
    labelled = labelled.groupBy("doc_id").agg(F.max("label").alias("label"))
    chosen = [r for v, n in most.items() for r in labelled.where(F.col("label") == v).orderBy(F.xxhash64("doc_id"), "doc_id").limit(n).collect()]
    if not chosen:
        return [], np.zeros(0, np.int64)
    ids = spark.createDataFrame([(int(r.doc_id), int(r.label)) for r in chosen], "of_doc long, label int")
    rows = documents.select(F.col("doc_id").cast("string").try_cast("long").alias("doc_id"), "text").where("text is not null").join(F.broadcast(ids), F.col("doc_id") == F.col("of_doc"))
    held = materialise(rows.select("doc_id", "label", "text", F.xxhash64("text").alias("text_hash"), F.octet_length("text").cast("long").alias("size")))
    # Of the sample's rows alone: at most the sum of the bounds, and their repetitions.
    one = held.select("doc_id", "text_hash", "size").distinct().withColumn("nth", F.row_number().over(W.partitionBy("doc_id").orderBy("text_hash", "size"))).where("nth = 1")
    fits, total = [], 0
    for r in sorted(one.collect(), key=lambda r: (hash_order(r.doc_id), r.doc_id)):
        if total + r.size <= sample_bytes:
            total += r.size
            fits.append((r.doc_id, r.text_hash))
    if not fits:
        drop(held)
        return [], np.zeros(0, np.int64)
    wanted = spark.createDataFrame(fits, "fit_doc long, fit_hash long")
    got = held.join(F.broadcast(wanted), (F.col("doc_id") == F.col("fit_doc")) & (F.col("text_hash") == F.col("fit_hash")))
    found = {r.doc_id: (r.text.encode(), r.label) for r in got.select("doc_id", "text", "label").toLocalIterator()}
    drop(held)
    order = sorted(found)
    return [found[k][0] for k in order], np.array([found[k][1] for k in order], np.int64)


def hash_order(doc_id: int) -> int:
    """An order of ids that has nothing to do with their size."""
    return (doc_id * 0x9E3779B97F4A7C15 >> 7) % (1 << 40)
