"""Toxicity by a factorization machine over hashed terms (see factorization).

The machine is trained on the driver with at most ``SAMPLE`` labelled documents of each
label; every document is then scored whole, in numpy, without a shuffle. The model
(4 to 20 MB) goes out once as a broadcast of fixed size: 2^18 buckets of nine numbers.

Defined results: null and empty texts are scored as a text without terms; repeated rows
score equally; without labelled rows, or with one label only, all scores are the share of
label 1; a null label does not train. Only doc_id and text of the documents are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm import factorization as FM
from tessera.llm import kernel as K
from tessera.llm.common import small_batches
from tessera.llm.labelled import fold, sample

#: Most labelled documents of each label that training reads.
SAMPLE = {1: 1500, 0: 3000}


def train(documents: DataFrame, labels: DataFrame, usable: Column, most: dict[int, int] = SAMPLE) -> FM.Machine:
    texts, marks = sample(documents, labels, "toxic", usable, most)
    return FM.train(texts, marks)


def batch_scores(text: pa.Array, machine: FM.Machine) -> np.ndarray:
    found = [machine.scores(a, offsets) for _, _, a, offsets in K.runs(text)]
    return np.concatenate(found) if found else np.zeros(0)


def _scorer(model, keep: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = model.value
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*(batch[c] for c in keep), pa.array(batch_scores(batch["text"], machine))], [*keep, "score"])

    return run


def scores(documents: DataFrame, machine: FM.Machine, threshold: float = FM.THRESHOLD) -> DataFrame:
    """doc_id, score, predicted of every document."""
    small_batches(documents.sparkSession)
    model = documents.sparkSession.sparkContext.broadcast(machine)
    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_scorer(model, ["doc_id"]), "doc_id long, score double")
    return rows.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def reject(documents: DataFrame, machine: FM.Machine, threshold: float = FM.THRESHOLD) -> DataFrame:
    """The documents that score below the threshold; columns unchanged."""
    small_batches(documents.sparkSession)
    model = documents.sparkSession.sparkContext.broadcast(machine)
    at = documents.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(batch_scores(batch.column(at), model.value) < threshold))

    return documents.mapInArrow(run, T.StructType([T.StructField(f.name, f.dataType) for f in documents.schema.fields]))


def held_out_scores(documents: DataFrame, labels: DataFrame, most: dict[int, int] = SAMPLE) -> DataFrame:
    """doc_id, held_out, score, predicted; rows of fold 1 of 3 never train."""
    machine = train(documents, labels, fold(F.col("doc_id"), 3) != 1, most)
    return scores(documents, machine).select("doc_id", (fold(F.col("doc_id"), 3) == 1).alias("held_out"), "score", "predicted")
