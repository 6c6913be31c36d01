"""Quality by a byte-level convolutional network (see byte_cnn).

The network is trained on the driver with at most ``SAMPLE`` labelled documents of each
label; every document is then scored whole, in numpy, without a shuffle. The model is
a few thousand numbers, whatever the input.

Defined results: null and empty texts are scored as a text without filter responses;
repeated rows score equally; without labelled rows, or with one label only,
all scores are the share of label 1 (0.5 without any); a null label does not train. Only
doc_id and text of the documents are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm import byte_cnn as C
from tessera.llm import kernel as K
from tessera.llm.common import small_batches
from tessera.llm.labelled import fold, sample

#: Most labelled documents of each label that training reads.
SAMPLE = {1: 1500, 0: 1500}
#: Bytes that are convolved at a time (more only for a longer text).
RUN = 1 << 18


def train(documents: DataFrame, labels: DataFrame, usable: Column, most: dict[int, int] = SAMPLE) -> C.Network:
    return C.train(*sample(documents, labels, "quality", usable, most), epochs=8)


def batch_scores(text: pa.Array, network: C.Network) -> np.ndarray:
    found = [network.scores(a, offsets) for _, _, a, offsets in K.runs(text, RUN)]
    return np.concatenate(found) if found else np.zeros(0)


def scores(documents: DataFrame, network: C.Network, threshold: float = C.THRESHOLD) -> DataFrame:
    """doc_id, score, predicted of every document."""
    small_batches(documents.sparkSession)
    model = documents.sparkSession.sparkContext.broadcast(network)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array(batch_scores(batch["text"], model.value))], ["doc_id", "score"])

    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, score double")
    return rows.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def held_out_scores(documents: DataFrame, labels: DataFrame, most: dict[int, int] = SAMPLE) -> DataFrame:
    """doc_id, held_out, score, predicted; rows of fold 0 of 5 never train."""
    network = train(documents, labels, fold(F.col("doc_id"), 5) != 0, most)
    return scores(documents, network).select("doc_id", (fold(F.col("doc_id"), 5) == 0).alias("held_out"), "score", "predicted")
