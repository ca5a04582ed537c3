"""Fitting a small model on a bounded sample of labelled rows, inside one task."""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator
from typing import Any

import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, functions as F

from contrail.llm.text import blobs, held_out

SAMPLE_ROWS = 6000
SAMPLE_BYTES = 20_000


def training_sample(
    docs: DataFrame,
    labels: DataFrame,
    label: str,
    rows: int = SAMPLE_ROWS,
    most_bytes: int = SAMPLE_BYTES,
    doc_id: str = "doc_id",
    text: str = "text",
) -> DataFrame:
    """At most ``rows`` labelled rows (text, y) that are not held out, drawn by a hash of the id.

    The bounds belong to the sample alone: texts of more than ``most_bytes`` bytes are not
    learned from, all are scored. Of repeated labels the larger one counts, of repeated
    documents the smaller text.
    """
    known = labels.select(F.col(doc_id).alias("doc_id"), F.col(label).cast("int").alias("y"))
    known = known.filter(F.col("y").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out("doc_id"))
    known = known.groupBy("doc_id").agg(F.max("y").alias("y"))
    chosen = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    texts = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    texts = texts.filter(F.octet_length("text") <= most_bytes)
    found = texts.join(F.broadcast(chosen), "doc_id")
    return found.groupBy("doc_id", "y").agg(F.min("text").alias("text"))


def fitted(sample: DataFrame, fit: Callable[[list[bytes], list[int]], Any]) -> Broadcast:
    """The model that ``fit`` makes of the whole sample, as a broadcast. Fitting runs on an executor."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = []
        for batch in batches:
            columns = [batch.column("doc_id").to_pylist(), blobs(batch.column("text")), batch.column("y").to_pylist()]
            rows += zip(*columns)
        rows.sort(key=lambda row: row[0])
        model = fit([text for _, text, _ in rows], [y for _, _, y in rows])
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(model)], pa.binary())], ["model"])

    gathered = sample.select("doc_id", "text", "y").coalesce(1)
    models = gathered.mapInArrow(run, "model binary").collect()
    # a frame that is known to be empty has no task to fit in
    content = bytes(models[0]["model"]) if models else pickle.dumps(fit([], []))
    return sample.sparkSession.sparkContext.broadcast(content)


_models: dict[bytes, Any] = {}


def model_of(shared: Broadcast) -> Any:
    """The unpickled model, once per Python worker."""
    content = shared.value
    if content not in _models:
        _models.clear()
        _models[content] = pickle.loads(content)
    return _models[content]
