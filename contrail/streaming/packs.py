"""Rows of a stream packed by key, batch by batch and without state."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, types as T

# rows a task holds at once while it packs, and the most in one list
PACK_ROWS, LIST_ROWS = 1_000_000, 10_000
# tasks at least: few tasks would each see many keys, and make short lists
PACK_TASKS = 48


def pack(batches: list[pa.RecordBatch], by: list[str], name: str, longest: int = LIST_ROWS) -> pa.RecordBatch:
    """A row per key of ``by`` and ``longest`` of its rows, with their other columns as a list of structs."""
    rows = pa.Table.from_batches(batches).combine_chunks()
    key, keys = np.zeros(rows.num_rows, "int64"), 1
    for column in by:
        codes = rows[column].combine_chunks().dictionary_encode()
        if keys * len(codes.dictionary) >= 2**63:
            found, key = np.unique(key, return_inverse=True)
            keys = len(found)
        key = key * len(codes.dictionary) + codes.indices.to_numpy()
        keys *= len(codes.dictionary)
    order = np.argsort(key)
    starts = np.flatnonzero(np.diff(key[order], prepend=-1))
    ends = np.append(starts[1:], len(order))
    if (ends - starts).max() > longest:
        starts = np.concatenate([np.arange(a, b, longest) for a, b in zip(starts, ends)])
    rows = rows.take(pa.array(order)).combine_chunks().to_batches()[0]
    inner = rows.drop_columns(by).to_struct_array()
    lists = pa.ListArray.from_arrays(pa.array(np.append(starts, len(order)), "int32"), inner)
    keys = rows.select(by).take(pa.array(starts))
    return pa.RecordBatch.from_arrays([*keys.columns, lists], [*by, name])


def packed(rows: DataFrame, by: list[str], name: str, most: int = PACK_ROWS) -> DataFrame:
    """Rows of a batch as (``by``, ``name``), where ``name`` lists the other columns of the rows of the key.

    Rows of a key meet in one task, which packs every ``most`` rows it gets. Rows with a null in ``by`` are
    left out. The lists hold each other row once; exploded they give the rows back.
    """
    kept = rows.dropna(subset=by)
    fields = {f.name: f for f in kept.schema.fields}
    inner = T.StructType([T.StructField(f.name, f.dataType) for f in kept.schema.fields if f.name not in by])
    outer = T.StructType([T.StructField(c, fields[c].dataType) for c in by])
    outer = outer.add(name, T.ArrayType(inner))

    def packs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            if batch.num_rows:
                held.append(batch)
                size += batch.num_rows
            if size >= most:
                yield pack(held, by, name)
                held, size = [], 0
        if held:
            yield pack(held, by, name)
        held = []
        # the worker lives on beside the state of the join
        pa.default_memory_pool().release_unused()

    tasks = max(PACK_TASKS, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return kept.repartition(tasks, *by).mapInArrow(packs, outer)
