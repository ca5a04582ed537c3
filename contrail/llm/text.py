"""Helpers shared by the text operators: Arrow columns as bytes, words, hashes."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

# words of the contracts: digits, a-z and everything beyond ASCII, over lower-cased UTF-8
WORD = re.compile(rb"[0-9a-z\x80-\xff]+")


BATCH_ROWS, BATCH_BYTES = 1024, 8_000_000


def bound_batches(spark: SparkSession) -> None:
    """Arrow batches that suit whole texts: a few MB each, however long the rows are."""
    for key, most in (("maxRecordsPerBatch", str(BATCH_ROWS)), ("maxBytesPerBatch", f"{BATCH_BYTES}b")):
        name = f"spark.sql.execution.arrow.{key}"
        held = spark.conf.get(name).lower().removesuffix("b")
        if not held.isdigit() or not 0 < int(held) <= int(most.removesuffix("b")):
            spark.conf.set(name, most)


def blobs(column: pa.Array) -> list[bytes]:
    """A string or binary column as bytes; null counts as empty."""
    if pa.types.is_struct(column.type):
        raise TypeError("a text column is wanted")
    return [b"" if value is None else value for value in column.cast(pa.binary()).to_pylist()]


def slabs(texts: list[bytes], most: int) -> Iterator[tuple[int, int]]:
    """Runs of texts that hold about ``most`` bytes together; a longer text stands alone."""
    start = held = 0
    for at, text in enumerate(texts):
        if held and held + len(text) > most:
            yield start, at
            start, held = at, 0
        held += len(text)
    if start < len(texts):
        yield start, len(texts)


def words(text: bytes) -> list[bytes]:
    """Lower-cased words; only A-Z change case."""
    return WORD.findall(text.lower())


def free_name(frame: DataFrame, name: str) -> str:
    """``name``, with underscores in front until no column is called so."""
    taken = {column.lower() for column in frame.columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def sha256_hex(column: Column) -> Column:
    return F.sha2(column, 256)


def held_out(doc_id: str | Column) -> Column:
    """True for the rows no classifier may learn from; a null id is not held out."""
    column = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.coalesce(F.crc32(column.cast("string").cast("binary")) % 3 == 1, F.lit(False))
