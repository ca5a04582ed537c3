"""A table of the newest row per key, kept by batches that touch only the buckets of their keys.

Rows lie under ``bucket=b/batch=n/whole=w``: a bucket is a hash of the key; a batch adds the newest
rows of its keys as a delta (w = 0). Once a bucket holds ``compact`` deltas, the batch that touches it
next also writes the bucket as a whole (w = 1), and the batch after that deletes what the whole
replaces. Nothing else is read or written, so a batch costs what it holds and not what the table
holds.

The newest row per key over all that lies there is the table; older rows do no harm. So a batch may be
written again any number of times, and a reader that runs between a whole and the deletion sees
the same rows.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, functions as F

from contrail.operators.serving import latest

BUCKETS = 64
COMPACT = 8
PARTS = ["bucket", "batch", "whole"]
_PART = re.compile(r"/bucket=(\d+)/batch=(\d+)/whole=([01])$")


@dataclass
class KeyedTable:
    spark: SparkSession
    root: str
    key: str
    time: str
    tie: str
    buckets: int = BUCKETS
    compact: int = COMPACT

    def __post_init__(self):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.root)
        self._files = path.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _path(self, text: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(text)

    def parts(self) -> dict[int, list[tuple[int, int]]]:
        """(batch, whole) of every bucket in order: at most some times ``compact`` for each."""
        found: dict[int, list[tuple[int, int]]] = {}
        for status in self._files.globStatus(self._path(f"{self.root}/bucket=*/batch=*/whole=*")) or ():
            bucket, batch, whole = map(int, _PART.search(status.getPath().toString()).groups())
            found.setdefault(bucket, []).append((batch, whole))
        return {bucket: sorted(held) for bucket, held in found.items()}

    def _folder(self, bucket: int, batch: int, whole: int) -> str:
        return f"{self.root}/bucket={bucket}/batch={batch}/whole={whole}"

    def _write(self, rows: DataFrame, batch: int, whole: int) -> None:
        placed = rows.withColumns({"batch": F.lit(batch).cast("long"), "whole": F.lit(whole)})
        # one file for each bucket that is touched
        placed.repartition("bucket").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(
            *PARTS
        ).parquet(self.root)

    def merge(self, rows: DataFrame, batch: int) -> None:
        """Take in the rows of a batch; a repeated batch leaves the table as it is."""
        self.sweep(batch)
        bucket = F.pmod(F.xxhash64(self.key), F.lit(self.buckets)).cast("int")
        self._write(latest(rows, self.key, self.time, self.tie).withColumn("bucket", bucket), batch, 0)
        held = self.parts()
        due = [
            bucket
            for bucket, parts in held.items()
            if (batch, 0) in parts and sum(1 for b, w in parts if b <= batch and not w) >= self.compact
        ]
        if due:
            folders = [self._folder(b, *part) for b in due for part in held[b] if part != (batch, 1)]
            old = self.spark.read.option("basePath", self.root).parquet(*folders)
            whole = latest(old.drop("batch", "whole", "bucket"), self.key, self.time, self.tie)
            self._write(whole.withColumn("bucket", bucket), batch, 1)

    def sweep(self, batch: int) -> int:
        """Delete what wholes of batches before this one replace; the number of folders deleted."""
        gone = 0
        for bucket, parts in self.parts().items():
            wholes = [part for part in parts if part[1] and part[0] < batch]
            for part in parts if wholes else ():
                if part < wholes[-1]:
                    gone += bool(self._files.delete(self._path(f"{self.root}/bucket={bucket}/batch={part[0]}/whole={part[1]}"), True))
        return gone

    def read(self, columns: list[str]) -> DataFrame | None:
        """The newest row per key, None before the first batch."""
        if not self.parts():
            return None
        rows = self.spark.read.parquet(self.root)
        return latest(rows.select(columns), self.key, self.time, self.tie).select(columns)
