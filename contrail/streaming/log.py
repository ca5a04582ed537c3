"""Landed topic logs: segments of numbered messages, and a stream source that reads them.

A log is a folder of Parquet files ``topic=…/partition=…/segment=…``. Every message has an
offset, consecutive inside its topic partition and in the order of event time, so
messages of one key stay in order. :func:`publish` appends to a log as a Spark job; the data source
``landed_log`` reads it as a stream or as a batch, without a broker. A stream keeps one offset per
topic partition in its checkpoint, so a job that is started again reads each message once, and a batch
that failed is read again from the same offsets.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition
from pyspark.sql.types import StructType

from contrail.operators.spread import dense_ids

SEGMENT_ROWS = 100_000
LOG_SCHEMA = "topic string, partition int, offset bigint, key string, event_time timestamp, payload string"
_PLACE = re.compile(r"topic=([^/]+)/partition=(\d+)/segment=\d+/[^/_.][^/]*\.parquet$")

Offsets = dict[str, dict[str, int]]


def publish(messages: DataFrame, root: str, segment_rows: int = SEGMENT_ROWS, payload: Column | None = None) -> None:
    """Append (topic, partition, key, event_time, payload) behind what the log holds.

    With ``payload``, messages hold other columns instead of that one, and it makes the payload out of
    them: once, when the messages are written, and not in each pass before. Messages of one key and
    instant then stand in the order of a hash and not of their payload.

    Offsets are given by range partitions and their sizes, so no task sees a whole topic partition; a
    file holds at most ``segment_rows`` messages. One job at a time may append to a topic.
    """
    spark = messages.sparkSession
    place, order = ["topic", "partition"], ["topic", "partition", "event_time", "key"]
    rest = [f"`{name}`" for name in messages.columns if name not in order]
    if payload is None:
        order.append("payload")
    else:
        messages, order = messages.withColumn("_tie", F.xxhash64(*rest)), [*order, "_tie"]
    numbered = dense_ids(messages, order, "_id", start=0)
    # one row per topic partition on either side
    firsts = numbered.groupBy(place).agg(F.min("_id").alias("_first"))
    held = log_ends(spark, root)
    firsts = firsts.join(held, place, "left").withColumn("_next", F.coalesce("next", F.lit(0))).drop("next")
    rows = numbered.join(F.broadcast(firsts), place).withColumn("offset", F.col("_id") - F.col("_first") + F.col("_next"))
    rows = rows.withColumn("segment", F.floor(F.col("offset") / segment_rows))
    kept = rows.select(*place, "segment", "offset", "key", F.unix_micros("event_time").alias("event_us"), *rest)
    ordered = kept.repartition(*place, "segment").sortWithinPartitions(*place, "segment", "offset")
    text = F.col("payload") if payload is None else payload.alias("payload")
    ordered.select(*place, "segment", "offset", "key", "event_us", text).write.mode("append").partitionBy(*place, "segment").parquet(root)


def log_ends(spark: SparkSession, root: str) -> DataFrame:
    """(topic, partition, next): the offset that the next message of each topic partition gets."""
    try:
        held = spark.read.schema("offset bigint, topic string, partition int, segment bigint").parquet(root)
    except AnalysisException:
        return spark.createDataFrame([], "topic string, partition int, next bigint")
    return held.groupBy("topic", "partition").agg((F.max("offset") + 1).alias("next"))


@dataclass
class Span(InputPartition):
    """Offsets ``first`` up to but not including ``stop`` of one file."""

    topic: str
    partition: int
    path: str
    first: int
    stop: int


class LogFiles:
    """What the files of a log hold, from their footers."""

    def __init__(self, root: str):
        self.files, self.root = fs.FileSystem.from_uri(root)
        self.known: dict[str, Span] = {}

    def spans(self) -> dict[tuple[str, int], list[Span]]:
        selector = fs.FileSelector(self.root, recursive=True, allow_not_found=True)
        found: dict[tuple[str, int], list[Span]] = {}
        for info in self.files.get_file_info(selector):
            place = _PLACE.search(info.path)
            if not place or "/_temporary/" in info.path:
                continue
            span = self.known.get(info.path) or self._footer(info.path, place[1], int(place[2]))
            if span:
                self.known[info.path] = span
                found.setdefault((span.topic, span.partition), []).append(span)
        return {key: sorted(spans, key=lambda s: s.first) for key, spans in found.items()}

    def _footer(self, path: str, topic: str, partition: int) -> Span | None:
        with self.files.open_input_file(path) as source:
            held = pq.read_metadata(source)
        at = held.schema.names.index("offset")
        groups = [held.row_group(i).column(at).statistics for i in range(held.num_row_groups)]
        if not held.num_rows:
            return None
        return Span(topic, partition, path, min(g.min for g in groups), max(g.max for g in groups) + 1)

    def bounds(self) -> tuple[Offsets, Offsets]:
        """The first offset of every topic partition, and where its unbroken run of messages ends."""
        first: Offsets = {}
        reach: Offsets = {}
        for (topic, partition), spans in sorted(self.spans().items()):
            stop = spans[0].first
            for span in spans:
                if span.first > stop:
                    break  # an earlier file is not there yet
                stop = max(stop, span.stop)
            first.setdefault(topic, {})[str(partition)] = spans[0].first
            reach.setdefault(topic, {})[str(partition)] = stop
        return first, reach

    def between(self, start: Offsets, end: Offsets, lossy: bool) -> list[Span]:
        """The parts of files that hold the offsets from ``start`` up to ``end``."""
        spans, (earliest, reach) = self.spans(), self.bounds()
        parts = []
        for topic, stops in end.items():
            for partition, stop in stops.items():
                known = earliest.get(topic, {}).get(partition, stop)
                begin = start.get(topic, {}).get(partition, known)
                if begin >= stop:
                    continue
                if not lossy and (begin < known or reach.get(topic, {}).get(partition, 0) < stop):
                    raise ValueError(f"messages {begin} to {stop} of {topic} {partition} are no longer in the log")
                for span in spans.get((topic, int(partition)), []):
                    low, high = max(begin, span.first), min(stop, span.stop)
                    if low < high:
                        parts.append(Span(topic, int(partition), span.path, low, high))
        return parts


def _messages(files: fs.FileSystem, span: Span) -> Iterator[pa.RecordBatch]:
    """The messages of a part as batches of the log's schema."""
    with files.open_input_file(span.path) as source:
        held = pq.ParquetFile(source)
        at = held.metadata.schema.names.index("offset")
        groups = [held.metadata.row_group(i).column(at).statistics for i in range(held.num_row_groups)]
        wanted = [i for i, g in enumerate(groups) if g.min < span.stop and g.max >= span.first]
        for batch in held.iter_batches(columns=["offset", "key", "event_us", "payload"], row_groups=wanted):
            offset = batch.column("offset").to_numpy()
            inside = (offset >= span.first) & (offset < span.stop)
            batch = batch.filter(pa.array(inside))
            rows = batch.num_rows
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([span.topic] * rows, pa.string()),
                    pa.array([span.partition] * rows, pa.int32()),
                    batch.column("offset"),
                    batch.column("key").cast(pa.string()),
                    batch.column("event_us").cast(pa.timestamp("us")).cast(pa.timestamp("us", "UTC")),
                    batch.column("payload").cast(pa.string()),
                ],
                ["topic", "partition", "offset", "key", "event_time", "payload"],
            )


class _Log:
    """What both readers share; options come as text."""

    def __init__(self, options: dict[str, str]):
        self.root = options["path"]
        self.topics = [name for name in options.get("topics", "").split(",") if name]
        self.latest = options.get("startingoffsets", "earliest") == "latest"
        self.lossy = options.get("failondataloss", "true").lower() == "false"
        self._files: LogFiles | None = None

    def __getstate__(self):
        return {**self.__dict__, "_files": None}

    @property
    def files(self) -> LogFiles:
        self._files = self._files or LogFiles(self.root)
        return self._files

    def wanted(self, offsets: Offsets) -> Offsets:
        return {topic: held for topic, held in offsets.items() if not self.topics or topic in self.topics}

    def read(self, partition: Span) -> Iterator[pa.RecordBatch]:
        return _messages(self.files.files, partition)


class LogStreamReader(_Log, DataSourceStreamReader):
    def initialOffset(self) -> Offsets:
        first, reach = self.files.bounds()
        return self.wanted(reach if self.latest else first)

    def latestOffset(self) -> Offsets:
        return self.wanted(self.files.bounds()[1])

    def partitions(self, start: Offsets, end: Offsets) -> Sequence[InputPartition]:
        return self.files.between(start, end, self.lossy)


class LogReader(_Log, DataSourceReader):
    def partitions(self) -> Sequence[InputPartition]:
        first, reach = self.files.bounds()
        return self.files.between(self.wanted(first), self.wanted(reach), self.lossy)


class LandedLog(DataSource):
    """``spark.readStream.format("landed_log")``; options ``path``, ``topics`` (comma-joined; all if not
    given), ``startingOffsets`` (earliest or latest) and ``failOnDataLoss``."""

    @classmethod
    def name(cls) -> str:
        return "landed_log"

    def schema(self) -> str:
        return LOG_SCHEMA

    def _lowered(self) -> dict[str, str]:
        return {name.lower(): value for name, value in self.options.items()}

    def reader(self, schema: StructType) -> DataSourceReader:
        return LogReader(self._lowered())

    def streamReader(self, schema: StructType) -> DataSourceStreamReader:
        return LogStreamReader(self._lowered())


def stream_log(spark: SparkSession, root: str, **options: str) -> DataFrame:
    """The messages of a log as a stream."""
    spark.dataSource.register(LandedLog)
    return spark.readStream.format("landed_log").options(**options).load(root)


def read_log(spark: SparkSession, root: str, **options: str) -> DataFrame:
    """All messages that a log holds now."""
    spark.dataSource.register(LandedLog)
    return spark.read.format("landed_log").options(**options).load(root)
