"""Rows a stream dropped for being late, told by the engine's own figures as a table."""

from __future__ import annotations

import json
import threading
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQueryListener

OBSERVED = "arrivals"
SCHEMA = "batch bigint, rows bigint, dropped bigint, max_time timestamp, watermark timestamp"
LANDINGS = ", landing int"


def _micros(text: str | None) -> str | None:
    """A progress time as one that JSON readers take; the watermark starts at the epoch, which means none yet."""
    if not text:
        return None
    at = datetime.fromisoformat(text.replace("Z", "+00:00")).astimezone(timezone.utc)
    return None if at.timestamp() == 0 else at.strftime("%Y-%m-%dT%H:%M:%S.%fZ")


class LateRows(StreamingQueryListener):
    """Leaves one small file per batch of one query name; a batch that is run again replaces its file.

    Figures are the engine's: rows and newest event time as observed on the way in, rows that
    stateful operators dropped behind the watermark, and the watermark itself. The files are written
    as the batches end, so they outlive the driver, and batches of several runs stay side by side.
    """

    def __init__(self, spark: SparkSession, query: str, target: str):
        self.spark, self.query, self.target = spark, query, target.rstrip("/")
        self.ended, self.fault, self._runs = threading.Event(), None, set()

    def onQueryStarted(self, event) -> None:
        if event.name == self.query:
            self._runs.add(str(event.runId))

    def onQueryProgress(self, event) -> None:
        told = event.progress
        if told.name != self.query:
            return
        seen = told.observedMetrics.get(OBSERVED)
        row = {
            "batch": told.batchId,
            "rows": 0 if seen is None else seen["rows"],
            "dropped": sum(o.numRowsDroppedByWatermark for o in told.stateOperators),
            "max_time": None if seen is None else _micros(seen["max_time"]),
            "watermark": _micros(told.eventTime.get("watermark")),
        }
        try:
            self._put(f"{self.target}/batch-{told.batchId:012d}.json", json.dumps(row) + "\n")
        except Exception as error:  # the bus only logs it, so keep it for the caller
            self.fault = error

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        if str(event.runId) in self._runs:
            self.ended.set()

    def _put(self, name: str, text: str) -> None:
        jvm, conf = self.spark._jvm, self.spark._jsc.hadoopConfiguration()
        path = jvm.org.apache.hadoop.fs.Path(name)
        out = path.getFileSystem(conf).create(path, True)
        try:
            out.write(bytearray(text.encode()))
        finally:
            out.close()


def observed(stream: DataFrame, time: str) -> DataFrame:
    """The stream with its rows and newest time counted as they come in, before any watermark."""
    newest = F.date_format(F.max(time), "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX").alias("max_time")
    return stream.observe(OBSERVED, F.count(F.lit(1)).alias("rows"), newest)


def run_with_report(
    stream: DataFrame, name: str, target: str, report: str, checkpoint: str | None = None, wait_s: float = 60
) -> DataFrame:
    """Work a stream off into a table and give the report so far, one row per batch that had rows.

    ``stream`` went through :func:`observed` before its stateful operator. Started again with the same
    folders the job goes on, and so does the report. ``name`` is the query's; use one per running job.
    """
    spark = stream.sparkSession
    listener = LateRows(spark, name, report)
    spark.streams.addListener(listener)
    try:
        query = (
            stream.writeStream.format("parquet")
            .queryName(name)
            .outputMode("append")
            .option("checkpointLocation", checkpoint or target.rstrip("/") + "-checkpoint")
            .trigger(availableNow=True)
            .start(target)
        )
        query.awaitTermination()
        # events come in order, so the end tells that every batch has been written
        if not listener.ended.wait(wait_s):
            raise TimeoutError(f"no end of {name} told within {wait_s} s")
    finally:
        spark.streams.removeListener(listener)
    if listener.fault:
        raise listener.fault
    return read_report(spark, report)


def read_report(spark: SparkSession, report: str) -> DataFrame:
    """The report as a table; batches that only moved the watermark on are left out.

    Where it lies in folders ``landing=…``, their numbers are a column, else that is null.
    """
    return spark.read.schema(SCHEMA + LANDINGS).json(report).filter("rows > 0 OR dropped > 0")
