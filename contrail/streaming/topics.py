"""The three event topics as streams, from files or from a broker."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from contrail.session import scratch_path
from contrail.sources import adapters

# fixed values: topic names and their partition count
TOPICS = ("flight-position", "weather-event", "gate-event")
TOPIC_PARTITIONS = 3

# topic -> (table the files hold, rows of the topic, key, event time)
FEEDS: dict[str, tuple[str, Callable[[DataFrame], DataFrame], str, str]] = {
    "flight-position": ("events", adapters.positions, "icao24", "position_time"),
    "weather-event": ("lineitem", adapters.weather_readings, "airport_code", "observed_at"),
    "gate-event": ("orders", adapters.gate_events, "airport_code", "event_time"),
}


def stream_files(spark: SparkSession, folder: str, name: str, files_per_trigger: int | None = None) -> DataFrame:
    """A growing set of parquet files ``name*.parquet`` as a stream."""
    path = f"{folder}/{name}*.parquet"
    reader = spark.readStream.schema(spark.read.parquet(path).schema)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.parquet(path)


def stream_broker(spark: SparkSession, topic: str, schema: str, servers: str) -> tuple[DataFrame, DataFrame]:
    """A broker topic of JSON messages as (rows, rejects); needs the Kafka connector on the cluster."""
    raw = spark.readStream.format("kafka").option("kafka.bootstrap.servers", servers).option("subscribe", topic)
    return decode(raw.load(), schema)


def decode(messages: DataFrame, schema: str) -> tuple[DataFrame, DataFrame]:
    """The JSON ``value`` of broker messages as columns, and what could not be read.

    Rejects carry the message as ``raw`` and a ``reason``; every message is in exactly one part.
    """
    raw = F.col("value").cast("string")
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_broken"}
    parsed = messages.select(raw.alias("raw"), F.from_json(raw, schema + ", _broken string", options).alias("_m"))
    reason = (
        F.when(F.col("raw").isNull(), "no message")
        .when(F.col("_m").isNull() | F.col("_m._broken").isNotNull(), "broken message")
    )
    told = parsed.withColumn("reason", reason)
    rows = told.filter("reason IS NULL").select("_m.*").drop("_broken")
    return rows, told.filter("reason IS NOT NULL").select("raw", "reason")


def read_stream(spark: SparkSession, topic: str, folder: str, files_per_trigger: int | None = None) -> DataFrame:
    """The typed rows of a topic."""
    name, rows, _, _ = FEEDS[topic]
    return rows(stream_files(spark, folder, name, files_per_trigger))


def partition_of(key: Column, partitions: int = TOPIC_PARTITIONS) -> Column:
    """The topic partition a key belongs to."""
    return F.conv(F.substring(F.md5(key), 1, 8), 16, 10).cast("bigint") % partitions


def topic_rows(rows_of: Callable[[str], DataFrame]) -> DataFrame:
    """All three topics together as (topic, partition, key, event_time) and a column per topic with its rows."""
    merged = None
    for topic in TOPICS:
        rows, (_, _, key, time) = rows_of(topic), FEEDS[topic]
        shaped = rows.select(
            F.lit(topic).alias("topic"),
            partition_of(F.col(key)).cast("int").alias("partition"),
            F.col(key).alias("key"),
            F.col(time).alias("event_time"),
            F.struct("*").alias(topic),
        )
        merged = shaped if merged is None else merged.unionByName(shaped, allowMissingColumns=True)
    return merged


def payload() -> Column:
    """The row of :func:`topic_rows` as the JSON text of its message."""
    return F.coalesce(*[F.to_json(F.col(f"`{topic}`")) for topic in TOPICS])


def landed_rows(spark: SparkSession, folder: str) -> DataFrame:
    """What the tables of a folder hold for the topics, see :func:`topic_rows`."""

    def rows_of(topic: str) -> DataFrame:
        name, rows, _, _ = FEEDS[topic]
        return rows(adapters.table(spark, folder, name))

    return topic_rows(rows_of)


def landed(spark: SparkSession, folder: str) -> DataFrame:
    """The messages that the tables of a folder stand for."""
    rows = landed_rows(spark, folder)
    return rows.select("topic", "partition", "key", "event_time", payload().alias("payload"))


def run_to_table(
    stream: DataFrame,
    label: str,
    path: str | None = None,
    checkpoint: str | None = None,
    trigger: dict[str, object] | None = None,
) -> DataFrame:
    """A stream into a table, and that table.

    Without ``trigger`` the job works off what the sources hold now and stops; with one,
    such as ``{"processingTime": "30 seconds"}``, it goes on in the background. A job that is
    started again with the same ``path`` and ``checkpoint`` goes on where it stopped.
    """
    spark = stream.sparkSession
    path = path or scratch_path(spark, label)
    query = (
        stream.writeStream.format("parquet")
        .outputMode("append")
        .option("checkpointLocation", checkpoint or path.rstrip("/") + "-checkpoint")
        .trigger(**(trigger or {"availableNow": True}))
        .start(path)
    )
    if not trigger:
        query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(path)
