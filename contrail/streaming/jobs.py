"""Stateful and enriching stream jobs over the position, weather and gate topics."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from contrail.operators.serving import window_metrics
from contrail.operators.spread import lookup_join, time_bucket
from contrail.session import scratch_path
from contrail.streaming.keyed import BUCKETS, KeyedTable
from contrail.streaming.packs import packed

WATERMARK = "10 minutes"


def windowed(positions: DataFrame, length: str = "5 minutes", slide: str | None = None) -> DataFrame:
    """Window metrics on a stream; a window comes out once the watermark passes its end."""
    return window_metrics(positions.withWatermark("position_time", WATERMARK), length, slide)


def deduplicated(positions: DataFrame) -> DataFrame:
    """Repeated polls collapse; which copy survives depends on arrival."""
    return positions.withWatermark("position_time", WATERMARK).dropDuplicatesWithinWatermark(
        ["icao24", "position_time"]
    )


def gate_with_airports(gate: DataFrame, airports: DataFrame) -> DataFrame:
    """Gate events with the static airport row."""
    place = airports.select("airport_code", "airport_name", "country")
    return lookup_join(gate, place, ["airport_code"], counted=airports)


def departures_with_weather(departures: DataFrame, weather: DataFrame) -> DataFrame:
    """Departure positions with each weather instant of their airport in the hour before.

    Repeated readings of one instant are dropped first, so the join gives a
    bounded number of rows per departure however many readings arrive. Both sides
    also meet by clock hour, which keeps the state behind one join key short. Departures of one
    airport and hour that come in one batch are held as a list, one row of the state with the time of
    the latest; so one behind the watermark is kept where it comes with one that is not.
    """
    d = packed(departures.withColumn("hour", time_bucket("position_time", 3600)), ["airport_code", "hour"], "places")
    d = d.withColumn("latest", F.array_max("places.position_time")).withWatermark("latest", WATERMARK)
    seen_hour = time_bucket("observed_at", 3600)
    w = (
        weather.select(F.col("airport_code").alias("station"), "observed_at")
        .withWatermark("observed_at", WATERMARK)
        .dropDuplicatesWithinWatermark(["station", "observed_at"])
        .withColumn("near_hour", F.explode(F.array(seen_hour, seen_hour + 1)))
    )
    # all in a list are less than an hour before the latest
    meet = (
        (F.col("airport_code") == F.col("station"))
        & (F.col("hour") == F.col("near_hour"))
        & (F.col("observed_at") >= F.col("latest") - F.expr("INTERVAL 2 HOURS"))
        & (F.col("observed_at") <= F.col("latest"))
    )
    met = d.join(w, meet).select("airport_code", "observed_at", F.inline("places"))
    near = (F.col("observed_at") >= F.col("position_time") - F.expr("INTERVAL 1 HOUR")) & (
        F.col("observed_at") <= F.col("position_time")
    )
    return met.filter(near).select(*departures.columns, "observed_at")


def positions_with_weather(positions: DataFrame, flights: DataFrame, weather: DataFrame) -> DataFrame:
    """Positions of a stream with each weather instant of the last hour at their flight's airport.

    That is the origin for the first half of the scheduled flight time, its middle included, and the
    destination after it. Flights are a static table; a position without a known flight has no airport and is left out.
    """
    legs = flights.select("flight_id", "origin_airport", "dest_airport", "scheduled_dep_time", "scheduled_arr_time")
    tied = lookup_join(positions, legs, ["flight_id"], "inner", counted=flights)
    twice_middle = F.unix_micros("scheduled_dep_time") + F.unix_micros("scheduled_arr_time")
    first_half = F.unix_micros("position_time") * 2 <= twice_middle
    placed = tied.select(
        "position_id",
        "flight_id",
        F.when(first_half, F.col("origin_airport")).otherwise(F.col("dest_airport")).alias("airport_code"),
        "position_time",
    )
    return departures_with_weather(placed.filter("airport_code IS NOT NULL"), weather)


def _each_batch(stream: DataFrame, work, checkpoint: str, trigger: dict[str, object] | None):
    """Run ``work`` on every batch; without a trigger, on what the sources hold now."""
    query = (
        stream.writeStream.foreachBatch(work)
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"availableNow": True}))
        .start()
    )
    if not trigger:
        query.awaitTermination()
    return query


def keep_latest(
    positions: DataFrame,
    key: str = "icao24",
    time: str = "position_time",
    tie: str = "position_id",
    target: str | None = None,
    checkpoint: str | None = None,
    trigger: dict[str, object] | None = None,
    buckets: int = BUCKETS,
) -> DataFrame:
    """Current state per aircraft, merged batch by batch into a keyed table.

    A batch rewrites only buckets of its own keys, and a repeated batch changes nothing. Started
    again with the same ``target`` and ``checkpoint`` the job goes on where it stopped.
    """
    spark = positions.sparkSession
    root = target or scratch_path(spark, "latest")
    table = KeyedTable(spark, root, key, time, tie, buckets)
    _each_batch(positions, table.merge, checkpoint or root.rstrip("/") + "-checkpoint", trigger)
    state = table.read(positions.columns)
    return spark.createDataFrame([], positions.schema) if state is None else state


def late_report(
    positions: DataFrame,
    time: str = "position_time",
    delay: str = WATERMARK,
    target: str | None = None,
    checkpoint: str | None = None,
    trigger: dict[str, object] | None = None,
) -> DataFrame:
    """Rows per batch that arrive behind the watermark of the batches before.

    Returns (batch, rows, late, max_time). Each batch leaves one row; a repeated
    batch writes the same row again, and a job started again on the same folders goes on.
    """
    spark = positions.sparkSession
    root = target or scratch_path(spark, "late")

    def count(rows: DataFrame, batch: int) -> None:
        seen = None
        if batch > 0:
            seen = spark.read.parquet(f"{root}/batch={batch - 1}").select("max_time").scalar()
        reached = F.lit(None).cast("timestamp") if seen is None else seen
        late = F.col(time) < reached - F.expr(f"INTERVAL {delay}")
        counted = rows.agg(
            F.count(F.lit(1)).alias("rows"), F.count_if(late).alias("late"), F.max(time).alias("_max")
        )
        counted.select("rows", "late", F.greatest("_max", reached).alias("max_time")).coalesce(1).write.mode(
            "overwrite"
        ).parquet(f"{root}/batch={batch}")

    _each_batch(positions, count, checkpoint or root.rstrip("/") + "-checkpoint", trigger)
    return spark.read.parquet(root)
