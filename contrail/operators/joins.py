"""Enrichment joins along the foreign keys, and the time-based ones."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from contrail.operators.spread import best_interval, last_known, lookup_join


def _prefixed(df: DataFrame, key: str, as_key: str, prefix: str, columns: list[str]) -> DataFrame:
    return df.select(F.col(key).alias(as_key), *[F.col(c).alias(prefix + c) for c in columns])


def enrich_flights(flights: DataFrame, airlines: DataFrame, airports: DataFrame) -> DataFrame:
    """Flights with carrier, origin and destination; a missing key keeps the flight."""
    carrier = _prefixed(airlines, "carrier_code", "carrier_code", "", ["carrier_name"])
    columns = ["airport_name", "country", "latitude", "longitude"]
    origin = _prefixed(airports, "airport_code", "origin_airport", "origin_", columns)
    dest = _prefixed(airports, "airport_code", "dest_airport", "dest_", columns)
    joined = lookup_join(flights, carrier, ["carrier_code"], counted=airlines)
    joined = lookup_join(joined, origin, ["origin_airport"], counted=airports)
    return lookup_join(joined, dest, ["dest_airport"], counted=airports)


def enrich_weather(weather: DataFrame, airports: DataFrame) -> DataFrame:
    """Observations with their airport and its local wall-clock time."""
    place = airports.select("airport_code", "airport_name", "timezone")
    return lookup_join(weather, place, ["airport_code"], counted=airports).withColumn(
        "observed_local", F.from_utc_timestamp("observed_at", F.col("timezone"))
    )


def delay_minutes(scheduled: str, actual: str) -> Column:
    """Whole minutes, rounded down; early is negative, unknown stays null."""
    return F.floor((F.unix_micros(actual) - F.unix_micros(scheduled)) / F.lit(60_000_000)).cast("int")


def with_delays(flights: DataFrame) -> DataFrame:
    return flights.withColumn("dep_delay_min", delay_minutes("scheduled_dep_time", "actual_dep_time")).withColumn(
        "arr_delay_min", delay_minutes("scheduled_arr_time", "actual_arr_time")
    )


def with_local_flight_date(flights: DataFrame, airports: DataFrame) -> DataFrame:
    """``flight_date`` as the local day of the scheduled departure at the origin."""
    zones = airports.select(F.col("airport_code").alias("origin_airport"), "timezone")
    local = F.from_utc_timestamp("scheduled_dep_time", F.coalesce("timezone", F.lit("UTC")))
    joined = lookup_join(flights, zones, ["origin_airport"], counted=airports)
    return joined.withColumn("flight_date", F.to_date(local)).drop("timezone")


def attach_flights(positions: DataFrame, flights: DataFrame) -> DataFrame:
    """Fill the flight of each position from the flight times of its aircraft.

    A position belongs to the flight in the air at its time, actual times before
    scheduled ones; of several, the one that departed last, then the highest id.
    """
    times = flights.select(
        "icao24",
        "flight_id",
        F.coalesce("actual_dep_time", "scheduled_dep_time").alias("dep"),
        F.coalesce("actual_arr_time", "scheduled_arr_time").alias("arr"),
    )
    return best_interval(positions.drop("flight_id"), times, "icao24", "position_time", "dep", "arr", "flight_id")


def weather_before(
    flights: DataFrame, weather: DataFrame, columns: list[str], time: str = "scheduled_dep_time"
) -> DataFrame:
    """Flights with the last observation at the origin at or before ``time``."""
    seen = weather.select(
        F.col("airport_code").alias("origin_airport"),
        "observed_at",
        "obs_id",
        F.struct("observed_at", *columns).alias("wx"),
    )
    found = last_known(flights, seen, "origin_airport", time, "observed_at", "wx", "obs_id")
    joined = lookup_join(flights, found, ["origin_airport", time], small_rows=0)
    return joined.select(
        *flights.columns, F.col("wx.observed_at").alias("observed_at"), *[F.col(f"wx.{c}").alias(c) for c in columns]
    )


def enrich_anomalies(anomalies: DataFrame, flights: DataFrame, positions: DataFrame) -> DataFrame:
    """Anomalies with flight and position; both keys may be null."""
    f = flights.select(
        "flight_id", "carrier_code", "origin_airport", "dest_airport", "scheduled_dep_time"
    )
    p = positions.select("position_id", "on_ground", "true_track", "vertical_rate", "squawk")
    return lookup_join(lookup_join(anomalies, f, ["flight_id"], small_rows=0), p, ["position_id"], small_rows=0)
