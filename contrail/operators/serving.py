"""Current state, windowed metrics, map cells, delay figures and the anomaly queue."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from contrail.functions import hexgrid
from contrail.operators.cep import severity_rank

LATE_MIN = 15
CELL_DEGREES = "0.25"
HEX_LEVEL = 4


def latest(df: DataFrame, key: str, time: str, tie: str) -> DataFrame:
    """The newest row per key; candidates shrink to one per key before the shuffle."""
    rest = [c for c in df.columns if c != key]
    newest = df.groupBy(key).agg(F.max_by(F.struct(*rest), F.struct(time, tie)).alias("_row"))
    return newest.select(key, "_row.*").select(df.columns)


def window_metrics(positions: DataFrame, length: str = "5 minutes", slide: str | None = None) -> DataFrame:
    """Per window and aircraft: samples, speed and altitude figures. Windows are [start, end) in UTC."""
    span = F.window("position_time", length, slide) if slide else F.window("position_time", length)
    return (
        positions.groupBy(span.alias("w"), "icao24")
        .agg(
            F.count(F.lit(1)).alias("samples"),
            F.sum("velocity").alias("sum_velocity"),
            F.count("velocity").alias("n_velocity"),
            F.max("velocity").alias("max_velocity"),
            F.min("baro_altitude").alias("min_altitude"),
            F.max("baro_altitude").alias("max_altitude"),
        )
        .select(
            F.col("w.start").alias("window_start"),
            F.col("w.end").alias("window_end"),
            "icao24",
            "samples",
            F.try_divide(F.col("sum_velocity").cast("double"), F.col("n_velocity")).alias("mean_velocity"),
            "max_velocity",
            "min_altitude",
            "max_altitude",
        )
    )


def cell(column: str, degrees: str = CELL_DEGREES) -> Column:
    return F.floor(F.col(column) / F.lit(degrees).cast("decimal(9,6)")).cast("bigint")


def cell_counts(positions: DataFrame, degrees: str = CELL_DEGREES, length: str = "5 minutes") -> DataFrame:
    """Positions per square latitude/longitude cell and time window."""
    placed = positions.filter("latitude IS NOT NULL AND longitude IS NOT NULL")
    return (
        placed.groupBy(
            F.window("position_time", length).alias("w"),
            cell("latitude", degrees).alias("cell_lat"),
            cell("longitude", degrees).alias("cell_lon"),
        )
        .agg(F.count(F.lit(1)).alias("samples"), F.min("baro_altitude").alias("min_altitude"))
        .select(F.col("w.start").alias("window_start"), "cell_lat", "cell_lon", "samples", "min_altitude")
    )


def hex_counts(positions: DataFrame, level: int = HEX_LEVEL, length: str = "5 minutes") -> DataFrame:
    """Positions per hexagon and time window, with the hexagon's parent."""
    placed = positions.filter("latitude IS NOT NULL AND longitude IS NOT NULL")
    cell = hexgrid.hex_cell(F.col("latitude"), F.col("longitude"), level)
    counted = placed.groupBy(F.window("position_time", length).alias("w"), cell.alias("cell")).agg(
        F.count(F.lit(1)).alias("samples"), F.min("baro_altitude").alias("min_altitude")
    )
    parent = hexgrid.parent_of(F.col("cell"), level).alias("parent")
    return counted.select(F.col("w.start").alias("window_start"), "cell", parent, "samples", "min_altitude")


def hex_roll_up(counts: DataFrame, level: int) -> DataFrame:
    """Counts of a level as counts of the level above, without the positions."""
    rolled = counts.groupBy("window_start", F.col("parent").alias("cell")).agg(
        F.sum("samples").alias("samples"), F.min("min_altitude").alias("min_altitude")
    )
    parent = hexgrid.parent_of(F.col("cell"), level - 1).alias("parent")
    return rolled.select("window_start", "cell", parent, "samples", "min_altitude")


def delay_stats(delays: DataFrame, by: list[str], late_min: int = LATE_MIN, exact: bool = True) -> DataFrame:
    """Departure delay figures per group, over flights whose delay is known.

    The exact percentiles keep one counter per distinct whole minute. ``exact``
    off uses sketches instead.
    """
    quantile = F.percentile if exact else F.percentile_approx
    known = delays.filter("dep_delay_min IS NOT NULL")
    return known.groupBy(*by).agg(
        F.count(F.lit(1)).alias("flights"),
        F.round(F.sum("dep_delay_min").cast("double") / F.count(F.lit(1)), 6).alias("mean_delay"),
        F.round(quantile("dep_delay_min", F.lit(0.5)), 6).alias("median_delay"),
        F.round(quantile("dep_delay_min", F.lit(0.9)), 6).alias("p90_delay"),
        F.round(
            F.count_if(F.col("dep_delay_min") >= late_min).cast("double") / F.count(F.lit(1)), 6
        ).alias("late_share"),
    )


def anomaly_counts(anomalies: DataFrame) -> DataFrame:
    """Counts by type and severity with subtotals; totals carry ``ALL``."""
    rolled = anomalies.rollup("event_type", "severity").agg(
        F.count(F.lit(1)).alias("events"), F.grouping_id().alias("level")
    )
    return rolled.select(
        F.when(F.col("level") >= 3, "ALL").otherwise(F.col("event_type")).alias("event_type"),
        F.when(F.col("level") >= 1, "ALL").otherwise(F.col("severity")).alias("severity"),
        "events",
    )


def resolution_time(anomalies: DataFrame) -> DataFrame:
    """Per severity: resolved and open events and the minutes to resolution."""
    minutes = F.floor(
        (F.unix_micros("resolved_at") - F.unix_micros("detected_at")) / F.lit(60_000_000)
    ).cast("bigint")
    return anomalies.withColumn("_m", minutes).groupBy("severity").agg(
        F.count("_m").alias("resolved"),
        F.count_if(~F.col("is_resolved")).alias("open"),
        F.round(F.try_divide(F.sum("_m").cast("double"), F.count("_m")), 6).alias("mean_minutes"),
        F.max("_m").alias("max_minutes"),
    )


def open_queue(anomalies: DataFrame, limit: int | None = None) -> DataFrame:
    """Unresolved events, most severe first, then newest."""
    order = [severity_rank().desc(), F.col("detected_at").desc(), F.col("event_id").desc()]
    queue = anomalies.filter(~F.col("is_resolved")).withColumn("severity_rank", severity_rank()).orderBy(*order)
    return queue if limit is None else queue.limit(limit)


def most_severe(anomalies: DataFrame, k: int = 20) -> DataFrame:
    """The k most severe events by enum rank, newest first within a rank."""
    order = [severity_rank().desc(), F.col("detected_at").desc(), F.col("event_id").desc()]
    return anomalies.withColumn("severity_rank", severity_rank()).orderBy(*order).limit(k)


def find_flights(
    flights: DataFrame,
    icao24: str | None = None,
    callsign: str | None = None,
    flight_date: str | None = None,
    origin: str | None = None,
    dest: str | None = None,
) -> DataFrame:
    """Flights by any of the indexed columns."""
    wanted = {
        "icao24": icao24,
        "callsign": callsign,
        "flight_date": flight_date,
        "origin_airport": origin,
        "dest_airport": dest,
    }
    for column, value in wanted.items():
        if value is not None:
            typed = F.lit(value).cast("date") if column == "flight_date" else F.lit(value)
            flights = flights.filter(F.col(column) == typed)
    return flights
