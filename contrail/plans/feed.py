"""The domain tables over one folder of parquet tables, built when asked for."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from contrail.operators import cep
from contrail.session import tune
from contrail.sources import adapters


class Feed:
    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = tune(spark), sf_dir

    def table(self, name: str) -> DataFrame:
        return adapters.table(self.spark, self.sf_dir, name)

    @cached_property
    def airports(self) -> DataFrame:
        return adapters.airports(self.table("nation"), self.table("region"))

    @cached_property
    def airlines(self) -> DataFrame:
        return adapters.airlines(self.table("supplier"), self.table("nation"))

    @cached_property
    def flights(self) -> DataFrame:
        return adapters.flights(self.table("orders"))

    @cached_property
    def positions(self) -> DataFrame:
        return adapters.positions(self.table("events"))

    @cached_property
    def polls(self) -> DataFrame:
        return adapters.polls(self.table("events"))

    @cached_property
    def route_positions(self) -> DataFrame:
        return adapters.route_positions(self.flights, self.airports)

    @cached_property
    def track(self) -> DataFrame:
        return adapters.track(self.table("orders"))

    @cached_property
    def readings(self) -> DataFrame:
        return adapters.weather_readings(self.table("lineitem"))

    @cached_property
    def weather(self) -> DataFrame:
        return adapters.weather(self.table("lineitem"))

    @cached_property
    def gate_events(self) -> DataFrame:
        return adapters.gate_events(self.table("orders"))

    @cached_property
    def snapshots(self) -> DataFrame:
        return adapters.snapshots(self.table("events"))

    @cached_property
    def histories(self) -> DataFrame:
        return adapters.histories(self.table("orders"))

    @cached_property
    def new_anomalies(self) -> DataFrame:
        rows = cep.anomaly_rows(self.positions, self.route_positions, self.flights, self.airports)
        return cep.with_event_key(rows)

    @cached_property
    def anomalies(self) -> DataFrame:
        """The anomaly table some time later: a third resolved, some without a flight."""
        resolved = F.col("event_id") % 3 == 0
        minutes = F.make_dt_interval(mins=(F.col("event_id") % 97).cast("int"))
        return (
            self.new_anomalies.withColumn("flight_id", F.when(F.col("event_id") % 7 != 0, F.col("flight_id")))
            .withColumn("is_resolved", resolved)
            .withColumn("resolved_at", F.when(resolved, F.col("detected_at") + minutes))
        )

    # raw, unchecked inputs of the quality rules

    @cached_property
    def raw_flights(self) -> DataFrame:
        return self.flights.selectExpr(
            "flight_id",
            "concat('KAL', flight_id * flight_id) AS callsign",
            "icao24",
            "cast(flight_id % 2000 AS string) AS carrier_code",
            "origin_airport",
            "concat('A', lpad(cast(flight_id % 26 AS string), 3, '0')) AS dest_airport",
            "CASE WHEN flight_id % 19 != 0 THEN flight_date END AS flight_date",
        )

    @cached_property
    def raw_positions(self) -> DataFrame:
        return self.positions.selectExpr(
            "position_id",
            "CASE WHEN position_id % 23 != 0 THEN icao24 END AS icao24",
            "callsign",
            "flight_id",
            "CASE WHEN position_id % 29 != 0 THEN position_time END AS position_time",
            "concat(squawk, CASE WHEN on_ground THEN '7' ELSE '' END) AS squawk",
        )

    @cached_property
    def raw_anomalies(self) -> DataFrame:
        return self.table("events").selectExpr(
            "event_id",
            "event_id * 2 AS flight_id",
            "event_id + 10 AS position_id",
            """CASE event_type WHEN 'click' THEN 'altitude_spike' WHEN 'view' THEN 'velocity_spike'
                 WHEN 'purchase' THEN 'route_deviation' WHEN 'signup' THEN 'ground_proximity'
                 ELSE event_type END AS event_type""",
            "element_at(array('LOW', 'MEDIUM', 'HIGH', 'CRITICAL', 'SEVERE'), cast(event_id % 5 + 1 AS int)) AS severity",
        )

    @cached_property
    def raw_weather_text(self) -> DataFrame:
        return self.table("lineitem").selectExpr(
            "cast(l_orderkey * 10 + l_linenumber AS string) AS obs_id",
            "concat('A', lpad(cast(l_suppkey % 25 AS string), 3, '0')) AS airport_code",
            "cast(l_partkey * 100 AS string) AS wind_direction_deg",
            "cast(cast(l_quantity * 25 AS int) AS string) AS visibility_miles",
            "CASE WHEN l_linenumber = 3 THEN concat('M', l_linenumber) ELSE cast(l_linenumber AS string) END AS temperature_c",
        )


def present(df: DataFrame) -> DataFrame:
    """Plain result types: decimals as double, instants as UTC clock time, days as text."""
    columns = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, T.DecimalType):
            c = c.cast("double")
        elif isinstance(f.dataType, T.TimestampType):
            c = c.cast("timestamp_ntz")
        elif isinstance(f.dataType, T.DateType):
            c = c.cast("string")
        elif isinstance(f.dataType, (T.IntegerType, T.ShortType)):
            c = c.cast("bigint")
        columns.append(c.alias(f.name))
    return df.select(columns)
