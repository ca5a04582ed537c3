"""The four anomaly rules and the anomaly table.

Rule limits are given in feet, knots and kilometres and compared in exact
integer or decimal arithmetic on metres and metres per second.
"""

from __future__ import annotations

import math
from decimal import Decimal
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F, Window as W

from contrail.functions.geo import EARTH_KM, arc_km, leg, off_route_km, unit_vector
from contrail.operators.spread import lookup_join, with_halo
from contrail.operators.upkeep import first_per_key
from contrail.schemas import ANOMALIES, SEVERITIES
from contrail.session import written

# fixed values: the declared limits
ALTITUDE_M = Decimal("152.40")  # 500 ft
ALTITUDE_WINDOW_S = 30
KNOTS_100_M_PER_H = 185_200  # 100 kt in metres per hour
VELOCITY_WINDOW_S = 60
ROUTE_KM = 10.0

# our rulings where no limit is declared
LOW_ALTITUDE_M = Decimal("300.00")
LOW_AIRPORT_KM = 10.0

WINDOW_BUCKET_S = 3600


def distinct_samples(positions: DataFrame) -> DataFrame:
    """One sample per aircraft and instant: the lowest position id of repeated polls."""
    return first_per_key(positions, ["icao24", "position_time"], ["position_id"])


def _change(column: str, seconds: int) -> tuple[Column, Column]:
    """Rise over the lowest and fall from the highest value of the trailing window."""
    frame = (
        W.partitionBy("icao24", "bucket")
        .orderBy(F.unix_micros("position_time"))
        .rangeBetween(-seconds * 1_000_000, W.currentRow)
    )
    value = F.col(column)
    return value - F.min(column).over(frame), value - F.max(column).over(frame)


def sample_changes(
    positions: DataFrame,
    altitude_s: int = ALTITUDE_WINDOW_S,
    velocity_s: int = VELOCITY_WINDOW_S,
    bucket_s: int = WINDOW_BUCKET_S,
) -> DataFrame:
    """Trailing altitude and speed changes of every sample, both rules from one exchange.

    The series is cut into (aircraft, time bucket) groups with a halo, so no task
    holds an aircraft's whole history.
    """
    samples = with_halo(distinct_samples(positions), "position_time", bucket_s, max(altitude_s, velocity_s))
    alt_up, alt_dn = _change("baro_altitude", altitude_s)
    vel_up, vel_dn = _change("velocity", velocity_s)
    changes = {"alt_up": alt_up, "alt_dn": alt_dn, "vel_up": vel_up, "vel_dn": vel_dn}
    return (
        samples.select("*", *[change.alias(name) for name, change in changes.items()])
        .filter("NOT is_context")
        .drop("bucket", "is_context")
    )


def is_altitude_spike(limit: Decimal = ALTITUDE_M) -> Column:
    return (F.col("alt_up") >= F.lit(limit)) | (F.col("alt_dn") <= F.lit(-limit))


def is_velocity_spike(metres_per_hour: int = KNOTS_100_M_PER_H) -> Column:
    return (F.col("vel_up") * 3600 >= metres_per_hour) | (F.col("vel_dn") * 3600 <= -metres_per_hour)


def altitude_spikes(changes: DataFrame) -> DataFrame:
    hits = changes.filter(is_altitude_spike())
    return hits.withColumn("d_up", F.col("alt_up")).withColumn("d_dn", F.col("alt_dn"))


def velocity_spikes(changes: DataFrame) -> DataFrame:
    hits = changes.filter(is_velocity_spike())
    return hits.withColumn("d_up", F.col("vel_up")).withColumn("d_dn", F.col("vel_dn"))


def route_deviations(positions: DataFrame, flights: DataFrame, airports: DataFrame, limit_km: float = ROUTE_KM) -> DataFrame:
    """Positions of a known flight at least ``limit_km`` off its great-circle route."""
    place = unit_vector(F.col("latitude"), F.col("longitude"))
    origin = airports.select(F.col("airport_code").alias("origin_airport"), place.alias("_o"))
    dest = airports.select(F.col("airport_code").alias("dest_airport"), place.alias("_d"))
    routes = flights.select("flight_id", "origin_airport", "dest_airport")
    routes = lookup_join(routes, origin, ["origin_airport"], "inner", counted=airports)
    routes = lookup_join(routes, dest, ["dest_airport"], "inner", counted=airports)
    # everything that depends on the route alone is worked out before the big join
    routes = routes.withColumn("_leg", leg(F.col("_o"), F.col("_d"))).drop("_o", "_d")
    placed = positions.filter("flight_id IS NOT NULL").withColumn("_p", place)
    tied = lookup_join(placed, routes, ["flight_id"], "inner", small_rows=0)
    away = F.round(off_route_km(F.col("_p"), F.col("_leg")), 2)
    return tied.withColumn("off_route_km", away).filter(F.col("off_route_km") >= limit_km).drop("_p", "_leg")


GRID = (20, 4, 1)  # degrees of the cells, each a multiple of the next


def _cells(latitude: Column, longitude: Column, size: int) -> tuple[Column, Column]:
    """Numbers of the cell, eastward and northward; longitudes wrap, the pole belongs to the last row."""
    x = F.pmod(F.floor((longitude.cast("double") + 180) / size), F.lit(360 // size))
    y = F.least(F.floor((latitude.cast("double") + 90) / size), F.lit(180 // size - 1))
    return x.cast("int"), F.greatest(y, F.lit(0)).cast("int")


def _closest_per_cell(candidates: DataFrame, size: int) -> DataFrame:
    """Keeps, per cell, the airports that may be nearest to some point of the cell.

    What is nearest to any point of a cell is at most two cell radii farther from its
    middle than the airport nearest to the middle.
    """
    middle = unit_vector((F.col("_y") + 0.5) * size - 90, (F.col("_x") + 0.5) * size - 180)
    radius = EARTH_KM * math.radians(size * 0.7072)  # from the middle to a corner, at most
    away = candidates.withColumn("_km", arc_km(F.col("v"), middle))
    closest = F.min("_km").over(W.partitionBy("_x", "_y"))
    return away.withColumn("_least", closest).filter(F.col("_km") <= F.col("_least") + 2 * radius + 0.01).drop(
        "_km", "_least"
    )


def airport_candidates(airports: DataFrame, cells: DataFrame) -> DataFrame:
    """(_x, _y, code, v): for each wanted cell of the finest grid the airports that may be nearest in it.

    ``cells`` holds distinct (_x, _y). Cells are refined level by level, every level
    starting from what the coarser one left.
    """
    coarse, finest = GRID[0], GRID[-1]
    lat, lon = F.col("latitude"), F.col("longitude")
    placed = airports.filter("latitude IS NOT NULL AND longitude IS NOT NULL").select(
        F.col("airport_code").alias("code"), unit_vector(lat, lon).alias("v")
    )
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    # a fixed number of coarse cells per airport
    found = placed.withColumn("_x", every(360 // coarse)).withColumn("_y", every(180 // coarse))
    parent = coarse
    for size in GRID:
        if size != parent:
            step = parent // size
            found = found.withColumn("_i", every(step)).withColumn("_j", every(step))
            found = found.withColumn("_x", F.col("_x") * step + F.col("_i"))
            found = found.withColumn("_y", F.col("_y") * step + F.col("_j")).drop("_i", "_j")
        ratio = size // finest
        wanted = cells.select(
            F.floor(F.col("_x") / ratio).cast("int").alias("_x"), F.floor(F.col("_y") / ratio).cast("int").alias("_y")
        ).distinct()
        # at most one row per cell of the sphere
        found = _closest_per_cell(found.join(F.broadcast(wanted), ["_x", "_y"], "left_semi"), size)
        parent = size
    return found


def nearest_airport(positions: DataFrame, airports: DataFrame) -> DataFrame:
    """Adds the nearest airport and its distance to every position that has a place.

    Each one-degree cell that holds a position carries the airports that may be nearest
    inside it, so a position meets all it has to compare by one equi-join on its
    cell and stays one row. The answer is exact; ties go to the lower code.
    """
    lat, lon = F.col("latitude"), F.col("longitude")
    finest = GRID[-1]
    has_place = lat.isNotNull() & lon.isNotNull()
    x, y = _cells(lat, lon, finest)
    keyed = positions.withColumn("_x", F.when(has_place, x)).withColumn("_y", F.when(has_place, y))
    # both small and read several times: at most a row per cell, and the airports of these cells
    cells = written(keyed.filter(has_place).select("_x", "_y").distinct(), "cells")
    candidates = written(airport_candidates(airports, cells), "cell-airports")
    lists = candidates.groupBy("_x", "_y").agg(F.collect_set(F.struct("code", "v")).alias("_near"))
    met = lookup_join(keyed, lists, ["_x", "_y"], counted=candidates)
    place = unit_vector(lat, lon)

    def distance_and_code(a: Column) -> Column:
        return F.struct(F.round(arc_km(a["v"], F.col("_v")), 3).alias("km"), a["code"].alias("code"))

    best = met.withColumn("_v", place).withColumn("_best", F.array_min(F.transform("_near", distance_and_code)))
    named = best.withColumn("nearest_code", F.col("_best.code")).withColumn("nearest_km", F.col("_best.km"))
    return named.drop("_best", "_v", "_x", "_y", "_near")


def ground_proximity(
    positions: DataFrame,
    airports: DataFrame,
    below_m: Decimal = LOW_ALTITUDE_M,
    beyond_km: float = LOW_AIRPORT_KM,
) -> DataFrame:
    """Low and airborne, away from any airport."""
    low = positions.filter((F.col("baro_altitude") < F.lit(below_m)) & ~F.col("on_ground"))
    return nearest_airport(low, airports).filter(F.col("nearest_km") > beyond_km)


def severity(measured: Column, limit: Column) -> Column:
    """By how many times the limit is reached."""
    return (
        F.when(measured < limit * F.lit(Decimal("1.5")), "LOW")
        .when(measured < limit * 2, "MEDIUM")
        .when(measured < limit * 3, "HIGH")
        .otherwise("CRITICAL")
    )


def severity_rank(column: str = "severity") -> Column:
    return F.array_position(F.array(*[F.lit(s) for s in SEVERITIES]), F.col(column)).cast("int")


def anomaly_rows(
    positions: DataFrame, on_route: DataFrame, flights: DataFrame, airports: DataFrame
) -> DataFrame:
    """All rule hits in the shape of the anomaly table, ids still missing.

    Detection time is the time of the hit. Status columns get their defaults, the
    two generated texts stay null.
    """
    changes = sample_changes(positions)
    text = lambda c: F.coalesce(c.cast("string"), F.lit("?"))
    place = F.concat(F.lit(" at "), text(F.col("latitude")), F.lit(", "), text(F.col("longitude")))

    # both spike rules from one pass: a sample gives one row per rule it breaks
    climb, speed = (F.greatest(F.col(f"{c}_up"), -F.col(f"{c}_dn")) for c in ("alt", "vel"))
    spikes = changes.select(
        "*",
        F.explode(
            F.array_compact(
                F.array(
                    F.when(
                        is_altitude_spike(),
                        F.struct(
                            F.lit("altitude_spike").alias("event_type"),
                            severity(climb, F.lit(ALTITUDE_M)).alias("severity"),
                            F.concat(F.lit("altitude change "), text(climb), F.lit(" m in 30 s"), place).alias(
                                "description"
                            ),
                        ),
                    ),
                    F.when(
                        is_velocity_spike(),
                        F.struct(
                            F.lit("velocity_spike").alias("event_type"),
                            severity(speed * 3600, F.lit(Decimal(KNOTS_100_M_PER_H))).alias("severity"),
                            F.concat(F.lit("speed change "), text(speed), F.lit(" m/s in 60 s"), place).alias(
                                "description"
                            ),
                        ),
                    ),
                )
            )
        ).alias("hit"),
    ).select("*", "hit.*")
    off = route_deviations(on_route, flights, airports).withColumn(
        "km", F.col("off_route_km").cast("decimal(12,2)")
    )
    route = off.select(
        "*",
        F.lit("route_deviation").alias("event_type"),
        severity(F.col("km"), F.lit(Decimal("10"))).alias("severity"),
        F.concat(F.lit("off route by "), text(F.col("km")), F.lit(" km"), place).alias("description"),
    )
    # 300 / altitude against 1.5, 2 and 3, without a division
    height = F.col("baro_altitude")
    low = ground_proximity(positions, airports).select(
        "*",
        F.lit("ground_proximity").alias("event_type"),
        F.when(height <= 0, "CRITICAL")
        .when(height > 200, "LOW")
        .when(height > 150, "MEDIUM")
        .when(height > 100, "HIGH")
        .otherwise("CRITICAL")
        .alias("severity"),
        F.concat(F.lit("low flight at "), text(height), F.lit(" m"), place).alias("description"),
    )
    shaped = [
        df.select(
            "icao24",
            "flight_id",
            "position_id",
            F.col("position_time").alias("detected_at"),
            "event_type",
            "severity",
            "latitude",
            "longitude",
            F.col("baro_altitude").alias("altitude_m"),
            F.col("velocity").alias("velocity_ms"),
            "description",
            F.lit(None).cast("string").alias("llm_explanation"),
            F.lit(None).cast("string").alias("response_procedure"),
            F.lit(False).alias("is_resolved"),
            F.lit(None).cast("timestamp").alias("resolved_at"),
            F.col("position_time").alias("created_at"),
        )
        for df in (spikes, route, low)
    ]
    return reduce(DataFrame.unionByName, shaped)


def with_event_key(rows: DataFrame) -> DataFrame:
    """Adds ``event_id`` without a shuffle: position id and rule make a unique number."""
    rule = F.array_position(F.array(*[F.lit(e) for e in ANOMALIES.enums["event_type"]]), F.col("event_type"))
    return rows.withColumn("event_id", F.col("position_id") * 4 + rule - 1)
