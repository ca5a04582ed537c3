"""Domain tables derived from the given parquet tables.

Every function takes the raw frame, so the stateless ones serve batch and
streaming alike. Arithmetic is integer or decimal.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from contrail.operators.spread import lookup_join

EPOCH_2024 = 1_704_067_200_000_000
STATES_PER_SNAPSHOT = 25
FLIGHTS_PER_HISTORY = 4000


def padded(number: str, width: int) -> str:
    """A number as text of at least ``width`` digits; longer ones are not cut."""
    text = f"cast({number} AS string)"
    return f"lpad({text}, greatest({width}, length({text})), '0')"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def airports(nation: DataFrame, region: DataFrame) -> DataFrame:
    return nation.join(region, nation.n_regionkey == region.r_regionkey).selectExpr(
        f"concat('A', {padded('n_nationkey', 3)}) AS airport_code",
        "n_name AS airport_name",
        "concat('City ', n_name) AS city",
        "r_name AS country",
        "cast(33.0 + (n_nationkey * 7 % 60) / 10.0 AS decimal(9,6)) AS latitude",
        "cast(124.0 + (n_nationkey * 11 % 61) / 10.0 AS decimal(9,6)) AS longitude",
        "element_at(array('Asia/Seoul', 'Asia/Tokyo', 'Asia/Shanghai'), n_nationkey % 3 + 1) AS timezone",
    )


def airlines(supplier: DataFrame, nation: DataFrame) -> DataFrame:
    """Every supplier is a carrier; its code has three digits or more."""
    placed = supplier.join(nation, supplier.s_nationkey == nation.n_nationkey)
    return placed.selectExpr(f"{padded('s_suppkey', 3)} AS carrier_code", "s_name AS carrier_name", "n_name AS country")


def positions(events: DataFrame) -> DataFrame:
    return events.selectExpr(
        "event_id AS position_id",
        f"{padded('user_id', 6)} AS icao24",
        """CASE event_id % 10 WHEN 0 THEN NULL WHEN 1 THEN '' WHEN 2 THEN '        '
                WHEN 3 THEN concat('LONGCALL', lpad(cast(user_id % 100 AS string), 2, '0'))
                ELSE rpad(concat('KAL', user_id), greatest(8, 3 + length(user_id)), ' ') END AS callsign""",
        "event_id AS flight_id",
        f"""timestamp_micros({EPOCH_2024}L
              + (unix_micros(cast(ts AS timestamp)) - {EPOCH_2024}L) div 900) AS position_time""",
        "cast(32.0 + (event_id * 7919 % 8000) / 1000.0 AS decimal(9,6)) AS latitude",
        "cast(123.0 + (event_id * 104729 % 8000) / 1000.0 AS decimal(9,6)) AS longitude",
        "cast(value * 2 AS decimal(8,2)) AS baro_altitude",
        "cast(cast(value * 2 AS decimal(8,2)) + 30 AS decimal(8,2)) AS geo_altitude",
        "cast(value AS decimal(7,2)) AS velocity",
        "cast(event_id * 37 % 360 AS decimal(6,2)) AS true_track",
        "cast((event_id * 13 % 41 - 20) / 2.0 AS decimal(7,2)) AS vertical_rate",
        "event_type = 'signup' AS on_ground",
        "lpad(cast(event_id % 10000 AS string), 4, '0') AS squawk",
    )


def polls(events: DataFrame) -> DataFrame:
    """Positions as polled: every third state comes back unchanged in the next poll."""
    seen = positions(events)
    again = seen.filter("position_id % 3 = 0").withColumn(
        "position_id", F.col("position_id") + F.lit(1_000_000_000_000)
    )
    return seen.unionByName(again)


def _flights(orders: DataFrame) -> DataFrame:
    minutes = "timestampadd(MINUTE, cast({} AS int), {})"
    seconds = minutes.replace("MINUTE", "SECOND")
    dep = minutes.format("o_orderkey * 37 % 1440", "cast(o_orderdate AS timestamp)")
    timed = orders.selectExpr(
        "o_orderkey AS k", "o_custkey AS c", "o_orderstatus AS status", f"{dep} AS dep"
    ).selectExpr("*", minutes.format("60 + k * 17 % 300", "dep") + " AS arr")
    return timed.selectExpr(
        "k AS flight_id",
        "concat('KAL', lpad(cast(k % 1000 AS string), 3, '0')) AS callsign",
        "lpad(cast(c % 150 AS string), 6, '0') AS icao24",
        "lpad(cast(k % 10 AS string), 3, '0') AS carrier_code",
        "concat('A', lpad(cast(k % 25 AS string), 3, '0')) AS origin_airport",
        "concat('A', lpad(cast((k * 7 + 1 + c) % 25 AS string), 3, '0')) AS dest_airport",
        "dep AS scheduled_dep_time",
        "arr AS scheduled_arr_time",
        "CASE WHEN k % 20 != 0 THEN " + seconds.format("(k * 53 % 181 - 30) * 60 + k % 60", "dep") + " END AS actual_dep_time",
        "CASE WHEN status != 'P' THEN " + seconds.format("(k * 59 % 181 - 30) * 60 + k * 7 % 60", "arr") + " END AS actual_arr_time",
        "cast((k * 31 % 300000) / 100.0 AS decimal(8,2)) AS distance_miles",
        "to_date(dep) AS flight_date",
        "status",
    )


def flights(orders: DataFrame) -> DataFrame:
    return _flights(orders).drop("status")


def gate_events(orders: DataFrame) -> DataFrame:
    """One gate event per finished leg, and a later correction for every fourth flight."""
    first = (
        _flights(orders)
        .selectExpr(
            "flight_id",
            "CASE status WHEN 'F' THEN dest_airport WHEN 'O' THEN origin_airport END AS airport_code",
            "CASE status WHEN 'F' THEN 'arrival' WHEN 'O' THEN 'departure' END AS gate_event",
            "CASE status WHEN 'F' THEN actual_arr_time WHEN 'O' THEN actual_dep_time END AS event_time",
        )
        .filter("gate_event IS NOT NULL AND event_time IS NOT NULL")
    )
    return first.selectExpr(
        "flight_id",
        "airport_code",
        "gate_event",
        """explode(CASE WHEN flight_id % 4 = 0
             THEN array(struct(event_time, event_time AS published_at),
                        struct(event_time + INTERVAL 7 MINUTES AS event_time,
                               event_time + INTERVAL 10 MINUTES AS published_at))
             ELSE array(struct(event_time, event_time AS published_at)) END) AS e""",
    ).select("flight_id", "airport_code", "gate_event", "e.event_time", "e.published_at")


def track(orders: DataFrame) -> DataFrame:
    """Ten positions around each flight, half an hour apart, not yet tied to a flight."""
    return flights(orders).selectExpr(
        "explode(sequence(0, 9)) AS n", "flight_id", "icao24", "scheduled_dep_time"
    ).selectExpr(
        "flight_id * 10 + n AS position_id",
        "icao24",
        "timestampadd(SECOND, cast(n * 1800 - 3600 + flight_id * 13 % 60 AS int), scheduled_dep_time) AS position_time",
    )


def tied_track(orders: DataFrame) -> DataFrame:
    """The same positions with their flight; every thirteenth does not know it."""
    return track(orders).withColumn("flight_id", F.expr("CASE WHEN position_id % 13 != 0 THEN position_id div 10 END"))


def route_positions(flights_: DataFrame, airports_: DataFrame) -> DataFrame:
    """One cruise position per flight, beside the midpoint of its route."""
    ends = airports_.select("airport_code", F.struct("latitude", "longitude").alias("p"))
    o = ends.select(F.col("airport_code").alias("origin_airport"), F.col("p").alias("o"))
    d = ends.select(F.col("airport_code").alias("dest_airport"), F.col("p").alias("d"))
    tied = lookup_join(flights_, o, ["origin_airport"], "inner", counted=airports_)
    tied = lookup_join(tied, d, ["dest_airport"], "inner", counted=airports_)
    return tied.selectExpr(
        "1000000000000 + flight_id AS position_id",
        "icao24",
        "callsign",
        "flight_id",
        "scheduled_dep_time + INTERVAL 30 MINUTES AS position_time",
        "cast((o.latitude + d.latitude) / 2 + (flight_id % 41 - 20) / 100.0 AS decimal(9,6)) AS latitude",
        "cast((o.longitude + d.longitude) / 2 AS decimal(9,6)) AS longitude",
        "cast(9000 AS decimal(8,2)) AS baro_altitude",
        "cast(9030 AS decimal(8,2)) AS geo_altitude",
        "cast(230 AS decimal(7,2)) AS velocity",
        "cast(90 AS decimal(6,2)) AS true_track",
        "cast(0 AS decimal(7,2)) AS vertical_rate",
        "false AS on_ground",
        "lpad(cast(flight_id % 10000 AS string), 4, '0') AS squawk",
    )


def weather_readings(lineitem: DataFrame) -> DataFrame:
    """One raw reading per row; airport, time and id may repeat."""
    return lineitem.selectExpr(
        "l_orderkey * 10 + l_linenumber AS obs_id",
        "concat('A', lpad(cast(l_suppkey % 25 AS string), 3, '0')) AS airport_code",
        "timestampadd(HOUR, cast(l_orderkey % 24 AS int), cast(l_shipdate AS timestamp)) AS observed_at",
        "cast(l_quantity AS decimal(5,1)) AS wind_speed_knots",
        "cast(l_partkey % 360 AS smallint) AS wind_direction_deg",
        "cast(l_tax * 100 AS decimal(5,2)) AS visibility_miles",
        "cast(l_partkey % 250 * 100 AS int) AS ceiling_ft",
        "cast(l_discount * 100 AS decimal(5,1)) AS temperature_c",
    )


def weather(lineitem: DataFrame) -> DataFrame:
    """One observation per airport and instant."""
    return (
        weather_readings(lineitem)
        .groupBy("airport_code", "observed_at")
        .agg(
            F.min("obs_id").alias("obs_id"),
            F.max("wind_speed_knots").alias("wind_speed_knots"),
            F.max("wind_direction_deg").alias("wind_direction_deg"),
            F.max("visibility_miles").alias("visibility_miles"),
            F.min("ceiling_ft").alias("ceiling_ft"),
            F.max("temperature_c").alias("temperature_c"),
        )
    )


def _json_text(column: str) -> Column:
    return F.coalesce(F.concat(F.lit('"'), F.col(column), F.lit('"')), F.lit("null"))


def snapshots(events: DataFrame) -> DataFrame:
    """Landed state snapshots: (snapshot_id, body), a fixed number of states each."""
    seconds = F.floor(F.unix_micros("position_time") / F.lit(1_000_000)).cast("long")
    p = positions(events).withColumn("seconds", seconds)
    number = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("null"))
    country = F.when(F.col("position_id") % 2 == 0, F.lit('"대한민국"')).otherwise(F.lit('"Japan"'))
    state = F.concat(
        F.lit("["),
        F.concat_ws(
            ",",
            _json_text("icao24"),
            _json_text("callsign"),
            country,
            F.when(F.col("position_id") % 50 == 7, "null").otherwise(number("seconds")),
            number("seconds"),
            number("longitude"),
            number("latitude"),
            number("baro_altitude"),
            number("on_ground"),
            number("velocity"),
            number("true_track"),
            number("vertical_rate"),
            F.when(F.col("position_id") % 4 == 0, "[1,2]").otherwise("null"),
            number("geo_altitude"),
            _json_text("squawk"),
            F.lit("false"),
            (F.col("position_id") % 4).cast("string"),
        ),
        F.lit("]"),
    )
    parts = p.select(
        F.floor(F.col("position_id") / F.lit(STATES_PER_SNAPSHOT)).cast("long").alias("snapshot_id"),
        "seconds",
        F.struct("position_id", state.alias("state")).alias("s"),
    )
    return (
        parts.groupBy("snapshot_id")
        .agg(F.max("seconds").alias("time"), F.sort_array(F.collect_list("s")).alias("s"))
        .select(
            "snapshot_id",
            F.concat(
                F.lit('{"time":'), F.col("time"), F.lit(',"states":['), F.concat_ws(",", "s.state"), F.lit("]}")
            ).alias("body"),
        )
    )


def histories(orders: DataFrame) -> DataFrame:
    """Landed flight histories: (icao24, batch, body), a bounded number of flights each."""
    f = flights(orders)
    epoch = lambda c: F.unix_seconds(c).cast("string")
    dep = F.when(F.col("flight_id") % 11 == 0, None).when(F.col("flight_id") % 13 == 0, "").otherwise(
        F.col("origin_airport")
    )
    item = F.to_json(
        F.struct(
            "icao24",
            F.unix_seconds("scheduled_dep_time").alias("firstSeen"),
            dep.alias("estDepartureAirport"),
            F.unix_seconds("scheduled_arr_time").alias("lastSeen"),
            F.when(F.col("flight_id") % 17 != 0, F.col("dest_airport")).alias("estArrivalAirport"),
            "callsign",
        )
    )
    return (
        f.select(
            "icao24",
            F.floor(F.col("flight_id") / F.lit(FLIGHTS_PER_HISTORY)).cast("long").alias("batch"),
            F.struct("flight_id", item.alias("item")).alias("h"),
        )
        .groupBy("icao24", "batch")
        .agg(F.sort_array(F.collect_list("h")).alias("h"))
        .select("icao24", "batch", F.concat(F.lit("["), F.concat_ws(",", "h.item"), F.lit("]")).alias("body"))
    )


def metar_reports(events: DataFrame) -> DataFrame:
    pad = lambda x, n: f"lpad(cast({x} AS string), {n}, '0')"
    return events.selectExpr(
        "event_id AS report_id",
        "concat('METAR A', "
        + pad("event_id % 25", 3)
        + ", ' 010000Z ', "
        + pad("event_id * 10 % 360", 3)
        + ", "
        + pad("event_id % 60", 2)
        + ", 'KT ', event_id % 10, 'SM SCT"
        + "020 BKN', "
        + pad("event_id * 7 % 250", 3)
        + ", ' OVC', "
        + pad("event_id * 3 % 200 + 30", 3)
        + ", ' ', "
        + pad("event_id % 35", 2)
        + ", '/', CASE WHEN event_id % 3 = 0 THEN 'M' ELSE '' END, "
        + pad("event_id % 20", 2)
        + ", ' A', "
        + pad("2900 + event_id % 150", 4)
        + ") AS raw_metar",
    )


def event_topics(spark: SparkSession) -> DataFrame:
    """The label whose mean vector asks for passages on an event type."""
    rows = [("altitude_spike", 0), ("velocity_spike", 1), ("route_deviation", 2), ("ground_proximity", 3)]
    return spark.createDataFrame(rows, "event_type string, query_id bigint")
