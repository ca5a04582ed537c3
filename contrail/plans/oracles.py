"""The same results in plain SQL over the same tables, for checking.

``_VIEWS`` are the shared derived tables; ``_build`` puts those a query names in
front of it.
"""

from __future__ import annotations

import re

_RADIUS = "6371.0088"


def _haversine(lat1: str, lon1: str, lat2: str, lon2: str) -> str:
    a, b = f"radians({lat1}::DOUBLE)", f"radians({lat2}::DOUBLE)"
    c, d = f"radians({lon1}::DOUBLE)", f"radians({lon2}::DOUBLE)"
    h = f"pow(sin(({b} - {a}) / 2), 2) + cos({a}) * cos({b}) * pow(sin(({d} - {c}) / 2), 2)"
    return f"(2 * {_RADIUS} * asin(least(1.0, sqrt({h}))))"


def _bearing(lat1: str, lon1: str, lat2: str, lon2: str) -> str:
    a, b = f"radians({lat1}::DOUBLE)", f"radians({lat2}::DOUBLE)"
    t = f"(radians({lon2}::DOUBLE) - radians({lon1}::DOUBLE))"
    return f"atan2(sin({t}) * cos({b}), cos({a}) * sin({b}) - sin({a}) * cos({b}) * cos({t}))"


_HALO_WINDOW = "OVER (PARTITION BY icao24 ORDER BY position_time RANGE BETWEEN INTERVAL {} SECONDS PRECEDING AND CURRENT ROW)"
_ALT, _VEL = _HALO_WINDOW.format(30), _HALO_WINDOW.format(60)


def _severity(measured: str, limit: str) -> str:
    return (
        f"CASE WHEN {measured} < {limit} * 1.5 THEN 'LOW' WHEN {measured} < {limit} * 2 THEN 'MEDIUM'"
        f" WHEN {measured} < {limit} * 3 THEN 'HIGH' ELSE 'CRITICAL' END"
    )


_PLACE = "' at ' || latitude::VARCHAR || ', ' || longitude::VARCHAR"
_RANK = "list_position(['LOW', 'MEDIUM', 'HIGH', 'CRITICAL'], severity)::BIGINT"

_FLIGHT_TIMES = "o_orderdate + to_minutes(CAST(o_orderkey * 37 % 1440 AS INTEGER))"

_VIEWS = {
    "clean_turns": """
        SELECT conv_id, turn, role, array_to_string(list_filter(lines, lambda x, i: list_position(lines, x) = i), chr(10)) AS text
        FROM (SELECT conv_id, turn, role, list_filter(list_transform(string_split(text, chr(10)),
                  lambda line: array_to_string(list_filter(regexp_split_to_array(line, '[ \\t\\r]+'),
                      lambda w: w <> '' AND NOT list_contains(['um', 'uh', 'uhm', 'erm', 'hmm', 'um,', 'uh,', 'uhm,', 'erm,', 'hmm,'], lower(w))), ' ')),
                  lambda line: line <> '') AS lines FROM conversations)""",
    "airports": """
        SELECT 'A' || lpad(n_nationkey::VARCHAR, greatest(3, length(n_nationkey::VARCHAR))::INTEGER, '0') AS airport_code, n_name AS airport_name,
               'City ' || n_name AS city, r_name AS country,
               CAST(33.0 + (n_nationkey * 7 % 60) / 10.0 AS DECIMAL(9,6)) AS latitude,
               CAST(124.0 + (n_nationkey * 11 % 61) / 10.0 AS DECIMAL(9,6)) AS longitude,
               ['Asia/Seoul', 'Asia/Tokyo', 'Asia/Shanghai'][n_nationkey % 3 + 1] AS timezone
        FROM nation JOIN region ON n_regionkey = r_regionkey""",
    "airlines": """
        SELECT lpad(s_suppkey::VARCHAR, greatest(3, length(s_suppkey::VARCHAR))::INTEGER, '0') AS carrier_code,
               s_name AS carrier_name, n_name AS country
        FROM supplier JOIN nation ON s_nationkey = n_nationkey""",
    "positions": """
        SELECT event_id AS position_id,
               lpad(user_id::VARCHAR, greatest(6, length(user_id::VARCHAR))::INTEGER, '0') AS icao24,
               CASE event_id % 10 WHEN 0 THEN NULL WHEN 1 THEN '' WHEN 2 THEN '        '
                    WHEN 3 THEN 'LONGCALL' || lpad((user_id % 100)::VARCHAR, 2, '0')
                    ELSE rpad('KAL' || user_id::VARCHAR, greatest(8, 3 + length(user_id::VARCHAR))::INTEGER, ' ') END AS callsign,
               event_id AS flight_id,
               make_timestamp(1704067200000000 + (epoch_us(ts) - 1704067200000000) // 900) AS position_time,
               CAST(32.0 + (event_id * 7919 % 8000) / 1000.0 AS DECIMAL(9,6)) AS latitude,
               CAST(123.0 + (event_id * 104729 % 8000) / 1000.0 AS DECIMAL(9,6)) AS longitude,
               CAST(value * 2 AS DECIMAL(8,2)) AS baro_altitude,
               CAST(CAST(value * 2 AS DECIMAL(8,2)) + 30 AS DECIMAL(8,2)) AS geo_altitude,
               CAST(value AS DECIMAL(7,2)) AS velocity,
               CAST(event_id * 37 % 360 AS DECIMAL(6,2)) AS true_track,
               CAST((event_id * 13 % 41 - 20) / 2.0 AS DECIMAL(7,2)) AS vertical_rate,
               event_type = 'signup' AS on_ground,
               lpad((event_id % 10000)::VARCHAR, 4, '0') AS squawk
        FROM events""",
    "polls": """
        SELECT * FROM positions
        UNION ALL SELECT * REPLACE (position_id + 1000000000000 AS position_id) FROM positions WHERE position_id % 3 = 0""",
    "timed": f"""
        SELECT o_orderkey AS k, o_custkey AS c, o_orderstatus AS status, {_FLIGHT_TIMES} AS dep,
               {_FLIGHT_TIMES} + to_minutes(CAST(60 + o_orderkey * 17 % 300 AS INTEGER)) AS arr
        FROM orders""",
    "all_flights": """
        SELECT k AS flight_id, 'KAL' || lpad((k % 1000)::VARCHAR, 3, '0') AS callsign,
               lpad((c % 150)::VARCHAR, 6, '0') AS icao24, lpad((k % 10)::VARCHAR, 3, '0') AS carrier_code,
               'A' || lpad((k % 25)::VARCHAR, 3, '0') AS origin_airport,
               'A' || lpad(((k * 7 + 1 + c) % 25)::VARCHAR, 3, '0') AS dest_airport,
               dep AS scheduled_dep_time, arr AS scheduled_arr_time,
               CASE WHEN k % 20 != 0 THEN dep + to_seconds((k * 53 % 181 - 30) * 60 + k % 60) END AS actual_dep_time,
               CASE WHEN status != 'P' THEN arr + to_seconds((k * 59 % 181 - 30) * 60 + k * 7 % 60) END AS actual_arr_time,
               CAST((k * 31 % 300000) / 100.0 AS DECIMAL(8,2)) AS distance_miles,
               CAST(dep AS DATE) AS flight_date, status
        FROM timed""",
    "flights": "SELECT * EXCLUDE (status) FROM all_flights",
    "delays": """
        SELECT *, floor(date_diff('second', scheduled_dep_time, actual_dep_time) / 60)::BIGINT AS dep_delay_min,
               floor(date_diff('second', scheduled_arr_time, actual_arr_time) / 60)::BIGINT AS arr_delay_min
        FROM flights""",
    "first_gate_events": """
        SELECT * FROM (
            SELECT flight_id,
                   CASE status WHEN 'F' THEN dest_airport WHEN 'O' THEN origin_airport END AS airport_code,
                   CASE status WHEN 'F' THEN 'arrival' WHEN 'O' THEN 'departure' END AS gate_event,
                   CASE status WHEN 'F' THEN actual_arr_time WHEN 'O' THEN actual_dep_time END AS event_time
            FROM all_flights)
        WHERE gate_event IS NOT NULL AND event_time IS NOT NULL""",
    "gate_events": """
        SELECT *, event_time AS published_at FROM first_gate_events
        UNION ALL
        SELECT flight_id, airport_code, gate_event, event_time + INTERVAL 7 MINUTES, event_time + INTERVAL 10 MINUTES
        FROM first_gate_events WHERE flight_id % 4 = 0""",
    "track": """
        SELECT flight_id * 10 + n AS position_id, icao24,
               scheduled_dep_time + to_seconds(n * 1800 - 3600 + flight_id * 13 % 60) AS position_time
        FROM (SELECT unnest(range(0, 10)) AS n, flight_id, icao24, scheduled_dep_time FROM flights)""",
    "route_positions": """
        SELECT 1000000000000 + flight_id AS position_id, icao24, callsign, flight_id,
               scheduled_dep_time + INTERVAL 30 MINUTES AS position_time,
               CAST((o.latitude + d.latitude) / 2 + (flight_id % 41 - 20) / 100.0 AS DECIMAL(9,6)) AS latitude,
               CAST((o.longitude + d.longitude) / 2 AS DECIMAL(9,6)) AS longitude,
               CAST(9000 AS DECIMAL(8,2)) AS baro_altitude, CAST(9030 AS DECIMAL(8,2)) AS geo_altitude,
               CAST(230 AS DECIMAL(7,2)) AS velocity, CAST(90 AS DECIMAL(6,2)) AS true_track,
               CAST(0 AS DECIMAL(7,2)) AS vertical_rate, false AS on_ground,
               lpad((flight_id % 10000)::VARCHAR, 4, '0') AS squawk
        FROM flights JOIN airports o ON origin_airport = o.airport_code
                     JOIN airports d ON dest_airport = d.airport_code""",
    "readings": """
        SELECT l_orderkey * 10 + l_linenumber AS obs_id,
               'A' || lpad((l_suppkey % 25)::VARCHAR, 3, '0') AS airport_code,
               l_shipdate + to_hours(CAST(l_orderkey % 24 AS INTEGER)) AS observed_at,
               CAST(l_quantity AS DECIMAL(5,1)) AS wind_speed_knots,
               CAST(l_partkey % 360 AS SMALLINT) AS wind_direction_deg,
               CAST(l_tax * 100 AS DECIMAL(5,2)) AS visibility_miles,
               CAST(l_partkey % 250 * 100 AS INTEGER) AS ceiling_ft,
               CAST(l_discount * 100 AS DECIMAL(5,1)) AS temperature_c
        FROM lineitem""",
    "weather": """
        SELECT airport_code, observed_at, min(obs_id) AS obs_id, max(wind_speed_knots) AS wind_speed_knots,
               max(wind_direction_deg) AS wind_direction_deg, max(visibility_miles) AS visibility_miles,
               min(ceiling_ft) AS ceiling_ft, max(temperature_c) AS temperature_c
        FROM readings GROUP BY airport_code, observed_at""",
    "states": """
        SELECT position_id // 25 AS snapshot_id,
               max(epoch_us(position_time) // 1000000) OVER (PARTITION BY position_id // 25) AS time,
               row_number() OVER (PARTITION BY position_id // 25 ORDER BY position_id) - 1 AS pos,
               icao24, callsign, CASE WHEN position_id % 2 = 0 THEN '대한민국' ELSE 'Japan' END AS origin_country,
               CASE WHEN position_id % 50 != 7 THEN epoch_us(position_time) // 1000000 END AS time_position,
               epoch_us(position_time) // 1000000 AS last_contact, longitude, latitude, baro_altitude, on_ground,
               velocity, true_track, vertical_rate, CASE WHEN position_id % 4 = 0 THEN '[1,2]' END AS sensors,
               geo_altitude, squawk, false AS spi, position_id % 4 AS position_source
        FROM positions""",
    "history": """
        SELECT icao24, flight_id // 4000 AS batch,
               row_number() OVER (PARTITION BY icao24, flight_id // 4000 ORDER BY flight_id) - 1 AS pos,
               callsign, epoch_us(scheduled_dep_time) // 1000000 AS first_seen,
               epoch_us(scheduled_arr_time) // 1000000 AS last_seen,
               CASE WHEN flight_id % 11 = 0 THEN NULL WHEN flight_id % 13 = 0 THEN '' ELSE origin_airport END AS dep,
               CASE WHEN flight_id % 17 != 0 THEN dest_airport END AS arr
        FROM flights""",
    "samples": """
        SELECT * FROM positions
        QUALIFY row_number() OVER (PARTITION BY icao24, position_time ORDER BY position_id) = 1""",
    "changes": f"""
        SELECT *, baro_altitude - min(baro_altitude) {_ALT} AS alt_up, baro_altitude - max(baro_altitude) {_ALT} AS alt_dn,
               velocity - min(velocity) {_VEL} AS vel_up, velocity - max(velocity) {_VEL} AS vel_dn
        FROM samples""",
    "altitude_hits": "SELECT *, alt_up AS d_up, alt_dn AS d_dn FROM changes WHERE alt_up >= 152.40 OR alt_dn <= -152.40",
    "velocity_hits": """
        SELECT *, vel_up AS d_up, vel_dn AS d_dn FROM changes WHERE vel_up * 3600 >= 185200 OR vel_dn * 3600 <= -185200""",
    "legs": f"""
        SELECT p.*, f.origin_airport, f.dest_airport, o.latitude AS lat1, o.longitude AS lon1,
               d.latitude AS lat2, d.longitude AS lon2,
               {_haversine("o.latitude", "o.longitude", "p.latitude", "p.longitude")} AS to_start,
               {_haversine("d.latitude", "d.longitude", "p.latitude", "p.longitude")} AS to_end,
               {_haversine("o.latitude", "o.longitude", "d.latitude", "d.longitude")} AS leg,
               {_bearing("o.latitude", "o.longitude", "p.latitude", "p.longitude")}
                 - {_bearing("o.latitude", "o.longitude", "d.latitude", "d.longitude")} AS turn
        FROM route_positions p JOIN flights f ON p.flight_id = f.flight_id
        JOIN airports o ON f.origin_airport = o.airport_code JOIN airports d ON f.dest_airport = d.airport_code""",
    "legs_along": f"""
        SELECT *, {_RADIUS} * atan2(sin(to_start / {_RADIUS}) * cos(turn), cos(to_start / {_RADIUS})) AS along FROM legs""",
    "route_hits": f"""
        SELECT * FROM (
            SELECT *, round(CASE WHEN lat1 = lat2 AND lon1 = lon2 THEN to_start WHEN along < 0 THEN to_start
                                 WHEN along > leg THEN to_end
                                 ELSE abs(asin(sin(to_start / {_RADIUS}) * sin(turn))) * {_RADIUS} END, 2) AS off_route_km
            FROM legs_along)
        WHERE off_route_km >= 10""",
    "nearest": f"""
        SELECT p.*, a.airport_code AS nearest_code,
               round({_haversine("p.latitude", "p.longitude", "a.latitude", "a.longitude")}, 3) AS nearest_km
        FROM positions p, airports a
        QUALIFY row_number() OVER (PARTITION BY position_id ORDER BY nearest_km, nearest_code) = 1""",
    "low_hits": "SELECT * FROM nearest WHERE baro_altitude < 300 AND NOT on_ground AND nearest_km > 10",
    "hits": f"""
        SELECT icao24, flight_id, position_id, position_time, 'altitude_spike' AS event_type, 0 AS rule,
               {_severity("greatest(d_up, -d_dn)", "152.40")} AS severity, latitude, longitude, baro_altitude, velocity,
               'altitude change ' || greatest(d_up, -d_dn)::VARCHAR || ' m in 30 s' || {_PLACE} AS description
        FROM altitude_hits
        UNION ALL
        SELECT icao24, flight_id, position_id, position_time, 'velocity_spike', 1,
               {_severity("greatest(d_up, -d_dn) * 3600", "185200")}, latitude, longitude, baro_altitude, velocity,
               'speed change ' || greatest(d_up, -d_dn)::VARCHAR || ' m/s in 60 s' || {_PLACE}
        FROM velocity_hits
        UNION ALL
        SELECT icao24, flight_id, position_id, position_time, 'route_deviation', 2,
               {_severity("off_route_km::DECIMAL(12,2)", "10")}, latitude, longitude, baro_altitude, velocity,
               'off route by ' || off_route_km::DECIMAL(12,2)::VARCHAR || ' km' || {_PLACE}
        FROM route_hits
        UNION ALL
        SELECT icao24, flight_id, position_id, position_time, 'ground_proximity', 3,
               CASE WHEN baro_altitude <= 0 THEN 'CRITICAL' WHEN baro_altitude > 200 THEN 'LOW'
                    WHEN baro_altitude > 150 THEN 'MEDIUM' WHEN baro_altitude > 100 THEN 'HIGH' ELSE 'CRITICAL' END,
               latitude, longitude, baro_altitude, velocity,
               'low flight at ' || baro_altitude::VARCHAR || ' m' || {_PLACE}
        FROM low_hits""",
    "new_anomalies": """
        SELECT position_id * 4 + rule AS event_id, icao24, flight_id, position_id, position_time AS detected_at,
               event_type, severity, latitude, longitude, baro_altitude AS altitude_m, velocity AS velocity_ms,
               description
        FROM hits""",
    "anomalies": """
        SELECT * REPLACE (CASE WHEN event_id % 7 != 0 THEN flight_id END AS flight_id),
               event_id % 3 = 0 AS is_resolved,
               CASE WHEN event_id % 3 = 0 THEN detected_at + to_minutes(CAST(event_id % 97 AS INTEGER)) END AS resolved_at
        FROM new_anomalies""",
    "raw_flights": """
        SELECT flight_id, 'KAL' || (flight_id * flight_id)::VARCHAR AS callsign, icao24,
               (flight_id % 2000)::VARCHAR AS carrier_code, origin_airport,
               'A' || lpad((flight_id % 26)::VARCHAR, 3, '0') AS dest_airport,
               CASE WHEN flight_id % 19 != 0 THEN flight_date END AS flight_date
        FROM flights""",
    "raw_positions": """
        SELECT position_id, CASE WHEN position_id % 23 != 0 THEN icao24 END AS icao24, callsign, flight_id,
               CASE WHEN position_id % 29 != 0 THEN position_time END AS position_time,
               squawk || CASE WHEN on_ground THEN '7' ELSE '' END AS squawk
        FROM positions""",
    "raw_anomalies": """
        SELECT event_id, event_id * 2 AS flight_id, event_id + 10 AS position_id,
               CASE event_type WHEN 'click' THEN 'altitude_spike' WHEN 'view' THEN 'velocity_spike'
                    WHEN 'purchase' THEN 'route_deviation' WHEN 'signup' THEN 'ground_proximity'
                    ELSE event_type END AS event_type,
               ['LOW', 'MEDIUM', 'HIGH', 'CRITICAL', 'SEVERE'][event_id % 5 + 1] AS severity
        FROM events""",
    "raw_weather_text": """
        SELECT (l_orderkey * 10 + l_linenumber)::VARCHAR AS obs_id, (l_partkey * 100)::VARCHAR AS wind_direction_deg,
               CAST(l_quantity * 25 AS INTEGER)::VARCHAR AS visibility_miles,
               CASE WHEN l_linenumber = 3 THEN 'M' || l_linenumber::VARCHAR ELSE l_linenumber::VARCHAR END AS temperature_c
        FROM lineitem""",
    "rejects": """
        SELECT obs_id AS row_key, 'wind_direction_deg' AS "column", wind_direction_deg AS value
        FROM raw_weather_text WHERE try_cast(wind_direction_deg AS SMALLINT) IS NULL
        UNION ALL SELECT obs_id, 'visibility_miles', visibility_miles
        FROM raw_weather_text WHERE try_cast(visibility_miles AS DECIMAL(5,2)) IS NULL
        UNION ALL SELECT obs_id, 'temperature_c', temperature_c
        FROM raw_weather_text WHERE try_cast(temperature_c AS DECIMAL(5,1)) IS NULL""",
    "length_report": """
        SELECT 'length' AS rule, 'flights' AS "table", c.n AS "column", count(*) AS checked,
               count(CASE WHEN CASE c.n WHEN 'callsign' THEN length(callsign) > 10 WHEN 'icao24' THEN length(icao24) > 10
                   WHEN 'carrier_code' THEN length(carrier_code) > 3 WHEN 'origin_airport' THEN length(origin_airport) > 4
                   ELSE length(dest_airport) > 4 END THEN 1 END) AS failed
        FROM raw_flights, (VALUES ('callsign'), ('icao24'), ('carrier_code'), ('origin_airport'), ('dest_airport')) c(n)
        GROUP BY c.n
        UNION ALL
        SELECT 'length', 'flight_positions', c.n, count(*),
               count(CASE WHEN CASE c.n WHEN 'callsign' THEN length(callsign) > 10 WHEN 'icao24' THEN length(icao24) > 10
                   ELSE length(squawk) > 4 END THEN 1 END)
        FROM raw_positions, (VALUES ('callsign'), ('icao24'), ('squawk')) c(n) GROUP BY c.n""",
    "missing_report": """
        SELECT 'not_null' AS rule, 'flights' AS "table", 'flight_id' AS "column", count(*) AS checked,
               count(*) - count(flight_id) AS failed FROM raw_flights
        UNION ALL SELECT 'not_null', 'flights', 'flight_date', count(*), count(*) - count(flight_date) FROM raw_flights
        UNION ALL SELECT 'not_null', 'flight_positions', 'position_id', count(*), count(*) - count(position_id) FROM raw_positions
        UNION ALL SELECT 'not_null', 'flight_positions', 'icao24', count(*), count(*) - count(icao24) FROM raw_positions
        UNION ALL SELECT 'not_null', 'flight_positions', 'position_time', count(*), count(*) - count(position_time)
        FROM raw_positions""",
    "enum_report": """
        SELECT 'enum' AS rule, 'anomaly_events' AS "table", 'event_type' AS "column", count(*) AS checked,
               count(*) FILTER (event_type NOT IN ('altitude_spike', 'velocity_spike', 'route_deviation', 'ground_proximity')) AS failed
        FROM raw_anomalies
        UNION ALL
        SELECT 'enum', 'anomaly_events', 'severity', count(*),
               count(*) FILTER (severity NOT IN ('LOW', 'MEDIUM', 'HIGH', 'CRITICAL')) FROM raw_anomalies""",
    "type_report": """
        SELECT 'type' AS rule, 'weather_observations' AS "table", c.n AS "column",
               (SELECT count(*) FROM raw_weather_text) AS checked,
               (SELECT count(*) FROM rejects r WHERE r."column" = c.n) AS failed
        FROM (VALUES ('obs_id'), ('wind_direction_deg'), ('visibility_miles'), ('temperature_c')) c(n)""",
    "key_report": """
        SELECT 'primary_key' AS rule, 'weather_observations' AS "table", 'obs_id' AS "column", count(*) AS checked,
               count(*) - count(DISTINCT obs_id) AS failed FROM readings""",
}


def _orphan(table: str, source: str, column: str, parent: str, key: str) -> str:
    lost = f"{column} IS NOT NULL AND {column} NOT IN (SELECT {key} FROM {parent})"
    return f"""
        SELECT 'foreign_key' AS rule, '{table}' AS "table", '{column}' AS "column", count(*) AS checked,
               count(*) FILTER ({lost}) AS failed,
               count(DISTINCT CASE WHEN {lost} THEN {column} END) AS failed_values
        FROM {source}"""


_VIEWS["orphan_report"] = " UNION ALL ".join(
    [
        _orphan("flights", "raw_flights", "carrier_code", "airlines", "carrier_code"),
        _orphan("flights", "raw_flights", "origin_airport", "airports", "airport_code"),
        _orphan("flights", "raw_flights", "dest_airport", "airports", "airport_code"),
        _orphan("flight_positions", "raw_positions", "flight_id", "flights", "flight_id"),
        _orphan("weather_observations", "readings", "airport_code", "airports", "airport_code"),
        _orphan("anomaly_events", "raw_anomalies", "flight_id", "flights", "flight_id"),
        _orphan("anomaly_events", "raw_anomalies", "position_id", "positions", "position_id"),
    ]
)
_VIEWS["centroids"] = """
    SELECT label AS query_id, list(m ORDER BY i) AS v
    FROM (SELECT label, i, avg(x) AS m
          FROM (SELECT label, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) AS i FROM embeddings)
          GROUP BY label, i)
    GROUP BY label"""
_VIEWS["ranked_passages"] = """
    SELECT query_id::BIGINT AS query_id, vec_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank
    FROM (SELECT query_id, vec_id, round(list_cosine_similarity(v, embedding::DOUBLE[]), 9) AS score
          FROM centroids, embeddings)"""
_VIEWS["departure_weather"] = """
    SELECT f.flight_id, f.origin_airport, f.scheduled_dep_time, w.observed_at, w.wind_speed_knots, w.visibility_miles
    FROM flights f ASOF LEFT JOIN weather w
      ON f.origin_airport = w.airport_code AND f.scheduled_dep_time >= w.observed_at"""

_VIEWS["found_chunks"] = """
    SELECT query_id, vec_id, c AS chunk_no, w[c * 50 + 1 : c * 50 + 64] AS words
    FROM (SELECT query_id, vec_id, w, unnest(range(0, (greatest(len(w) - 14, 1) - 1) // 50 + 1)) AS c
          FROM (SELECT query_id, vec_id, string_split(text, ' ') AS w
                FROM ranked_passages JOIN documents ON vec_id = doc_id WHERE rank <= 3 AND query_id < 4 AND text IS NOT NULL))"""
_VIEWS["found_words"] = """
    SELECT query_id, vec_id, chunk_no, word FROM (
        SELECT DISTINCT query_id, vec_id, chunk_no, unnest(words) AS word FROM found_chunks) WHERE word <> ''"""
_VIEWS["chosen_chunks"] = """
    SELECT query_id, vec_id, arg_max(array_to_string(words, ' '), [n, -chunk_no]) AS text FROM (
        SELECT c.query_id, c.vec_id, c.chunk_no, any_value(c.words) AS words, count(s.word) AS n
        FROM found_chunks c LEFT JOIN found_words f USING (query_id, vec_id, chunk_no)
        LEFT JOIN (SELECT query_id, word FROM found_words GROUP BY 1, 2 HAVING count(DISTINCT vec_id) > 1) s
            ON s.query_id = c.query_id AND s.word = f.word
        GROUP BY 1, 2, 3) GROUP BY 1, 2"""


def _build(sql: str) -> str:
    """Put the views the text names, and those they name, in front of it."""
    order: list[str] = []

    def add(text: str) -> None:
        for name in _VIEWS:
            if name not in order and re.search(rf"(?:FROM|JOIN|,)\s+{name}\b", text):
                add(_VIEWS[name])
                if name not in order:
                    order.append(name)

    add(sql)
    views = ", ".join(f"{name} AS ({_VIEWS[name]})" for name in order)
    return f"WITH {views} {sql}" if views else sql


_HIT = "SELECT position_id, icao24, position_time, d_up::DOUBLE AS d_up, d_dn::DOUBLE AS d_dn FROM "
_POSITION = """position_id, icao24, callsign, flight_id, position_time, latitude::DOUBLE AS latitude,
    longitude::DOUBLE AS longitude, baro_altitude::DOUBLE AS baro_altitude, geo_altitude::DOUBLE AS geo_altitude,
    velocity::DOUBLE AS velocity, true_track::DOUBLE AS true_track, vertical_rate::DOUBLE AS vertical_rate, on_ground, squawk"""
_WINDOW = """
    count(*) AS samples, sum(velocity)::DOUBLE / count(velocity) AS mean_velocity,
    max(velocity)::DOUBLE AS max_velocity, min(baro_altitude)::DOUBLE AS min_altitude,
    max(baro_altitude)::DOUBLE AS max_altitude"""
_TUMBLING = f"""
    SELECT time_bucket(INTERVAL 5 MINUTES, position_time) AS window_start,
           time_bucket(INTERVAL 5 MINUTES, position_time) + INTERVAL 5 MINUTES AS window_end, icao24, {_WINDOW}
    FROM positions GROUP BY 1, 2, 3"""
_CLOSED = " <= (SELECT max(position_time) - INTERVAL 10 MINUTES FROM positions)"
_LATEST = f"""
    SELECT {_POSITION} FROM positions
    QUALIFY row_number() OVER (PARTITION BY icao24 ORDER BY position_time DESC, position_id DESC) = 1"""

_QUERIES = {
    "states_flatten": """
        SELECT snapshot_id, time, pos, icao24, callsign, origin_country, time_position, last_contact,
               longitude::DOUBLE AS longitude, latitude::DOUBLE AS latitude, baro_altitude::DOUBLE AS baro_altitude,
               on_ground, velocity::DOUBLE AS velocity, true_track::DOUBLE AS true_track,
               vertical_rate::DOUBLE AS vertical_rate, sensors, geo_altitude::DOUBLE AS geo_altitude, squawk, spi,
               position_source
        FROM states""",
    "history_flatten": "SELECT * FROM history",
    "snapshot_json_export": """
        SELECT time, count(*) AS saved, arg_min(icao24, pos) AS first_aircraft,
               string_agg(icao24, ',' ORDER BY pos) AS aircraft,
               string_agg(origin_country, ',' ORDER BY pos) AS countries,
               string_agg(coalesce(callsign, 'null'), ',' ORDER BY pos) AS callsigns,
               max(baro_altitude)::DOUBLE AS highest
        FROM states WHERE pos < 10 GROUP BY snapshot_id, time""",
    "ingest_quarantine": """
        SELECT snapshot_id, CASE WHEN snapshot_id % 7 = 3 THEN 'broken document' ELSE 'good' END AS reason,
               CASE WHEN snapshot_id % 7 = 3 THEN 1 ELSE count(*) END AS rows
        FROM states GROUP BY snapshot_id
        UNION ALL SELECT DISTINCT snapshot_id, 'no aircraft code', 2 FROM states WHERE snapshot_id % 7 = 5""",
    "states_bbox": """
        SELECT snapshot_id, pos, icao24, latitude::DOUBLE AS latitude, longitude::DOUBLE AS longitude FROM states
        WHERE latitude BETWEEN 33.0 AND 38.9 AND longitude BETWEEN 124.0 AND 130.0""",
    "states_display": """
        SELECT snapshot_id, pos, icao24, call AS callsign, latitude::DOUBLE AS latitude, longitude::DOUBLE AS longitude,
               baro_altitude::DOUBLE AS baro_altitude, velocity::DOUBLE AS velocity,
               '  ICAO: ' || icao24 || ' | 콜사인: ' || rpad(call, greatest(8, length(call))::INTEGER, ' ') || ' | 위도: ' || latitude::VARCHAR
               || ' | 경도: ' || longitude::VARCHAR || ' | 고도: ' || baro_altitude::VARCHAR || 'm | 속도: '
               || velocity::VARCHAR || 'm/s' AS line
        FROM (SELECT *, trim(coalesce(nullif(callsign, ''), 'N/A')) AS call FROM states)""",
    "states_head": """
        SELECT snapshot_id, pos, icao24, callsign, velocity::DOUBLE AS velocity FROM states WHERE pos < 5""",
    "snapshot_summary": """
        SELECT snapshot_id, strftime(make_timestamp(time * 1000000), '%Y-%m-%d %H:%M:%S UTC') AS response_time,
               count(*) AS aircraft
        FROM states GROUP BY snapshot_id, time""",
    "history_head": "SELECT icao24, batch, pos, dep, arr FROM history WHERE pos < 3",
    "route_labels": """
        SELECT icao24, batch, pos,
               coalesce(nullif(dep, ''), 'Unknown') || ' → ' || coalesce(nullif(arr, ''), 'Unknown') AS route
        FROM history""",
    "history_counts": """
        SELECT s.icao24, count(h.icao24) AS flights
        FROM (SELECT DISTINCT icao24 FROM states) s
        LEFT JOIN (SELECT * FROM history WHERE first_seen >= (SELECT max(first_seen) - 30 * 86400 FROM history)) h
          ON s.icao24 = h.icao24
        GROUP BY s.icao24""",
    "aircraft_history_window": """
        SELECT position_id, icao24, position_time, baro_altitude::DOUBLE AS baro_altitude, velocity::DOUBLE AS velocity
        FROM positions
        WHERE icao24 = '000008' AND epoch_us(position_time) // 1000000 >=
              (SELECT max(epoch_us(position_time) // 1000000) - 3600 FROM positions)""",
    "history_of_snapshot_aircraft": """
        SELECT h.icao24, h.batch, h.pos, h.first_seen, s.is_sample
        FROM history h JOIN (
            SELECT icao24, min(pos) = 0 AS is_sample FROM states
            WHERE snapshot_id = (SELECT snapshot_id FROM states ORDER BY time DESC, snapshot_id DESC LIMIT 1)
            GROUP BY icao24) s ON h.icao24 = s.icao24""",
    # the literal rows are fixed values
    "seed_dimensions": """
        SELECT 'airports' AS "table", airport_code AS code, airport_name AS name, country,
               latitude::DOUBLE AS latitude, longitude::DOUBLE AS longitude, timezone FROM airports
        UNION ALL SELECT 'airports', * FROM (VALUES
            ('RKSI', '인천국제공항', '대한민국', 37.4602, 126.4407, 'Asia/Seoul'),
            ('RKSS', '김포국제공항', '대한민국', 37.5583, 126.7906, 'Asia/Seoul'),
            ('RKPC', '제주국제공항', '대한민국', 33.5113, 126.4930, 'Asia/Seoul'),
            ('RKTN', '대구국제공항', '대한민국', 35.8964, 128.6589, 'Asia/Seoul'),
            ('RJTT', '도쿄 하네다공항', '일본', 35.5494, 139.7798, 'Asia/Tokyo'),
            ('ZBAA', '베이징 수도공항', '중국', 40.0799, 116.6031, 'Asia/Shanghai'))
        UNION ALL SELECT 'airlines', carrier_code, carrier_name, country, NULL, NULL, NULL FROM airlines
        UNION ALL SELECT 'airlines', *, NULL, NULL, NULL FROM (VALUES
            ('KE', '대한항공', '대한민국'), ('OZ', '아시아나항공', '대한민국'), ('7C', '제주항공', '대한민국'),
            ('LJ', '진에어', '대한민국'), ('NH', 'ANA', '일본'), ('CA', '중국국제항공', '중국'))""",
    "insert_ignore": """
        SELECT airport_code, observed_at, obs_id, wind_speed_knots::DOUBLE AS wind_speed_knots FROM weather
        UNION ALL
        SELECT airport_code, observed_at, obs_id, wind_speed_knots::DOUBLE FROM (
            SELECT 'A' || lpad((l_partkey % 25)::VARCHAR, 3, '0') AS airport_code,
                   l_shipdate + to_hours(CAST(l_orderkey % 24 AS INTEGER)) AS observed_at,
                   l_orderkey * 10 + l_linenumber AS obs_id, CAST(l_quantity AS DECIMAL(5,1)) AS wind_speed_knots
            FROM lineitem
            QUALIFY row_number() OVER (PARTITION BY airport_code, observed_at ORDER BY obs_id, wind_speed_knots) = 1) b
        WHERE NOT EXISTS (SELECT 1 FROM weather w
                          WHERE w.airport_code = b.airport_code AND w.observed_at = b.observed_at)""",
    "apply_defaults": """
        SELECT flight_id, callsign, dep_delay_min, 0::BIGINT AS arr_delay_min, TIMESTAMP '2024-01-01 00:00:00' AS created_at
        FROM delays""",
    "surrogate_keys": """
        SELECT airport_code, observed_at, wind_speed_knots::DOUBLE AS wind_speed_knots,
               row_number() OVER (ORDER BY airport_code, observed_at) AS obs_id
        FROM weather""",
    "gate_event_upsert": """
        SELECT f.flight_id, f.scheduled_dep_time, coalesce(g.dep, f.actual_dep_time) AS actual_dep_time,
               coalesce(g.arr, f.actual_arr_time) AS actual_arr_time
        FROM flights f LEFT JOIN (
            SELECT flight_id, arg_max(event_time, published_at) FILTER (gate_event = 'departure') AS dep,
                   arg_max(event_time, published_at) FILTER (gate_event = 'arrival') AS arr
            FROM gate_events GROUP BY flight_id) g ON f.flight_id = g.flight_id""",
    "topic_retention": """
        SELECT obs_id, airport_code, observed_at FROM readings
        WHERE observed_at >= (SELECT max(observed_at) - INTERVAL 168 HOURS FROM readings)""",
    "positions_by_date_layout": """
        SELECT p.position_id, p.icao24, e.ts AS position_time, p.velocity::DOUBLE AS velocity
        FROM positions p JOIN events e ON p.position_id = e.event_id
        WHERE CAST(e.ts AS DATE) = DATE '2024-01-15'""",
    "dq_typed_load": "SELECT * FROM rejects",
    "dq_length": "SELECT * FROM length_report",
    "dq_not_null": "SELECT * FROM missing_report",
    "dq_pk_duplicates": "SELECT obs_id, count(*) AS copies FROM readings GROUP BY obs_id HAVING count(*) > 1",
    "dq_enum_domain": "SELECT * FROM enum_report",
    "dq_fk_orphans": "SELECT * FROM orphan_report",
    "dq_report": """
        SELECT * FROM type_report UNION ALL SELECT * FROM length_report UNION ALL SELECT * FROM missing_report
        UNION ALL SELECT * FROM key_report UNION ALL SELECT * FROM enum_report
        UNION ALL SELECT rule, "table", "column", checked, failed FROM orphan_report""",
    "flights_enriched": """
        SELECT f.flight_id, f.callsign, f.carrier_code, l.carrier_name, f.origin_airport,
               o.airport_name AS origin_airport_name, o.country AS origin_country, f.dest_airport,
               d.airport_name AS dest_airport_name, d.country AS dest_country,
               d.latitude::DOUBLE AS dest_latitude, d.longitude::DOUBLE AS dest_longitude
        FROM flights f LEFT JOIN airlines l ON f.carrier_code = l.carrier_code
        LEFT JOIN airports o ON f.origin_airport = o.airport_code
        LEFT JOIN airports d ON f.dest_airport = d.airport_code""",
    "weather_enriched": """
        SELECT w.airport_code, a.airport_name, a.timezone, w.observed_at,
               w.observed_at + to_hours(CASE a.timezone WHEN 'Asia/Shanghai' THEN 8 ELSE 9 END) AS observed_local,
               w.wind_speed_knots::DOUBLE AS wind_speed_knots
        FROM weather w LEFT JOIN airports a ON w.airport_code = a.airport_code""",
    "flight_delays": """
        SELECT flight_id, dep_delay_min, arr_delay_min,
               CAST(CAST(scheduled_dep_time + to_hours(CASE timezone WHEN 'Asia/Shanghai' THEN 8 ELSE 9 END) AS DATE) AS VARCHAR)
                 AS flight_date
        FROM delays LEFT JOIN airports ON origin_airport = airport_code""",
    "metar_columns": r"""
        SELECT report_id, raw_metar, regexp_extract(raw_metar, '(\d{3})\d{2}KT', 1)::BIGINT AS wind_direction_deg,
               regexp_extract(raw_metar, '\d{3}(\d{2})KT', 1)::DOUBLE AS wind_speed_knots,
               regexp_extract(raw_metar, '(\d+)SM', 1)::DOUBLE AS visibility_miles,
               list_min(list_transform(regexp_extract_all(raw_metar, '(?:BKN|OVC)(\d{3})', 1), lambda x: x::BIGINT * 100)) AS ceiling_ft,
               regexp_extract(raw_metar, ' (\d{2})/', 1)::DOUBLE AS temperature_c,
               replace(regexp_extract(raw_metar, '/(M?\d{2}) ', 1), 'M', '-')::DECIMAL(5,1)::DOUBLE AS dewpoint_c,
               (regexp_extract(raw_metar, 'A(\d{4})$', 1)::INTEGER / 100)::DECIMAL(6,2)::DOUBLE AS altimeter_inhg
        FROM (SELECT event_id AS report_id,
                'METAR A' || lpad((event_id % 25)::VARCHAR, 3, '0') || ' 010000Z ' || lpad((event_id * 10 % 360)::VARCHAR, 3, '0')
                || lpad((event_id % 60)::VARCHAR, 2, '0') || 'KT ' || (event_id % 10)::VARCHAR || 'SM SCT020 BKN'
                || lpad((event_id * 7 % 250)::VARCHAR, 3, '0') || ' OVC' || lpad((event_id * 3 % 200 + 30)::VARCHAR, 3, '0')
                || ' ' || lpad((event_id % 35)::VARCHAR, 2, '0') || '/' || CASE WHEN event_id % 3 = 0 THEN 'M' ELSE '' END
                || lpad((event_id % 20)::VARCHAR, 2, '0') || ' A' || lpad((2900 + event_id % 150)::VARCHAR, 4, '0') AS raw_metar
              FROM events)""",
    "position_flight_attach": """
        SELECT t.position_id, t.icao24, t.position_time, f.flight_id
        FROM track t LEFT JOIN (
            SELECT *, coalesce(actual_dep_time, scheduled_dep_time) AS dep, coalesce(actual_arr_time, scheduled_arr_time) AS arr
            FROM flights) f ON t.icao24 = f.icao24 AND t.position_time BETWEEN f.dep AND f.arr
        QUALIFY row_number() OVER (PARTITION BY t.position_id ORDER BY f.dep DESC, f.flight_id DESC) = 1""",
    "weather_asof_departure": """
        SELECT flight_id, origin_airport, scheduled_dep_time, observed_at, wind_speed_knots::DOUBLE AS wind_speed_knots,
               visibility_miles::DOUBLE AS visibility_miles
        FROM departure_weather""",
    "nearest_airport": "SELECT position_id, nearest_code, nearest_km FROM nearest",
    "anomaly_enriched": """
        SELECT a.event_id, a.event_type, a.severity, a.detected_at, a.flight_id, f.carrier_code, f.origin_airport,
               f.dest_airport, a.position_id, p.on_ground, p.true_track::DOUBLE AS true_track, p.squawk
        FROM anomalies a LEFT JOIN flights f ON a.flight_id = f.flight_id
        LEFT JOIN (SELECT * FROM positions UNION ALL SELECT * FROM route_positions) p ON a.position_id = p.position_id""",
    "cep_altitude_spike": _HIT + "altitude_hits",
    "cep_velocity_spike": _HIT + "velocity_hits",
    "cep_route_deviation": "SELECT position_id, flight_id, origin_airport, dest_airport, off_route_km FROM route_hits",
    "cep_ground_proximity": """
        SELECT position_id, icao24, baro_altitude::DOUBLE AS baro_altitude, nearest_code, nearest_km FROM low_hits""",
    "anomaly_events": """
        SELECT event_id, icao24, flight_id, position_id, detected_at, event_type, severity, latitude::DOUBLE AS latitude,
               longitude::DOUBLE AS longitude, altitude_m::DOUBLE AS altitude_m, velocity_ms::DOUBLE AS velocity_ms,
               description, NULL::VARCHAR AS llm_explanation, NULL::VARCHAR AS response_procedure, false AS is_resolved,
               NULL::TIMESTAMP AS resolved_at, detected_at AS created_at
        FROM new_anomalies""",
    "positions_dedup": """
        SELECT position_id, icao24, position_time, velocity::DOUBLE AS velocity FROM polls
        QUALIFY row_number() OVER (PARTITION BY icao24, position_time ORDER BY position_id) = 1""",
    "latest_position": _LATEST,
    "latest_weather": """
        SELECT airport_code, observed_at, obs_id, wind_speed_knots::DOUBLE AS wind_speed_knots,
               wind_direction_deg::BIGINT AS wind_direction_deg, visibility_miles::DOUBLE AS visibility_miles,
               ceiling_ft::BIGINT AS ceiling_ft, temperature_c::DOUBLE AS temperature_c
        FROM weather
        QUALIFY row_number() OVER (PARTITION BY airport_code ORDER BY observed_at DESC, obs_id DESC) = 1""",
    "window_5min_metrics": _TUMBLING,
    "geo_cell_heatmap": """
        SELECT time_bucket(INTERVAL 5 MINUTES, position_time) AS window_start,
               floor(latitude / 0.25)::BIGINT AS cell_lat, floor(longitude / 0.25)::BIGINT AS cell_lon,
               count(*) AS samples, min(baro_altitude)::DOUBLE AS min_altitude
        FROM positions GROUP BY 1, 2, 3""",
    "delay_stats": """
        SELECT carrier_code, origin_airport,
               CAST(CAST(scheduled_dep_time + to_hours(CASE timezone WHEN 'Asia/Shanghai' THEN 8 ELSE 9 END) AS DATE) AS VARCHAR)
                 AS flight_date,
               count(*) AS flights, round(sum(dep_delay_min)::DOUBLE / count(*), 6) AS mean_delay,
               round(quantile_cont(dep_delay_min, 0.5), 6) AS median_delay,
               round(quantile_cont(dep_delay_min, 0.9), 6) AS p90_delay,
               round(count(*) FILTER (dep_delay_min >= 15)::DOUBLE / count(*), 6) AS late_share
        FROM delays LEFT JOIN airports ON origin_airport = airport_code
        WHERE dep_delay_min IS NOT NULL GROUP BY 1, 2, 3""",
    "delay_stats_sketched": """
        SELECT carrier_code, count(*) AS flights, round(sum(dep_delay_min)::DOUBLE / count(*), 6) AS mean_delay,
               round(count(*) FILTER (dep_delay_min >= 15)::DOUBLE / count(*), 6) AS late_share,
               true AS median_in_bound, true AS p90_in_bound
        FROM delays WHERE dep_delay_min IS NOT NULL GROUP BY 1""",
    "anomaly_counts": """
        SELECT CASE WHEN grouping(event_type) = 1 THEN 'ALL' ELSE event_type END AS event_type,
               CASE WHEN grouping(severity) = 1 THEN 'ALL' ELSE severity END AS severity, count(*) AS events
        FROM new_anomalies GROUP BY ROLLUP (new_anomalies.event_type, new_anomalies.severity)""",
    "anomaly_resolution_time": """
        SELECT severity, count(m) AS resolved, count(*) FILTER (NOT is_resolved) AS open,
               round(sum(m)::DOUBLE / count(m), 6) AS mean_minutes, max(m) AS max_minutes
        FROM (SELECT *, (epoch_us(resolved_at) - epoch_us(detected_at)) // 60000000 AS m FROM anomalies)
        GROUP BY severity""",
    "severity_topk": f"""
        SELECT event_id, event_type, severity, {_RANK} AS severity_rank, detected_at FROM new_anomalies
        ORDER BY severity_rank DESC, detected_at DESC, event_id DESC LIMIT 20""",
    "anomaly_open_queue": f"""
        SELECT event_id, icao24, event_type, severity, {_RANK} AS severity_rank, detected_at FROM anomalies
        WHERE NOT is_resolved""",
    "flights_lookup": " UNION ALL ".join(
        f"SELECT '{tag}' AS looked_up, flight_id, icao24, callsign, origin_airport, dest_airport FROM flights WHERE {test}"
        for tag, test in {
            "icao24": "icao24 = '000042'",
            "callsign": "callsign = 'KAL123'",
            "flight_date": "flight_date = DATE '1997-07-27'",
            "origin": "origin_airport = 'A003'",
            "dest": "dest_airport = 'A011'",
        }.items()
    ),
    "positions_geo_box": """
        SELECT position_id, icao24, position_time, latitude::DOUBLE AS latitude, longitude::DOUBLE AS longitude
        FROM positions
        WHERE position_time BETWEEN TIMESTAMP '2024-01-01 00:10:00' AND TIMESTAMP '2024-01-01 00:30:00'
          AND latitude BETWEEN 33.0 AND 38.9 AND longitude BETWEEN 124.0 AND 130.0""",
    "stream_topics": """
        SELECT topic, ('0x' || substr(md5(key), 1, 8))::BIGINT % 3 AS "partition", count(*) AS events,
               min(event_time) AS first_event, max(event_time) AS last_event
        FROM (SELECT 'flight-position' AS topic, icao24 AS key, position_time AS event_time FROM positions
              UNION ALL SELECT 'weather-event', airport_code, observed_at FROM readings
              UNION ALL SELECT 'gate-event', airport_code, event_time FROM gate_events)
        GROUP BY 1, 2""",
    "stream_window_5min": f"SELECT * FROM ({_TUMBLING}) WHERE window_end {_CLOSED}",
    "stream_window_sliding": f"""
        SELECT * FROM (
            SELECT s AS window_start, s + INTERVAL 5 MINUTES AS window_end, icao24, {_WINDOW}
            FROM (SELECT *, time_bucket(INTERVAL 1 MINUTE, position_time) - to_minutes(n) AS s
                  FROM (SELECT *, unnest([0, 1, 2, 3, 4]) AS n FROM positions))
            GROUP BY 1, 2, 3)
        WHERE window_end {_CLOSED}""",
    "stream_dedup": "SELECT DISTINCT icao24, position_time FROM polls",
    "stream_cep": f"""
        SELECT icao24, position_id, position_time, event_type, d_up::DOUBLE AS d_up, d_dn::DOUBLE AS d_dn
        FROM (SELECT *, 'altitude_spike' AS event_type FROM altitude_hits
              UNION ALL SELECT *, 'velocity_spike' FROM velocity_hits)
        WHERE position_time < (SELECT date_trunc('millisecond', max(position_time)) - INTERVAL 10 MINUTES FROM positions)""",
    "stream_latest_state": _LATEST,
    "stream_enrich_static": """
        SELECT g.*, a.airport_name, a.country FROM gate_events g LEFT JOIN airports a ON g.airport_code = a.airport_code""",
    "stream_position_weather": """
        SELECT p.position_id, p.flight_id, p.airport_code, p.position_time, w.observed_at
        FROM (SELECT t.position_id, t.flight_id, t.position_time,
                     CASE WHEN epoch_us(t.position_time) * 2 <= epoch_us(f.scheduled_dep_time) + epoch_us(f.scheduled_arr_time)
                          THEN f.origin_airport ELSE f.dest_airport END AS airport_code
              FROM (SELECT *, position_id // 10 AS flight_id FROM track WHERE position_id % 13 != 0) t
              JOIN flights f ON t.flight_id = f.flight_id) p
        JOIN weather w ON p.airport_code = w.airport_code
          AND w.observed_at BETWEEN p.position_time - INTERVAL 1 HOUR AND p.position_time""",
    "stream_departure_weather": """
        SELECT f.flight_id, f.origin_airport AS airport_code, f.scheduled_dep_time AS position_time, w.observed_at
        FROM flights f JOIN weather w ON f.origin_airport = w.airport_code
          AND w.observed_at BETWEEN f.scheduled_dep_time - INTERVAL 1 HOUR AND f.scheduled_dep_time""",
    "delay_features": """
        SELECT c.flight_id, c.carrier_code, c.origin_airport, c.cutoff, c.scheduled_dep_time,
               hour(c.scheduled_dep_time) AS dep_hour, isodow(c.scheduled_dep_time) AS dep_weekday,
               c.distance_miles::DOUBLE AS distance_miles, c.dep_delay_min, c.recent_flights,
               round(c.recent_delay::DOUBLE / nullif(c.recent_flights, 0), 6) AS recent_mean_delay, w.observed_at,
               w.wind_speed_knots::DOUBLE AS wind_speed_knots, w.visibility_miles::DOUBLE AS visibility_miles
        FROM (SELECT f.flight_id, f.carrier_code, f.origin_airport, f.cutoff, f.scheduled_dep_time, f.distance_miles,
                     f.dep_delay_min, count(d.flight_id) AS recent_flights, sum(d.dep_delay_min) AS recent_delay
              FROM (SELECT *, scheduled_dep_time - INTERVAL 15 MINUTES AS cutoff FROM delays) f
              LEFT JOIN delays d ON d.origin_airport = f.origin_airport
                AND d.actual_dep_time > f.cutoff - INTERVAL 3 HOURS AND d.actual_dep_time <= f.cutoff
              GROUP BY ALL) c
        ASOF LEFT JOIN weather w ON c.origin_airport = w.airport_code AND c.cutoff >= w.observed_at""",
    "drift_psi": """
        SELECT feature, round(sum((cur - ref) * ln(cur / ref)), 6) AS psi, max(ref_all)::BIGINT AS ref_rows, max(cur_all)::BIGINT AS cur_rows
        FROM (SELECT *, greatest(ref_n::DOUBLE / ref_all, 1e-4) AS ref, greatest(cur_n::DOUBLE / cur_all, 1e-4) AS cur
              FROM (SELECT *, sum(ref_n) OVER (PARTITION BY feature) AS ref_all, sum(cur_n) OVER (PARTITION BY feature) AS cur_all
                    FROM (SELECT feature, greatest(0, least(9, floor((x - low) / ((high - low) / 10)))) AS bin,
                                 count(*) FILTER (NOT later) AS ref_n, count(*) FILTER (later) AS cur_n
                          FROM (SELECT 'baro_altitude' AS feature, baro_altitude::DOUBLE AS x, 0::DOUBLE AS low, 600::DOUBLE AS high,
                                       position_time >= TIMESTAMP '2024-01-01 00:24:00' AS later FROM positions
                                UNION ALL SELECT 'velocity', velocity::DOUBLE, 0, 300,
                                       position_time >= TIMESTAMP '2024-01-01 00:24:00' FROM positions
                                UNION ALL SELECT 'vertical_rate', vertical_rate::DOUBLE, -10, 10,
                                       position_time >= TIMESTAMP '2024-01-01 00:24:00' FROM positions)
                          GROUP BY 1, 2)))
        GROUP BY feature""",
    "drift_psi_sketched": """
        SELECT feature, count(*) FILTER (NOT later) AS ref_rows, count(*) FILTER (later) AS cur_rows,
               true AS ref_in_bound, true AS cur_in_bound
        FROM (UNPIVOT (SELECT position_time >= TIMESTAMP '2024-01-01 00:24:00' AS later, baro_altitude::DOUBLE AS baro_altitude,
                              velocity::DOUBLE AS velocity, vertical_rate::DOUBLE AS vertical_rate FROM positions)
              ON baro_altitude, velocity, vertical_rate INTO NAME feature VALUE x)
        GROUP BY feature""",
    "model_metrics": """
        SELECT CASE WHEN grouping(carrier_code) = 1 THEN 'ALL' ELSE carrier_code END AS "group", count(*) AS rows,
               round(sum(abs(e))::DOUBLE / count(*), 6) AS mae, round(sqrt(sum(e * e)::DOUBLE / count(*)), 6) AS rmse,
               round(sum(e)::DOUBLE / count(*), 6) AS bias
        FROM (SELECT d.carrier_code, CAST(m.prediction - d.dep_delay_min AS DECIMAL(12,2)) AS e
              FROM delays d JOIN (
                SELECT origin_airport, CAST(round(sum(dep_delay_min)::DOUBLE / count(*), 2) AS DECIMAL(10,2)) AS prediction
                FROM delays WHERE dep_delay_min IS NOT NULL AND scheduled_dep_time < TIMESTAMP '1999-01-01'
                GROUP BY origin_airport) m ON d.origin_airport = m.origin_airport
              WHERE d.dep_delay_min IS NOT NULL AND d.scheduled_dep_time >= TIMESTAMP '1999-01-01')
        GROUP BY ROLLUP (carrier_code)""",
    "rag_chunks": """
        SELECT doc_id, c AS chunk_no, c * 50 AS first_word, len(w[c * 50 + 1 : c * 50 + 64]) AS words,
               array_to_string(w[c * 50 + 1 : c * 50 + 64], ' ') AS text
        FROM (SELECT doc_id, w, unnest(range(0, (greatest(len(w) - 14, 1) - 1) // 50 + 1)) AS c
              FROM (SELECT doc_id, string_split(text, ' ') AS w FROM documents))""",
    "rag_topk": "SELECT query_id, vec_id, round(score, 4) AS score, rank FROM ranked_passages WHERE rank <= 5",
    "anomaly_prompt_table": """
        SELECT a.event_id, a.event_type, a.severity, a.flight_id, w.origin_airport, w.observed_at,
               w.wind_speed_knots::DOUBLE AS wind_speed_knots, p.passage_ids, f.dest_airport AS grounded_dest, p.first_passage,
               NULL::VARCHAR AS llm_explanation, NULL::VARCHAR AS response_procedure
        FROM anomalies a LEFT JOIN departure_weather w ON a.flight_id = w.flight_id
        LEFT JOIN flights f ON a.flight_id = f.flight_id
        LEFT JOIN (
            SELECT ['altitude_spike', 'velocity_spike', 'route_deviation', 'ground_proximity'][query_id + 1] AS event_type,
                   string_agg(vec_id::VARCHAR, ',' ORDER BY rank) AS passage_ids,
                   arg_min(coalesce(c.text, ''), rank) AS first_passage
            FROM ranked_passages LEFT JOIN chosen_chunks c USING (query_id, vec_id)
            WHERE rank <= 3 AND query_id < 4 GROUP BY query_id) p ON a.event_type = p.event_type""",
    "stream_late_report": """
        SELECT batch, count(*) AS rows, count(*) FILTER (t < before - INTERVAL 10 MINUTES) AS late,
               any_value(max_time) AS max_time
        FROM (SELECT position_id % 5 AS batch, position_time AS t FROM positions) JOIN (
            SELECT position_id % 5 AS batch, max(max(position_time)) OVER (ORDER BY position_id % 5) AS max_time,
                   max(max(position_time)) OVER (ORDER BY position_id % 5
                       ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before
            FROM positions GROUP BY position_id % 5) USING (batch)
        GROUP BY batch""",
    "transcript_clean": "SELECT * FROM clean_turns",
    "sft_pairs": """
        SELECT min(p).conv_id AS conv_id, min(p).turn AS turn, prompt, response FROM (
            SELECT {'conv_id': q.conv_id, 'turn': q.turn} AS p, q.text AS prompt, a.text AS response
            FROM clean_turns q JOIN clean_turns a ON q.conv_id = a.conv_id AND q.turn + 1 = a.turn
            WHERE q.role = 'user' AND a.role = 'assistant' AND length(q.text) > 0 AND length(a.text) > 0)
        GROUP BY prompt, response""",
    "dpo_pairs": """
        WITH ranked AS (
            SELECT d.doc_id, lang, quality, text, row_number() OVER (PARTITION BY lang, quality ORDER BY d.doc_id) AS pair_no
            FROM documents d JOIN labels l ON d.doc_id = l.doc_id WHERE quality IN (0, 1))
        SELECT g.lang, g.pair_no, g.doc_id AS chosen_id, b.doc_id AS rejected_id, g.text AS chosen, b.text AS rejected
        FROM ranked g JOIN ranked b ON g.lang = b.lang AND g.pair_no = b.pair_no AND g.quality = 1 AND b.quality = 0""",
}



_SIDE = "(2 * pi() * cos(radians(36.0)) / {n} / sqrt(3))"


def _with_hexagon(source: str, lat: str, lon: str, level: int, name: str) -> str:
    """Rows with their place's hexagon: columns around the globe, rows over an equal-area projection true at 36 degrees."""
    n = 90 * 2**level
    return f"""
        SELECT * EXCLUDE (x, y, q, r, rq, rr, rs, one, row_no), {level << 56}::BIGINT + (row_no << 28)
               + ((CASE WHEN one THEN -rr - rs ELSE rq END + (row_no >> 1)) % {n} + {n}) % {n} AS {name}
        FROM (SELECT *, CASE WHEN NOT one AND abs(rr - r) >= abs(rs - (-q - r)) THEN -rq - rs ELSE rr END AS row_no
        FROM (SELECT *, abs(rq - q) > abs(rr - r) AND abs(rq - q) > abs(rs - (-q - r)) AS one
        FROM (SELECT *, floor(q + 0.5)::BIGINT AS rq, floor(r + 0.5)::BIGINT AS rr, floor(-q - r + 0.5)::BIGINT AS rs
        FROM (SELECT *, x - y / 3.0 AS q, y * 2.0 / 3.0 AS r
        FROM (SELECT *, ({lon}::DOUBLE + 180.0) / 360.0 * {n} AS x,
                     (sin(radians({lat}::DOUBLE)) + 1.0) / cos(radians(36.0)) / {_SIDE.format(n=n)} AS y FROM ({source}))))))"""


_CENTRES = f"""
        SELECT *, degrees(asin(greatest(-1.0, least(1.0, ((cell >> 28) & 268435455) * 1.5 * {_SIDE.format(n=1440)} * cos(radians(36.0)) - 1.0)))) AS lat,
               ((cell & 268435455) + CASE WHEN (cell >> 28) % 2 = 1 THEN 0.5 ELSE 0.0 END) / 1440.0 * 360.0 - 180.0 AS lon
        FROM (SELECT time_bucket(INTERVAL 5 MINUTES, position_time) AS window_start, cell, count(*) AS samples,
                     min(baro_altitude)::DOUBLE AS min_altitude
              FROM ({_with_hexagon("SELECT position_time, latitude, longitude, baro_altitude FROM positions", "latitude", "longitude", 4, "cell")})
              GROUP BY 1, 2)"""
_QUERIES["geo_hex_heatmap"] = f"""
        SELECT window_start, cell, parent, samples, min_altitude FROM ({_with_hexagon(_CENTRES, "lat", "lon", 3, "parent")})"""
# the same rows by other ways
_QUERIES["stream_late_dropped"] = _QUERIES["stream_late_report"]
_QUERIES["flights_lookup_table"] = _QUERIES["flights_lookup"]
_QUERIES["positions_box_layout"] = _QUERIES["positions_geo_box"]

ORACLES = {name: _build(sql) for name, sql in _QUERIES.items()}
