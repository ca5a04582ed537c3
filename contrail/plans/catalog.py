"""The registered queries: each takes (spark, folder) and gives a DataFrame."""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession, functions as F

from contrail.functions.metar import with_metar_columns
from contrail.operators import cep, features, forest, index, joins, layout, models, pairs, quality, retrieval, serving, shapley, sketches, upkeep
from contrail.operators.spread import lookup_join
from contrail.plans.feed import Feed, present
from contrail.schemas import ANOMALIES, FLIGHTS, POSITIONS, WEATHER
from contrail.session import scratch_path, written
from contrail.sources import adapters, landing
from contrail.streaming import jobs, late, log, spikes, topics

DRIFT_RANGES = {"baro_altitude": (0.0, 600.0), "velocity": (0.0, 300.0), "vertical_rate": (-10.0, 10.0)}

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(build: Callable[[Feed], DataFrame]) -> Callable[[Feed], DataFrame]:
    QUERIES[build.__name__] = lambda spark, sf_dir: present(build(Feed(spark, sf_dir)))
    return build


# landed documents


@query
def states_flatten(t: Feed) -> DataFrame:
    return landing.flatten_states(t.snapshots).withColumn("sensors", F.to_json("sensors"))


@query
def history_flatten(t: Feed) -> DataFrame:
    return landing.flatten_histories(t.histories)


@query
def snapshot_json_export(t: Feed) -> DataFrame:
    """Written as text, read back and opened again."""
    path = scratch_path(t.spark, "export")
    landing.write_export(t.snapshots, path)
    written = t.spark.read.text(path)
    record = "array<struct<icao24:string, callsign:string, origin_country:string, baro_altitude:double>>"
    return written.withColumn("d", F.from_json("value", f"time bigint, states {record}")).select(
        F.col("d.time").alias("time"),
        F.size("d.states").alias("saved"),
        landing.first_exported_aircraft("value").alias("first_aircraft"),
        F.array_join("d.states.icao24", ",").alias("aircraft"),
        F.array_join("d.states.origin_country", ",").alias("countries"),
        F.array_join("d.states.callsign", ",", "null").alias("callsigns"),
        F.array_max("d.states.baro_altitude").alias("highest"),
    )


@query
def ingest_quarantine(t: Feed) -> DataFrame:
    """Some documents cut short, some with empty and null states: what is kept and what is not."""
    body = (
        F.when(F.col("snapshot_id") % 7 == 3, F.expr("substring(body, 1, length(body) - 5)"))
        .when(F.col("snapshot_id") % 7 == 5, F.regexp_replace("body", r"\]\}$", ",[],null]}"))
        .otherwise(F.col("body"))
    )
    tagged = landing.tagged_states(t.snapshots.withColumn("body", body))
    both = tagged.select("snapshot_id", F.coalesce("reason", F.lit("good")).alias("reason"))
    return both.groupBy("snapshot_id", "reason").agg(F.count(F.lit(1)).alias("rows"))


@query
def states_bbox(t: Feed) -> DataFrame:
    inside = landing.in_area(landing.flatten_states(t.snapshots), **landing.AREA)
    return inside.select("snapshot_id", "pos", "icao24", "latitude", "longitude")


@query
def states_display(t: Feed) -> DataFrame:
    return landing.display_lines(landing.flatten_states(t.snapshots))


@query
def states_head(t: Feed) -> DataFrame:
    return landing.head_states(t.snapshots, 5).select("snapshot_id", "pos", "icao24", "callsign", "velocity")


@query
def snapshot_summary(t: Feed) -> DataFrame:
    return landing.snapshot_summary(t.snapshots)


@query
def history_head(t: Feed) -> DataFrame:
    return landing.flatten_histories(t.histories, head=3).select("icao24", "batch", "pos", "dep", "arr")


@query
def route_labels(t: Feed) -> DataFrame:
    return landing.route_labels(landing.flatten_histories(t.histories)).select("icao24", "batch", "pos", "route")


@query
def history_counts(t: Feed) -> DataFrame:
    """Flights first seen in the last thirty days, per aircraft of the snapshots."""
    histories = landing.flatten_histories(t.histories)
    now = histories.agg(F.max("first_seen").alias("now")).scalar()
    aircraft = landing.flatten_states(t.snapshots).select("icao24")
    return landing.history_counts(aircraft, landing.recent(histories, "first_seen", now, 30 * 86_400))


@query
def aircraft_history_window(t: Feed) -> DataFrame:
    """One aircraft over the last hour before the newest position."""
    p = t.positions.withColumn("seconds", F.unix_seconds("position_time"))
    now = p.agg(F.max("seconds").alias("now")).scalar()
    one = landing.recent(p.filter(F.col("icao24") == "000008"), "seconds", now)
    return one.select("position_id", "icao24", "position_time", "baro_altitude", "velocity")


@query
def history_of_snapshot_aircraft(t: Feed) -> DataFrame:
    return landing.history_of_newest(t.snapshots, landing.flatten_histories(t.histories)).select(
        "icao24", "batch", "pos", "first_seen", "is_sample"
    )


# tables and constraints


@query
def seed_dimensions(t: Feed) -> DataFrame:
    """The seed rows merged into the given dimensions."""
    airports = upkeep.insert_ignore(t.airports, upkeep.seed_airports(t.spark), ["airport_code"], ["airport_name"])
    airlines = upkeep.insert_ignore(t.airlines, upkeep.seed_airlines(t.spark), ["carrier_code"], ["carrier_name"])
    return airports.select(
        F.lit("airports").alias("table"),
        F.col("airport_code").alias("code"),
        F.col("airport_name").alias("name"),
        "country",
        "latitude",
        "longitude",
        "timezone",
    ).unionByName(
        airlines.select(
            F.lit("airlines").alias("table"),
            F.col("carrier_code").alias("code"),
            F.col("carrier_name").alias("name"),
            "country",
        ),
        allowMissingColumns=True,
    )


@query
def insert_ignore(t: Feed) -> DataFrame:
    """A second weather feed merged into the table by airport and time."""
    columns = ["airport_code", "observed_at", "obs_id", "wind_speed_knots"]
    other = t.table("lineitem").selectExpr(
        "concat('A', lpad(cast(l_partkey % 25 AS string), 3, '0')) AS airport_code",
        "timestampadd(HOUR, cast(l_orderkey % 24 AS int), cast(l_shipdate AS timestamp)) AS observed_at",
        "l_orderkey * 10 + l_linenumber AS obs_id",
        "cast(l_quantity AS decimal(5,1)) AS wind_speed_knots",
    )
    return upkeep.insert_ignore(
        t.weather.select(columns), other, ["airport_code", "observed_at"], ["obs_id", "wind_speed_knots"]
    )


@query
def apply_defaults(t: Feed) -> DataFrame:
    given = joins.with_delays(t.flights).drop("arr_delay_min")
    now = F.lit("2024-01-01 00:00:00").cast("timestamp")
    return upkeep.apply_defaults(given, FLIGHTS, now).select(
        "flight_id", "callsign", "dep_delay_min", "arr_delay_min", "created_at"
    )


@query
def surrogate_keys(t: Feed) -> DataFrame:
    unnumbered = t.weather.select("airport_code", "observed_at", "wind_speed_knots")
    return upkeep.assign_ids(unnumbered, "obs_id", ["airport_code", "observed_at"])


@query
def gate_event_upsert(t: Feed) -> DataFrame:
    return upkeep.gate_upsert(t.flights, t.gate_events).select(
        "flight_id", "scheduled_dep_time", "actual_dep_time", "actual_arr_time"
    )


@query
def topic_retention(t: Feed) -> DataFrame:
    return upkeep.within_retention(t.readings, "observed_at").select("obs_id", "airport_code", "observed_at")


@query
def positions_by_date_layout(t: Feed) -> DataFrame:
    """All positions written by date, one day read back."""
    path = scratch_path(t.spark, "positions")
    ts = t.table("events").select(F.col("event_id").alias("position_id"), F.col("ts").cast("timestamp").alias("at"))
    dated = t.positions.drop("position_time").join(ts, "position_id").withColumnRenamed("at", "position_time")
    upkeep.write_by_date(dated, path)
    return upkeep.read_day(t.spark, path, "2024-01-15").select("position_id", "icao24", "position_time", "velocity")


@query
def dq_typed_load(t: Feed) -> DataFrame:
    return quality.typed_load(t.raw_weather_text, WEATHER)[1]


@query
def dq_length(t: Feed) -> DataFrame:
    return quality.too_long(t.raw_flights, FLIGHTS).unionByName(quality.too_long(t.raw_positions, POSITIONS))


@query
def dq_not_null(t: Feed) -> DataFrame:
    return quality.missing(t.raw_flights, FLIGHTS).unionByName(quality.missing(t.raw_positions, POSITIONS))


@query
def dq_pk_duplicates(t: Feed) -> DataFrame:
    return quality.repeated_keys(t.readings, ["obs_id"])


@query
def dq_enum_domain(t: Feed) -> DataFrame:
    return quality.outside_enum(t.raw_anomalies, ANOMALIES)


def _orphans(t: Feed) -> DataFrame:
    parents = {
        "airlines": t.airlines,
        "airports": t.airports,
        "flights": t.flights.select("flight_id"),
        "flight_positions": t.positions.select("position_id"),
    }
    return (
        quality.orphans(t.raw_flights, FLIGHTS, parents)
        .unionByName(quality.orphans(t.raw_positions, POSITIONS, parents))
        .unionByName(quality.orphans(t.readings, WEATHER, parents))
        .unionByName(quality.orphans(t.raw_anomalies, ANOMALIES, parents))
    )


@query
def dq_fk_orphans(t: Feed) -> DataFrame:
    return _orphans(t)


@query
def dq_report(t: Feed) -> DataFrame:
    return quality.report(
        [
            quality.load_report(t.raw_weather_text, WEATHER),
            quality.checks(t.raw_flights, FLIGHTS, "length", "not_null"),
            quality.checks(t.raw_positions, POSITIONS, "length", "not_null"),
            quality.key_report(t.readings, WEATHER),
            quality.outside_enum(t.raw_anomalies, ANOMALIES),
            _orphans(t),
        ]
    )


# joins


@query
def flights_enriched(t: Feed) -> DataFrame:
    return joins.enrich_flights(t.flights, t.airlines, t.airports).select(
        "flight_id",
        "callsign",
        "carrier_code",
        "carrier_name",
        "origin_airport",
        "origin_airport_name",
        "origin_country",
        "dest_airport",
        "dest_airport_name",
        "dest_country",
        "dest_latitude",
        "dest_longitude",
    )


@query
def weather_enriched(t: Feed) -> DataFrame:
    return joins.enrich_weather(t.weather, t.airports).select(
        "airport_code", "airport_name", "timezone", "observed_at", "observed_local", "wind_speed_knots"
    )


@query
def flight_delays(t: Feed) -> DataFrame:
    dated = joins.with_local_flight_date(joins.with_delays(t.flights), t.airports)
    return dated.select("flight_id", "dep_delay_min", "arr_delay_min", "flight_date")


@query
def metar_columns(t: Feed) -> DataFrame:
    return with_metar_columns(adapters.metar_reports(t.table("events")))


@query
def position_flight_attach(t: Feed) -> DataFrame:
    return joins.attach_flights(t.track, t.flights)


@query
def weather_asof_departure(t: Feed) -> DataFrame:
    return joins.weather_before(t.flights, t.weather, ["wind_speed_knots", "visibility_miles"]).select(
        "flight_id", "origin_airport", "scheduled_dep_time", "observed_at", "wind_speed_knots", "visibility_miles"
    )


@query
def nearest_airport(t: Feed) -> DataFrame:
    return cep.nearest_airport(t.positions, t.airports).select("position_id", "nearest_code", "nearest_km")


@query
def anomaly_enriched(t: Feed) -> DataFrame:
    positions = t.positions.unionByName(t.route_positions)
    return joins.enrich_anomalies(t.anomalies, t.flights, positions).select(
        "event_id",
        "event_type",
        "severity",
        "detected_at",
        "flight_id",
        "carrier_code",
        "origin_airport",
        "dest_airport",
        "position_id",
        "on_ground",
        "true_track",
        "squawk",
    )


# anomaly rules

_HIT = ["position_id", "icao24", "position_time", "d_up", "d_dn"]


@query
def cep_altitude_spike(t: Feed) -> DataFrame:
    return cep.altitude_spikes(cep.sample_changes(t.positions)).select(*_HIT)


@query
def cep_velocity_spike(t: Feed) -> DataFrame:
    return cep.velocity_spikes(cep.sample_changes(t.positions)).select(*_HIT)


@query
def cep_route_deviation(t: Feed) -> DataFrame:
    return cep.route_deviations(t.route_positions, t.flights, t.airports).select(
        "position_id", "flight_id", "origin_airport", "dest_airport", "off_route_km"
    )


@query
def cep_ground_proximity(t: Feed) -> DataFrame:
    return cep.ground_proximity(t.positions, t.airports).select(
        "position_id", "icao24", "baro_altitude", "nearest_code", "nearest_km"
    )


@query
def anomaly_events(t: Feed) -> DataFrame:
    return t.new_anomalies


@query
def positions_dedup(t: Feed) -> DataFrame:
    return cep.distinct_samples(t.polls).select("position_id", "icao24", "position_time", "velocity")


# serving


@query
def latest_position(t: Feed) -> DataFrame:
    return serving.latest(t.positions, "icao24", "position_time", "position_id")


@query
def latest_weather(t: Feed) -> DataFrame:
    return serving.latest(t.weather, "airport_code", "observed_at", "obs_id")


@query
def window_5min_metrics(t: Feed) -> DataFrame:
    return serving.window_metrics(t.positions)


@query
def geo_cell_heatmap(t: Feed) -> DataFrame:
    return serving.cell_counts(t.positions)


@query
def geo_hex_heatmap(t: Feed) -> DataFrame:
    return serving.hex_counts(t.positions)


@query
def delay_stats(t: Feed) -> DataFrame:
    dated = joins.with_local_flight_date(joins.with_delays(t.flights), t.airports)
    return serving.delay_stats(dated, ["carrier_code", "origin_airport", "flight_date"])


@query
def delay_stats_sketched(t: Feed) -> DataFrame:
    """Figures per carrier from stored day sketches; median and p90 are measured against all flights."""
    delays = joins.with_delays(t.flights).withColumn("month", F.date_format("flight_date", "yyyy-MM"))
    days = sketches.day_sketches(delays, ["carrier_code", "origin_airport", "month", "flight_date"], "dep_delay_min")
    path = scratch_path(t.spark, "delay-sketches")
    sketches.store(days, path, "month")
    by = ["carrier_code"]
    answers = sketches.figures(sketches.merge(t.spark.read.parquet(path), by), by)
    # merged sketches may give other values in another run: keep these
    answers = written(answers, "delay-answers")
    asked = {"median_delay": 0.5, "p90_delay": 0.9}
    errors = sketches.measured(delays, answers, by, "dep_delay_min", asked)
    bound = F.lit(2 * sketches.rank_error())
    return lookup_join(answers, errors, by, counted=answers).select(
        "carrier_code",
        "flights",
        "mean_delay",
        "late_share",
        (F.col("median_delay_error") <= bound).alias("median_in_bound"),
        (F.col("p90_delay_error") <= bound).alias("p90_in_bound"),
    )


@query
def anomaly_counts(t: Feed) -> DataFrame:
    return serving.anomaly_counts(t.new_anomalies)


@query
def anomaly_resolution_time(t: Feed) -> DataFrame:
    return serving.resolution_time(t.anomalies)


@query
def severity_topk(t: Feed) -> DataFrame:
    return serving.most_severe(t.new_anomalies, 20).select(
        "event_id", "event_type", "severity", "severity_rank", "detected_at"
    )


@query
def anomaly_open_queue(t: Feed) -> DataFrame:
    return serving.open_queue(t.anomalies).select(
        "event_id", "icao24", "event_type", "severity", "severity_rank", "detected_at"
    )


def _five_lookups(flights: DataFrame) -> DataFrame:
    wanted = {
        "icao24": "000042",
        "callsign": "KAL123",
        "flight_date": "1997-07-27",
        "origin": "A003",
        "dest": "A011",
    }
    found = None
    for column, value in wanted.items():
        one = serving.find_flights(flights, **{column: value}).select(
            F.lit(column).alias("looked_up"), "flight_id", "icao24", "callsign", "origin_airport", "dest_airport"
        )
        found = one if found is None else found.unionByName(one)
    return found


@query
def flights_lookup(t: Feed) -> DataFrame:
    """The five indexed lookups, tagged with the column used."""
    return _five_lookups(t.flights)


@query
def flights_lookup_table(t: Feed) -> DataFrame:
    """The same lookups on the written table with bloom filters."""
    path = scratch_path(t.spark, "flights")
    layout.write_lookup(t.flights, path)
    return _five_lookups(t.spark.read.parquet(path))


@query
def positions_box_layout(t: Feed) -> DataFrame:
    """The box of positions_geo_box, read along the space-time curve."""
    path = scratch_path(t.spark, "space-time")
    layout.write_space_time(t.positions, path)
    box = layout.read_box(t.spark, path, datetime(2024, 1, 1, 0, 10), datetime(2024, 1, 1, 0, 30), landing.AREA)
    return box.select("position_id", "icao24", "position_time", "latitude", "longitude")


@query
def positions_geo_box(t: Feed) -> DataFrame:
    low, high = (F.lit(x).cast("timestamp") for x in ("2024-01-01 00:10:00", "2024-01-01 00:30:00"))
    timed = t.positions.filter(F.col("position_time").between(low, high))
    return landing.in_area(timed, **landing.AREA).select(
        "position_id", "icao24", "position_time", "latitude", "longitude"
    )


# streams


def _positions_stream(t: Feed) -> DataFrame:
    return topics.read_stream(t.spark, "flight-position", t.sf_dir)


@query
def stream_topics(t: Feed) -> DataFrame:
    """The tables as a landed log of three topics, read as a stream with an offset per partition."""
    root = scratch_path(t.spark, "log")
    log.publish(topics.landed_rows(t.spark, t.sf_dir), root, payload=topics.payload())
    landed = topics.run_to_table(log.stream_log(t.spark, root), "topics")
    return landed.groupBy("topic", "partition").agg(
        F.count(F.lit(1)).alias("events"),
        F.min("event_time").alias("first_event"),
        F.max("event_time").alias("last_event"),
    )


@query
def stream_window_5min(t: Feed) -> DataFrame:
    return topics.run_to_table(jobs.windowed(_positions_stream(t)), "window")


@query
def stream_window_sliding(t: Feed) -> DataFrame:
    return topics.run_to_table(jobs.windowed(_positions_stream(t), "5 minutes", "1 minute"), "sliding")


@query
def stream_dedup(t: Feed) -> DataFrame:
    polled = adapters.polls(topics.stream_files(t.spark, t.sf_dir, "events"))
    return topics.run_to_table(jobs.deduplicated(polled), "dedup").select("icao24", "position_time")


@query
def stream_cep(t: Feed) -> DataFrame:
    with spikes.rocks_state(t.spark):
        return topics.run_to_table(spikes.stream_spikes(_positions_stream(t)), "spikes")


@query
def stream_latest_state(t: Feed) -> DataFrame:
    return jobs.keep_latest(_positions_stream(t))


@query
def stream_enrich_static(t: Feed) -> DataFrame:
    gate = topics.read_stream(t.spark, "gate-event", t.sf_dir)
    return topics.run_to_table(jobs.gate_with_airports(gate, t.airports), "gate")


@query
def stream_position_weather(t: Feed) -> DataFrame:
    positions = adapters.tied_track(topics.stream_files(t.spark, t.sf_dir, "orders"))
    weather = topics.read_stream(t.spark, "weather-event", t.sf_dir)
    with spikes.rocks_state(t.spark):
        return topics.run_to_table(jobs.positions_with_weather(positions, t.flights, weather), "position-weather")


@query
def stream_departure_weather(t: Feed) -> DataFrame:
    departures = adapters.flights(topics.stream_files(t.spark, t.sf_dir, "orders")).select(
        "flight_id",
        F.col("origin_airport").alias("airport_code"),
        F.col("scheduled_dep_time").alias("position_time"),
    )
    weather = topics.read_stream(t.spark, "weather-event", t.sf_dir)
    return topics.run_to_table(jobs.departures_with_weather(departures, weather), "weather")


@query
def stream_late_report(t: Feed) -> DataFrame:
    """The events arrive in five landings, one after the other, so rows can be late; the job goes on after each."""
    folder, target = scratch_path(t.spark, "arrivals"), scratch_path(t.spark, "late")
    events, report = t.table("events"), None
    for slot in range(5):
        events.filter(F.col("event_id") % 5 == slot).write.mode("append").parquet(f"{folder}/events.parquet")
        positions = topics.read_stream(t.spark, "flight-position", folder)
        report = jobs.late_report(positions, target=target)
    return report


@query
def stream_late_dropped(t: Feed) -> DataFrame:
    """The same five landings, with what the engine itself says it dropped behind the watermark."""
    folder, target = scratch_path(t.spark, "arrivals"), scratch_path(t.spark, "deduplicated")
    reports, events = scratch_path(t.spark, "dropped"), t.table("events")
    for slot in range(5):
        events.filter(F.col("event_id") % 5 == slot).write.mode("append").parquet(f"{folder}/events.parquet")
        arrived = late.observed(topics.read_stream(t.spark, "flight-position", folder), "position_time")
        late.run_with_report(jobs.deduplicated(arrived), "late-dropped", target, f"{reports}/landing={slot}")
    told = late.read_report(t.spark, reports).withColumn("batch", F.col("landing").cast("bigint"))
    return told.select("batch", "rows", F.col("dropped").alias("late"), "max_time")


# features, models, drift


@query
def delay_features(t: Feed) -> DataFrame:
    return features.delay_features(t.flights, t.weather)


def _delay_model(t: Feed):
    rows = written(models.model_rows(features.delay_features(t.flights, t.weather)), "model-rows")
    train, test = models.split_by_time(rows)
    return models.fit(train), test, train


@query
def delay_model_score(t: Feed) -> DataFrame:
    model, test, _ = _delay_model(t)
    return models.score(model, test)


@query
def delay_feature_importance(t: Feed) -> DataFrame:
    model, test, _ = _delay_model(t)
    return models.permutation_importance(model, test)


@query
def delay_feature_shapley(t: Feed) -> DataFrame:
    """How much each input moves the predictions of the later flights, by exact Shapley values."""
    model, test, train = _delay_model(t)
    return shapley.by_feature(models.shapley_rows(model, test, train), models.INPUTS)


@query
def isolation_forest_score(t: Feed) -> DataFrame:
    columns = ["baro_altitude", "velocity", "vertical_rate", "alt_up", "alt_dn", "vel_up", "vel_dn"]
    return forest.isolation_scores(cep.sample_changes(t.positions), "position_id", columns)


@query
def drift_psi(t: Feed) -> DataFrame:
    later = F.col("position_time") >= F.lit("2024-01-01 00:24:00").cast("timestamp")
    return features.drift_psi(t.positions, later, DRIFT_RANGES)


@query
def drift_psi_sketched(t: Feed) -> DataFrame:
    """The same drift from sketches per minute, with the shares below each bin edge measured against all rows."""
    minute = F.date_trunc("minute", "position_time")
    stored = written(sketches.feature_sketches(t.positions, minute, list(DRIFT_RANGES)), "feature-sketches")
    since = F.lit("2024-01-01 00:24:00").cast("timestamp")
    told = sketches.drift(stored, F.col("period") >= since, DRIFT_RANGES)
    exact = sketches.counted_below(t.positions, F.col("position_time") >= since, DRIFT_RANGES)
    bound = F.lit(2 * sketches.rank_error())
    near = lambda a, b: F.forall(F.zip_with(a, b, lambda x, y: F.abs(x - y) <= bound), lambda ok: ok)
    return lookup_join(told, exact, ["feature"], counted=told).select(
        "feature",
        "ref_rows",
        "cur_rows",
        near("ref_below", "ref_exact").alias("ref_in_bound"),
        near("cur_below", "cur_exact").alias("cur_in_bound"),
    )


@query
def model_metrics(t: Feed) -> DataFrame:
    """The per-origin mean of the flights before 1999, judged on the later ones."""
    delays = joins.with_delays(t.flights)
    cut = F.lit("1999-01-01").cast("timestamp")
    train, test = delays.filter(F.col("scheduled_dep_time") < cut), delays.filter(F.col("scheduled_dep_time") >= cut)
    return features.model_metrics(features.mean_by_origin(train, test))


# retrieval


@query
def rag_chunks(t: Feed) -> DataFrame:
    return retrieval.chunks(t.table("documents"))


@query
def rag_topk(t: Feed) -> DataFrame:
    vectors = t.table("embeddings")
    best = retrieval.top_passages(vectors, retrieval.label_centroids(vectors), 5)
    return best.withColumn("score", F.round("score", 4))


@query
def rag_index_recall(t: Feed) -> DataFrame:
    """The vector index asked with every twentieth vector, held against the exact search."""
    vectors = t.table("embeddings")
    asked = vectors.filter("vec_id % 20 = 0").select(
        F.col("vec_id").alias("query_id"), F.col("embedding").cast("array<double>").alias("vector")
    )
    exact = retrieval.top_passages(vectors, asked, 5).select("query_id", "vec_id", F.lit(True).alias("exact"))
    found = index.search(vectors, asked, 5).select("query_id", "vec_id", F.lit(True).alias("found"))
    both = exact.join(found, ["query_id", "vec_id"], "full")
    return both.groupBy("query_id").agg(
        F.count("exact").alias("hits"), F.count_if(F.col("exact") & F.col("found")).alias("found")
    )


@query
def anomaly_prompt_table(t: Feed) -> DataFrame:
    """Anomalies with flight, weather at departure and passages; each event type asks with its topic's vector."""
    vectors = t.table("embeddings")
    asked = adapters.event_topics(t.spark)
    queries = retrieval.label_centroids(vectors).join(F.broadcast(asked.select("query_id")), "query_id", "left_semi")
    # used for the choice of chunks and for the passages
    best = written(retrieval.top_passages(vectors, queries, 3), "best-passages")
    texts = retrieval.central_chunks(best, t.table("documents"))
    passages = retrieval.passages_by_topic(asked, best, texts)
    flights = joins.weather_before(
        t.flights.select("flight_id", "carrier_code", "origin_airport", "dest_airport", "scheduled_dep_time"),
        t.weather,
        ["wind_speed_knots", "visibility_miles"],
    ).drop("scheduled_dep_time")
    tied = lookup_join(t.anomalies, flights, ["flight_id"], small_rows=0)
    # the record is read once for both fields
    wanted = "flight struct<dest_airport: string>, passage_texts array<string>"
    records = retrieval.grounding_records(tied, passages).withColumn("told", F.from_json("grounding", wanted))
    return records.select(
        "event_id",
        "event_type",
        "severity",
        "flight_id",
        "origin_airport",
        "observed_at",
        "wind_speed_knots",
        F.array_join(F.col("passages").cast("array<string>"), ",").alias("passage_ids"),
        F.col("told.flight.dest_airport").alias("grounded_dest"),
        F.get("told.passage_texts", 0).alias("first_passage"),
        "llm_explanation",
        "response_procedure",
    )


# training pairs


@query
def transcript_clean(t: Feed) -> DataFrame:
    return pairs.clean_transcripts(t.table("conversations"))


@query
def sft_pairs(t: Feed) -> DataFrame:
    return pairs.answer_pairs(pairs.clean_transcripts(t.table("conversations")))


@query
def dpo_pairs(t: Feed) -> DataFrame:
    return pairs.preference_pairs(t.table("documents"), t.table("labels"))
