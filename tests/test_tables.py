from pyspark.sql import functions as F

from contrail.operators import quality, serving, upkeep
from contrail.operators.joins import with_delays
from contrail.schemas import ANOMALIES, POSITIONS, SEVERITIES, WEATHER


def test_explicit_null_stays_omitted_gets_default(spark):
    now = F.lit("2024-01-01").cast("timestamp")
    given = spark.createDataFrame([(1, "a", None)], "event_id bigint, icao24 string, severity string")
    row = upkeep.apply_defaults(given, ANOMALIES, now).first()
    assert row["severity"] is None and row["is_resolved"] is False and row["description"] is None
    row = upkeep.apply_defaults(given.drop("severity"), ANOMALIES, now).first()
    assert row["severity"] == "LOW" and str(row["detected_at"]) == "2024-01-01 00:00:00"


def test_insert_ignore_keeps_first_of_repeats(spark):
    target = spark.createDataFrame([("KE", "old")], "k string, v string")
    batch = spark.createDataFrame([("KE", "new"), ("OZ", "b"), ("OZ", "a")], "k string, v string")
    assert sorted(map(tuple, upkeep.insert_ignore(target, batch, ["k"], ["v"]).collect())) == [("KE", "old"), ("OZ", "a")]


def test_seeds_are_stable(spark):
    seeds = upkeep.seed_airports(spark)
    assert upkeep.insert_ignore(seeds, seeds, ["airport_code"], ["airport_name"]).count() == 6
    assert str(seeds.filter("airport_code = 'RKSI'").first()["latitude"]) == "37.460200"


def test_rejects_overflow_and_text(spark):
    raw = spark.createDataFrame(
        [("1", "40000", "1.5", "M"), ("2", "-32768", "1000", "3"), ("3", None, "999.99", "3")],
        "obs_id string, wind_direction_deg string, visibility_miles string, ceiling_ft string",
    )
    typed, rejects = quality.typed_load(raw, WEATHER)
    assert sorted(map(tuple, rejects.collect())) == [
        ("1", "ceiling_ft", "M"), ("1", "wind_direction_deg", "40000"), ("2", "visibility_miles", "1000"),
    ]
    assert [r["wind_direction_deg"] for r in typed.orderBy("obs_id").collect()] == [None, -32768, None]


def test_length_and_enum_rows(spark):
    df = spark.createDataFrame([("12345",), ("1234",), (None,)], "squawk string")
    assert quality.too_long(df, POSITIONS).first()["failed"] == 1
    df = spark.createDataFrame([("LOW", "altitude_spike"), ("SEVERE", "x")], "severity string, event_type string")
    assert {r["column"]: r["failed"] for r in quality.outside_enum(df, ANOMALIES).collect()} == {"severity": 1, "event_type": 1}


def test_severity_sorts_by_rank(spark):
    df = spark.createDataFrame(
        [(i, s, False) for i, s in enumerate(SEVERITIES)], "event_id int, severity string, is_resolved boolean"
    ).withColumn("detected_at", F.lit("2024-01-01").cast("timestamp"))
    assert [r["severity"] for r in serving.open_queue(df).collect()] == SEVERITIES[::-1]
    assert [r["severity"] for r in serving.most_severe(df, 2).collect()] == ["CRITICAL", "HIGH"]


def test_gate_upsert_last_published_wins(spark):
    t = lambda s: f"2024-01-01 00:{s}:00"
    flights = spark.createDataFrame([(1, None, None), (2, None, None)], "flight_id bigint, actual_dep_time string, actual_arr_time string")
    flights = flights.select("flight_id", *[F.col(c).cast("timestamp") for c in ("actual_dep_time", "actual_arr_time")])
    gate = spark.createDataFrame(
        [(1, "departure", t("10"), t("10")), (1, "departure", t("05"), t("20"))],
        "flight_id bigint, gate_event string, event_time string, published_at string",
    ).select("flight_id", "gate_event", *[F.col(c).cast("timestamp") for c in ("event_time", "published_at")])
    rows = {r["flight_id"]: r for r in upkeep.gate_upsert(flights, gate).collect()}
    assert str(rows[1]["actual_dep_time"]) == "2024-01-01 00:05:00" and rows[1]["actual_arr_time"] is None
    assert rows[2]["actual_dep_time"] is None


def test_delay_is_floored_and_unknown_is_null(spark):
    df = spark.sql(
        "SELECT timestamp'2024-01-01 00:10:00' scheduled_dep_time, timestamp'2024-01-01 00:09:30' actual_dep_time,"
        " timestamp'2024-01-01 01:00:00' scheduled_arr_time, cast(null AS timestamp) actual_arr_time"
    )
    row = with_delays(df).first()
    assert (row["dep_delay_min"], row["arr_delay_min"]) == (-1, None)


def test_one_day_reads_one_partition(spark, tmp_path):
    df = spark.range(1000).select(
        F.col("id").alias("position_id"),
        F.lit("a").alias("icao24"),
        F.timestamp_seconds(F.lit(1_704_067_200) + F.col("id") * 600).alias("position_time"),
    )
    upkeep.write_by_date(df, str(tmp_path / "p"))
    day = upkeep.read_day(spark, str(tmp_path / "p"), "2024-01-02")
    assert day.count() == 144
    plan = day._jdf.queryExecution().toString()
    assert "PartitionFilters: [isnotnull(position_date" in plan
