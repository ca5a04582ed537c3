from decimal import Decimal as D

import pytest
from pyspark.sql import functions as F

from contrail.functions.geo import arc_km, leg, off_route_km, unit_vector
from contrail.operators import cep

BASE = 1_704_067_200_000_000


def samples(spark, rows):
    """Rows of (aircraft, id, seconds, altitude, speed)."""
    data = [(i, a, BASE + int(s * 1_000_000), None if h is None else D(str(h)), None if v is None else D(str(v))) for a, i, s, h, v in rows]
    df = spark.createDataFrame(
        data, "position_id bigint, icao24 string, t bigint, baro_altitude decimal(8,2), velocity decimal(7,2)"
    )
    return df.withColumn("position_time", F.timestamp_micros("t")).drop("t")


def ids(df):
    return sorted(r["position_id"] for r in df.collect())


def test_altitude_limit_and_window_are_inclusive(spark):
    rows = [
        ("a", 1, 0, 0, 0), ("a", 2, 30, 152.40, 0),
        ("b", 3, 0, 0, 0), ("b", 4, 30, 152.39, 0),
        ("c", 5, 0, 0, 0), ("c", 6, 30.001, 152.40, 0),
        ("d", 7, 0, 200, 0), ("d", 8, 10, None, 0), ("d", 9, 20, 10, 0),
    ]
    assert ids(cep.altitude_spikes(cep.sample_changes(samples(spark, rows)))) == [2, 9]


def test_velocity_both_signs(spark):
    rows = [("a", 1, 0, 0, 100), ("a", 2, 60, 0, 48.55), ("b", 3, 0, 0, 0), ("b", 4, 60, 0, 51.45), ("c", 5, 0, 0, 0), ("c", 6, 60, 0, 51.44)]
    assert ids(cep.velocity_spikes(cep.sample_changes(samples(spark, rows)))) == [2, 4]


def test_buckets_do_not_change_results(spark):
    rows = [(f"a{i % 3}", i, i * 7.3, (i * 37) % 400, (i * 53) % 120) for i in range(300)]
    df = samples(spark, rows)
    whole = cep.sample_changes(df, bucket_s=1_000_000)
    cut = cep.sample_changes(df, bucket_s=60)
    for rule in (cep.altitude_spikes, cep.velocity_spikes):
        key = ["position_id", "d_up", "d_dn"]
        assert sorted(map(tuple, rule(cut).select(key).collect())) == sorted(map(tuple, rule(whole).select(key).collect()))


def test_repeated_samples_hit_once(spark):
    rows = [("a", 1, 0, 0, 0)] + [("a", i, 10, 500, 0) for i in range(2, 50)]
    assert ids(cep.altitude_spikes(cep.sample_changes(samples(spark, rows)))) == [2]


def _off(spark, p, s, e):
    v = lambda x: unit_vector(F.lit(x[0]), F.lit(x[1]))
    return spark.range(1).select(off_route_km(v(p), leg(v(s), v(e))).alias("km")).first()["km"]


def test_off_route_distance(spark):
    degree = 111.195
    assert _off(spark, (1.0, 5.0), (0.0, 0.0), (0.0, 10.0)) == pytest.approx(degree, abs=0.01)
    assert _off(spark, (0.0, -2.0), (0.0, 0.0), (0.0, 10.0)) == pytest.approx(2 * degree, abs=0.01)
    assert _off(spark, (0.0, 13.0), (0.0, 0.0), (0.0, 10.0)) == pytest.approx(3 * degree, abs=0.01)
    assert _off(spark, (1.0, 0.0), (0.0, 0.0), (0.0, 0.0)) == pytest.approx(degree, abs=0.01)
    assert _off(spark, (0.0, 5.0), (0.0, 0.0), (0.0, 10.0)) == pytest.approx(0, abs=1e-6)


AIRPORTS = [("A", 37.0, 127.0), ("B", -89.5, 10.0), ("C", 0.0, 179.9), ("D", 89.0, -60.0), ("E", 37.0, 127.5)]


def airports(spark):
    return spark.createDataFrame(AIRPORTS, "airport_code string, latitude double, longitude double")


def test_nearest_airport_equals_brute_force(spark):
    places = spark.range(400).select(
        F.col("id").alias("position_id"),
        (F.col("id") * 7919 % 1801 / 10 - 90).alias("latitude"),
        (F.col("id") * 104729 % 3600 / 10 - 180).alias("longitude"),
    )
    pairs = places.crossJoin(F.broadcast(airports(spark).toDF("code", "alat", "alon")))
    km = F.round(arc_km(unit_vector(F.col("latitude"), F.col("longitude")), unit_vector(F.col("alat"), F.col("alon"))), 3)
    best = pairs.groupBy("position_id").agg(F.min(F.struct(km.alias("km"), "code")).alias("b"))
    wanted = {r["position_id"]: (r["b"]["code"], r["b"]["km"]) for r in best.collect()}
    found = cep.nearest_airport(places, airports(spark)).collect()
    assert len(found) == 400
    wrong = [r for r in found if (r["nearest_code"], r["nearest_km"]) != wanted[r["position_id"]]]
    assert wrong == []


def test_nearest_airport_tie_and_missing_place(spark):
    df = spark.createDataFrame([(1, 37.0, 127.25), (2, None, 1.0)], "position_id int, latitude double, longitude double")
    rows = {r["position_id"]: r["nearest_code"] for r in cep.nearest_airport(df, airports(spark)).collect()}
    assert rows == {1: "A", 2: None}


def test_route_deviation_needs_a_flight(spark):
    flights = spark.createDataFrame([(1, "A", "E")], "flight_id bigint, origin_airport string, dest_airport string")
    df = spark.createDataFrame(
        [(1, 1, 38.0, 127.2), (2, None, 38.0, 127.2), (3, 1, 37.0, 127.2)],
        "position_id bigint, flight_id bigint, latitude double, longitude double",
    )
    assert ids(cep.route_deviations(df, flights, airports(spark))) == [1]


def test_severity_steps(spark):
    values = [D("152.40"), D("228.59"), D("228.60"), D("304.80"), D("457.20")]
    df = spark.createDataFrame([(v,) for v in values], "m decimal(8,2)")
    got = [r[0] for r in df.select(cep.severity(F.col("m"), F.lit(cep.ALTITUDE_M))).collect()]
    assert got == ["LOW", "LOW", "MEDIUM", "HIGH", "CRITICAL"]
