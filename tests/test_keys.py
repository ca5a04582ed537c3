"""Keys that outgrow their usual width, parents that repeat, and airports everywhere."""

import math
import random

from pyspark.sql import functions as F

from contrail.operators import cep, quality
from contrail.plans.feed import Feed
from contrail.schemas import FLIGHTS
from contrail.sources import adapters

SF = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_long_user_ids_stay_apart(spark):
    events = spark.read.parquet(f"{SF}/events.parquet")
    ids = [8, 100_000, 1_000_001, 10_000_010, 12_345_678]
    wide = events.limit(200).withColumn("user_id", F.element_at(F.array(*[F.lit(i) for i in ids]), (F.col("event_id") % 5 + 1).cast("int")))
    seen = adapters.positions(wide)
    assert seen.select("icao24").distinct().count() == 5
    assert seen.filter("icao24 = '000008'").count() > 0
    signs = seen.filter("position_id % 10 > 3").select(F.trim("callsign").alias("c"), "icao24").distinct()
    assert signs.count() == signs.select("c").distinct().count()


def test_every_supplier_is_a_carrier(spark):
    supplier = spark.range(5000).select(
        F.col("id").alias("s_suppkey"), F.concat(F.lit("S"), "id").alias("s_name"), (F.col("id") % 25).alias("s_nationkey")
    )
    airlines = adapters.airlines(supplier, spark.read.parquet(f"{SF}/nation.parquet"))
    assert airlines.select("carrier_code").distinct().count() == airlines.count() == 5000


def test_repeated_parents_count_once(spark):
    flights = spark.createDataFrame([("A", "X", "X"), ("B", "X", "Z"), (None, "Y", None)], "carrier_code string, origin_airport string, dest_airport string")
    parents = {
        "airlines": spark.createDataFrame([("A",), ("A",)], "carrier_code string"),
        "airports": spark.createDataFrame([("X",), ("X",), ("X",)], "airport_code string"),
    }
    found = {r["column"]: (r["checked"], r["failed"], r["failed_values"]) for r in quality.orphans(flights, FLIGHTS, parents).collect()}
    assert found == {"carrier_code": (3, 1, 1), "origin_airport": (3, 1, 1), "dest_airport": (3, 1, 1)}


def test_rules_of_a_table_share_a_scan(spark):
    t = Feed(spark, SF)
    assert plan(quality.checks(t.raw_flights, FLIGHTS, "length", "not_null")).count("FileScan") == 1
    assert plan(quality.orphans(t.raw_flights, FLIGHTS, {"airlines": t.airlines, "airports": t.airports})).count("orders.parquet") == 1


def test_all_changes_come_from_one_window(spark):
    t = Feed(spark, SF)
    text = cep.sample_changes(t.positions)._jdf.queryExecution().optimizedPlan().toString()
    assert sum(line.lstrip(" +-:").startswith("Window ") for line in text.split("\n")) <= 2


def test_nearest_airport_among_many(spark):
    rng = random.Random(9)
    land = [(f"C{i}", rng.uniform(-60, 75), rng.uniform(-180, 180)) for i in range(3000)]
    spots = [(i, rng.uniform(-90, 90), rng.uniform(-180, 180)) for i in range(250)]
    spots += [(300, 90.0, 10.0), (301, -90.0, 0.0), (302, 0.0, 180.0), (303, 0.0, -180.0), (304, None, 1.0), (305, -55.0, -130.0)]
    airports = spark.createDataFrame(land, "airport_code string, latitude double, longitude double")
    positions = spark.createDataFrame(spots, "position_id long, latitude double, longitude double")

    def vector(lat, lon):
        a, b = math.radians(lat), math.radians(lon)
        return math.cos(a) * math.cos(b), math.cos(a) * math.sin(b), math.sin(a)

    placed = [(code, vector(lat, lon)) for code, lat, lon in land]
    for r in cep.nearest_airport(positions, airports).collect():
        if r["latitude"] is None:
            assert r["nearest_code"] is None
            continue
        v = vector(r["latitude"], r["longitude"])
        code, best = min(placed, key=lambda p: math.dist(p[1], v))
        assert r["nearest_code"] == code
        assert abs(r["nearest_km"] - 2 * 6371.0088 * math.asin(min(1, math.dist(best, v) / 2))) < 0.002
    cells = positions.filter("latitude IS NOT NULL").select(*[c.alias(n) for c, n in zip(cep._cells(F.col("latitude"), F.col("longitude"), 1), ("_x", "_y"))])
    longest = cep.airport_candidates(airports, cells.distinct()).groupBy("_x", "_y").count().agg(F.max("count")).first()[0]
    assert longest < 300
