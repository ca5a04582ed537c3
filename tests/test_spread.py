import bisect
import random

import pytest
from pyspark.sql import functions as F

from contrail import session
from contrail.operators import joins, spread
from contrail.operators.upkeep import assign_ids

BASE = 1_704_067_200


def at(column):
    return F.timestamp_micros(F.col(column) + BASE * 1_000_000)


@pytest.mark.parametrize("bucket_s", [7, 3600, 1_000_000])
def test_best_interval_equals_brute_force(spark, bucket_s):
    rng = random.Random(5)
    second = 1_000_000
    flights = [
        (f"k{rng.randrange(3)}", i, s := rng.randrange(3000) * second + rng.choice([0, 1, 500_000]), s + rng.randrange(900) * second)
        for i in range(150)
    ]
    flights += [("k0", 900, 50, 40), ("k1", 901, flights[0][2], flights[0][3]), (None, 902, 0, 10**9)]
    points = [(f"k{rng.randrange(4)}", i, rng.randrange(4000 * second)) for i in range(500)]
    points += [(k, 1000 + i, t + d) for i, (k, _, s, e) in enumerate(flights[:60]) for t in (s, e) for d in (-1, 0, 1)]
    points += [(None, 9000, 5), ("k0", 9001, None)]
    f = spark.createDataFrame(flights, "k string, v bigint, s bigint, e bigint").select("k", "v", at("s").alias("s"), at("e").alias("e"))
    p = spark.createDataFrame(points, "k string, id bigint, t bigint").select("k", "id", "t", at("t").alias("time"))
    found = spread.best_interval(p, f, "k", "time", "s", "e", "v", bucket_s).collect()
    assert len(found) == len(points)
    for r in found:
        inside = [(s, v) for key, v, s, e in flights if r["t"] is not None and key == r["k"] and s <= r["t"] <= e and key]
        assert r["v"] == (max(inside)[1] if inside else None), r


def test_positions_before_and_after_the_flight_stay_free(spark):
    f = spark.sql("""SELECT 'a' AS icao24, 7L AS flight_id, timestamp'2024-01-01 10:00:30' AS actual_dep_time,
        timestamp'2024-01-01 11:00:30' AS actual_arr_time, null AS scheduled_dep_time, null AS scheduled_arr_time""")
    p = spark.sql("""SELECT * FROM VALUES (1L, 'a', timestamp'2024-01-01 10:00:10'), (2L, 'a', timestamp'2024-01-01 10:00:30'),
        (3L, 'a', timestamp'2024-01-01 11:00:30'), (4L, 'a', timestamp'2024-01-01 11:00:50') AS t(position_id, icao24, position_time)""")
    found = joins.attach_flights(p, f)
    assert {r["position_id"]: r["flight_id"] for r in found.collect()} == {1: None, 2: 7, 3: 7, 4: None}


def test_last_known_equals_brute_force(spark):
    rng = random.Random(6)
    facts = [(f"k{rng.randrange(3)}", i, rng.randrange(40) * 40_000) for i in range(80)]
    probes = [(f"k{rng.randrange(4)}", rng.randrange(45) * 40_000 + rng.choice([0, 1])) for _ in range(300)]
    f = spark.createDataFrame(facts, "k string, n bigint, t bigint").select(
        "k", "n", F.struct("n").alias("v"), F.timestamp_seconds(F.col("t") + BASE).alias("ft")
    )
    p = spark.createDataFrame(probes, "k string, t bigint").select("k", F.timestamp_seconds(F.col("t") + BASE).alias("pt"))
    wanted = {}
    for k, t in probes:
        past = [(ft, n) for key, n, ft in facts if key == k and ft <= t]
        wanted[(k, t)] = max(past)[1] if past else None
    rows = spread.last_known(p, f, "k", "pt", "ft", "v", "n").select("k", F.unix_seconds("pt").alias("t"), "v.n").collect()
    assert {(r["k"], r["t"] - BASE): r["n"] for r in rows} == wanted
    assert len(rows) == len(wanted)


def test_lookup_join_ways_agree(spark):
    facts = spark.range(500).select("id", F.when(F.col("id") % 3 != 0, F.col("id") % 7).alias("k")).withColumn(
        "k", F.when(F.col("id") < 200, F.lit(1)).otherwise(F.col("k"))
    )
    unique = spark.range(5).select(F.col("id").alias("k"), (F.col("id") * 10).alias("v"))
    rows = lambda df: sorted(map(str, df.select("id", "k", "v").collect()))
    for how in ("left", "inner"):
        plain = rows(facts.join(unique, "k", how))
        assert rows(spread.lookup_join(facts, unique, ["k"], how)) == plain
        assert rows(spread.lookup_join(facts, unique, ["k"], how, small_rows=0)) == plain


def test_dense_ids_do_not_depend_on_partitions(spark):
    df = spark.range(1000).select((F.col("id") * 7919 % 1000).alias("a"))
    before = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        for parts in ("1", "7"):
            spark.conf.set("spark.sql.shuffle.partitions", parts)
            rows = assign_ids(df, "n", ["a"]).collect()
            assert sorted((r["a"], r["n"]) for r in rows) == [(i, i + 1) for i in range(1000)]
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_halo_shows_each_row_once(spark):
    df = spark.range(200).select("id", F.timestamp_seconds(F.col("id") * 17 + BASE).alias("t"))
    cut = spread.with_halo(df, "t", 100, 60)
    assert cut.filter("NOT is_context").count() == 200
    own = [r["id"] * 17 for r in cut.filter("is_context").collect()]
    assert all((s // 100 + 1) * 100 - s <= 60 for s in own)
    assert bisect.bisect(sorted(own), 0) <= 1


class _NoSetting:
    class conf:
        @staticmethod
        def get(key, default):
            return default

    class sparkContext:
        master = "yarn"


def test_shared_folder_is_required_on_a_cluster(spark):
    with pytest.raises(ValueError):
        session.shared_dir(_NoSetting)
    _NoSetting.sparkContext.master = "local[2]"
    assert session.shared_dir(_NoSetting) == session.shared_dir(_NoSetting)


@pytest.mark.parametrize("how", ["left", "inner"])
def test_a_side_that_was_not_counted_small_is_shuffled(spark, tmp_path, how):
    """However small its compressed files are: the driver must not gather it."""
    spark.range(5000).selectExpr("id AS k", "repeat('x', 50) AS v").write.parquet(f"{tmp_path}/unique")
    facts = spark.range(6000).selectExpr("CASE WHEN id % 7 != 0 THEN id END AS k", "id AS f")
    unique = spark.read.parquet(f"{tmp_path}/unique")
    joined = spread.lookup_join(facts, unique, ["k"], how, small_rows=4999)
    assert "BroadcastHashJoin" not in joined._jdf.queryExecution().sparkPlan().toString()
    assert joined.filter("v IS NOT NULL").count() == 5000 - 715
    assert joined.count() == (6000 if how == "left" else 4285)
    stream = spark.readStream.format("rate").load().selectExpr("value AS k")
    for rows in (0, 4999):
        met = spread.lookup_join(stream, unique, ["k"], how, small_rows=rows)
        assert "strategy=merge" in met._jdf.queryExecution().analyzed().toString()
    small = spread.lookup_join(facts, unique, ["k"], how)
    assert "BroadcastHashJoin" in small._jdf.queryExecution().sparkPlan().toString()
