import numpy as np
import pytest
from pyspark.sql import functions as F

from contrail.operators import features, sketches


@pytest.fixture(scope="module")
def delays(spark):
    """One carrier owns a third of the flights; ties, nulls and a carrier without any known delay."""
    rng = np.random.default_rng(7)
    rows = []
    for n in range(30_000):
        carrier = "hot" if n % 3 == 0 else f"c{n % 7}"
        delay = None if n % 50 == 0 else int(rng.gamma(2.0, 20.0)) - 20
        rows.append((carrier, f"2024-{n % 4 + 1:02}", n % 28, delay))
    rows += [("mute", "2024-01", 1, None)]
    return spark.createDataFrame(rows, "carrier string, month string, day int, delay int").repartition(6)


def test_merged_sketches_stay_within_the_stated_error(spark, delays, tmp_path):
    path = str(tmp_path / "store")
    sketches.store(sketches.day_sketches(delays, ["carrier", "month", "day"], "delay", k=256), path, "month")
    answers = sketches.figures(sketches.merge(spark.read.parquet(path), ["carrier"], k=256), ["carrier"]).cache()
    asked = {"median_delay": 0.5, "p90_delay": 0.9}
    errors = sketches.measured(delays, answers, ["carrier"], "delay", asked).collect()
    assert {r["carrier"] for r in errors} == {"hot", *[f"c{n}" for n in range(7)]}
    worst = max(max(r["median_delay_error"], r["p90_delay_error"]) for r in errors)
    assert worst <= 2 * sketches.rank_error(256)
    known = delays.toPandas().dropna()
    for r in answers.collect():
        own = known[known.carrier == r["carrier"]].delay
        assert r["flights"] == len(own) and abs(r["mean_delay"] - own.mean()) < 1e-5
        assert abs(r["late_share"] - (own >= 15).mean()) < 1e-5
        # the plain check of the measured error
        below, to = (own < r["p90_delay"]).mean(), (own <= r["p90_delay"]).mean()
        wanted = max(0.0, below - 0.9, 0.9 - to)
        got = next(e["p90_delay_error"] for e in errors if e["carrier"] == r["carrier"])
        assert abs(got - wanted) < 1e-9
    assert max(r["size"] for r in sketches.merge(spark.read.parquet(path), ["carrier"], k=256).select(F.length("sketch").alias("size")).collect()) < 256 * 8 * 4


def test_a_repeated_period_is_replaced_and_others_stay(spark, delays, tmp_path):
    path, by = str(tmp_path / "store"), ["carrier", "month", "day"]
    for months in (["2024-01", "2024-02"], ["2024-02", "2024-03", "2024-04"], ["2024-02"]):
        sketches.store(sketches.day_sketches(delays.filter(F.col("month").isin(months)), by, "delay"), path, "month")
    n = spark.read.parquet(path).agg(F.sum("n")).first()[0]
    assert n == delays.filter("delay IS NOT NULL").count()


def test_small_groups_are_exact(spark):
    df = spark.createDataFrame([("a", v) for v in (5, 1, 3, 3, 9)], "carrier string, delay int")
    got = sketches.figures(sketches.day_sketches(df, ["carrier"], "delay"), ["carrier"]).first()
    assert (got["median_delay"], got["p90_delay"], got["flights"], got["late_share"]) == (3.0, 9.0, 5, 0.0)


def test_no_rows(spark):
    df = spark.createDataFrame([], "carrier string, delay int")
    assert sketches.figures(sketches.merge(sketches.day_sketches(df, ["carrier"], "delay"), ["carrier"]), ["carrier"]).count() == 0


def test_drift_from_sketches_follows_the_exact_one(spark):
    rng = np.random.default_rng(3)
    rows = [(int(i // 5000), float(rng.normal(5 + (i >= 20_000), 2)), None if i % 9 == 0 else float(i % 10)) for i in range(40_000)]
    df = spark.createDataFrame(rows, "day int, x double, y double")
    ranges, current = {"x": (0.0, 10.0), "y": (0.0, 10.0)}, F.col("day") >= 4
    stored = sketches.feature_sketches(df, F.col("day"), ["x", "y"]).withColumnRenamed("period", "day")
    exact = {r["feature"]: r for r in features.drift_psi(df, current, ranges).collect()}
    counted = {r["feature"]: r for r in sketches.counted_below(df, current, ranges).collect()}
    for r in sketches.drift(stored, current, ranges).collect():
        wanted = exact[r["feature"]]
        assert (r["ref_rows"], r["cur_rows"]) == (wanted["ref_rows"], wanted["cur_rows"])
        assert abs(r["psi"] - wanted["psi"]) < 0.02
        for side in ("ref", "cur"):
            off = np.abs(np.array(r[f"{side}_below"]) - np.array(counted[r["feature"]][f"{side}_exact"]))
            assert off.max() <= 2 * sketches.rank_error()


def test_drift_with_an_empty_side(spark):
    df = spark.createDataFrame([(0, float(i)) for i in range(10)], "day int, x double")
    stored = sketches.feature_sketches(df, F.col("day"), ["x"]).withColumnRenamed("period", "day")
    got = sketches.drift(stored, F.col("day") >= 1, {"x": (0.0, 10.0)}).first()
    wanted = features.drift_psi(df, F.col("day") >= 1, {"x": (0.0, 10.0)}).first()
    assert (got["ref_rows"], got["cur_rows"], got["cur_below"]) == (10, 0, None) and abs(got["psi"] - wanted["psi"]) < 1e-5
