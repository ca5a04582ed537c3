import os

import pytest
from pyspark.sql import functions as F

from contrail.streaming import jobs, late, topics

SF = "/root/testdata/sf0.001"


def land(spark, folder, slot):
    events = spark.read.parquet(f"{SF}/events.parquet").filter(F.col("event_id") % 5 == slot)
    events.write.mode("append").parquet(f"{folder}/events.parquet")


def arrived(spark, folder):
    return late.observed(topics.read_stream(spark, "flight-position", folder), "position_time")


def test_engine_figures_equal_the_computed_report_over_restarts(spark, tmp_path):
    folder, out, report = (str(tmp_path / n) for n in ("in", "out", "report"))
    for slot in range(5):
        land(spark, folder, slot)
        told = late.run_with_report(jobs.deduplicated(arrived(spark, folder)), "late-test", out, report)
        wanted = jobs.late_report(
            topics.read_stream(spark, "flight-position", folder), target=f"{tmp_path}/computed", checkpoint=f"{tmp_path}/cp"
        )
    got = [(r["rows"], r["dropped"], r["max_time"]) for r in told.orderBy("batch").collect()]
    assert got == [(r["rows"], r["late"], r["max_time"]) for r in wanted.orderBy("batch").collect()]
    assert len(got) == 5 and got[0][1] == 0 and all(dropped > 100 for _, dropped, _ in got[1:])
    # what was not dropped is in the table
    assert spark.read.parquet(out).count() == sum(rows - dropped for rows, dropped, _ in got)
    # nothing new: no batch, the same report
    again = late.run_with_report(jobs.deduplicated(arrived(spark, folder)), "late-test", out, report)
    assert again.count() == 5


def test_other_queries_are_not_counted(spark, tmp_path):
    folder = str(tmp_path / "in")
    land(spark, folder, 0)
    listener = late.LateRows(spark, "mine", str(tmp_path / "report"))
    spark.streams.addListener(listener)
    try:
        late.run_with_report(jobs.deduplicated(arrived(spark, folder)), "theirs", f"{tmp_path}/o", f"{tmp_path}/r")
    finally:
        spark.streams.removeListener(listener)
    assert not listener.ended.is_set() and not os.path.exists(tmp_path / "report")
    assert late.read_report(spark, f"{tmp_path}/r").agg(F.sum("rows")).first()[0] == 200


def test_a_report_that_cannot_be_written_is_an_error(spark, tmp_path):
    folder, blocked = str(tmp_path / "in"), tmp_path / "file"
    land(spark, folder, 0)
    blocked.write_text("not a folder")
    with pytest.raises(Exception):
        late.run_with_report(jobs.deduplicated(arrived(spark, folder)), "blocked", f"{tmp_path}/o", f"{blocked}/report")


def test_positions_meet_the_weather_of_their_flights_airport(spark, tmp_path):
    flights = spark.createDataFrame(
        [(1, "A", "B", "2024-01-01 10:00:00", "2024-01-01 12:00:00")], "flight_id bigint, o string, d string, s string, e string"
    ).selectExpr("flight_id", "o AS origin_airport", "d AS dest_airport", "timestamp(s) AS scheduled_dep_time", "timestamp(e) AS scheduled_arr_time")
    seen = [(1, 1, "11:00:00"), (2, 1, "11:00:01"), (3, None, "11:00:00"), (4, 9, "11:00:00"), (5, 1, None)]
    positions = spark.createDataFrame(seen, "position_id bigint, flight_id bigint, t string").selectExpr(
        "position_id", "flight_id", "timestamp('2024-01-01 ' || t) AS position_time"
    )
    readings = [("A", "10:00:00"), ("A", "11:00:00"), ("A", "11:00:00"), ("A", "09:59:59"), ("B", "10:30:00"), ("B", "11:00:02"), (None, "10:30:00")]
    weather = spark.createDataFrame(readings, "airport_code string, t string").selectExpr(
        "airport_code", "timestamp('2024-01-01 ' || t) AS observed_at"
    )
    positions.write.parquet(f"{tmp_path}/positions.parquet")
    weather.write.parquet(f"{tmp_path}/weather.parquet")
    streams = [topics.stream_files(spark, str(tmp_path), name) for name in ("positions", "weather")]
    got = topics.run_to_table(jobs.positions_with_weather(streams[0], flights, streams[1]), "pw", f"{tmp_path}/out", f"{tmp_path}/cp")
    found = {(r["position_id"], r["airport_code"], str(r["observed_at"])[11:]) for r in got.collect()}
    assert found == {(1, "A", "10:00:00"), (1, "A", "11:00:00"), (2, "B", "10:30:00")} and got.count() == 3
