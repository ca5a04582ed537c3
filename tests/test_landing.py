import json

from pyspark.sql import functions as F

from contrail.functions.metar import with_metar_columns
from contrail.sources import landing


def landed(spark, *bodies):
    return spark.createDataFrame(list(enumerate(bodies)), "snapshot_id bigint, body string")


def state(**given):
    values = [given.get(name) for name, _ in landing.STATE_FIELDS]
    return values


def snapshot(*states, time=1_700_000_000):
    return json.dumps({"time": time, "states": list(states)}, ensure_ascii=False)


def test_snapshot_without_states_gives_no_rows(spark):
    df = landed(spark, '{"time": 5, "states": null}', '{"time": 5}')
    assert landing.flatten_states(df).count() == 0
    assert [r["aircraft"] for r in landing.snapshot_summary(df).collect()] == [0, 0]


def test_missing_time_is_1970(spark):
    row = landing.snapshot_summary(landed(spark, '{"states": []}')).first()
    assert row["response_time"] == "1970-01-01 00:00:00 UTC"


def test_long_and_short_state_rows(spark):
    long = state(icao24="aa") + ["extra"]
    rows = landing.flatten_states(landed(spark, snapshot(long, ["bb", "KAL1", "대한민국"]))).orderBy("pos").collect()
    assert rows[0]["icao24"] == "aa" and "extra" not in rows[0].asDict().values()
    assert rows[1]["origin_country"] == "대한민국"
    assert rows[1]["latitude"] is None and rows[1]["position_source"] is None


def test_typed_fields(spark):
    s = state(icao24="aa", longitude=126.5, latitude=37.25, sensors=[1, 2], on_ground=True, velocity=230.5)
    row = landing.flatten_states(landed(spark, snapshot(s))).first()
    assert row["sensors"] == [1, 2] and row["on_ground"] is True
    assert (str(row["longitude"]), str(row["latitude"]), str(row["velocity"])) == ("126.500000", "37.250000", "230.50")


def test_quarantine_splits_bad_documents_and_states(spark):
    good = state(icao24="aa", last_contact=10)
    df = landed(spark, snapshot(good, [], None, state(icao24="bb")), "{not json", snapshot(good)[:-6])
    kept, rejects = landing.quarantine(df)
    assert [r["icao24"] for r in kept.collect()] == ["aa"]
    reasons = sorted((r["snapshot_id"], r["pos"] or 0, r["reason"]) for r in rejects.collect())
    assert reasons == [
        (0, 1, "no aircraft code"),
        (0, 2, "no aircraft code"),
        (0, 3, "no position time"),
        (1, 0, "broken document"),
        (2, 0, "broken document"),
    ]


def test_position_time_falls_back_to_last_contact(spark):
    states = [
        state(icao24="aa", time_position=10, last_contact=20, callsign="KAL1    "),
        state(icao24="bb", last_contact=20),
        state(icao24="cc"),
        state(last_contact=20),
    ]
    rows = landing.states_to_positions(landing.flatten_states(landed(spark, snapshot(*states)))).orderBy("icao24").collect()
    assert [(r["icao24"], r["position_time"].second, r["callsign"]) for r in rows] == [("aa", 10, "KAL1"), ("bb", 20, None)]


def test_callsign_display(spark):
    cases = {None: "N/A", "": "N/A", " " * 8: "", "LONGCALL10": "LONGCALL10", "KAL1    ": "KAL1"}
    df = landed(spark, snapshot(*[state(icao24="aa", callsign=c) for c in cases]))
    rows = landing.display_lines(landing.flatten_states(df)).orderBy("pos").collect()
    assert [r["callsign"] for r in rows] == list(cases.values())
    assert "콜사인: N/A      |" in rows[0]["line"] and "콜사인: LONGCALL10 |" in rows[3]["line"]
    assert "위도: None" in rows[0]["line"]


def test_area_edges_are_inside(spark):
    points = [(33.0, 124.0), (38.9, 130.0), (38.900001, 125.0), (35.0, 123.999999), (None, 125.0)]
    df = spark.createDataFrame(points, "latitude double, longitude double").select(
        *[F.col(c).cast("decimal(9,6)") for c in ("latitude", "longitude")]
    )
    assert landing.in_area(df, **landing.AREA).count() == 2


def test_export_keeps_ten_with_nulls_and_hangul(spark, tmp_path):
    states = [state(icao24=f"a{i}", origin_country="대한민국") for i in range(12)]
    df = landed(spark, snapshot(*states), '{"time": 7, "states": []}')
    landing.write_export(df, str(tmp_path / "out"))
    lines = [r["value"] for r in spark.read.text(str(tmp_path / "out")).collect()]
    full = next(x for x in lines if "a0" in x)
    document = json.loads(full)
    assert len(document["states"]) == 10 and "대한민국" in full
    assert list(document["states"][0]) == [n for n, _ in landing.STATE_FIELDS]
    assert document["states"][0]["velocity"] is None
    first = spark.createDataFrame([(x,) for x in lines], "d string").select(landing.first_exported_aircraft("d"))
    assert sorted(r[0] for r in first.collect()) == ["71bf5c", "a0"]
    pretty = landing.pretty(landing.export_documents(df)).filter("snapshot_id = 0").first()["document"]
    assert "\n" in pretty and json.loads(pretty) == document


def test_route_labels_default(spark):
    body = json.dumps([{"icao24": "aa", "estDepartureAirport": None, "estArrivalAirport": "RKSI"}, {"estDepartureAirport": ""}])
    df = spark.createDataFrame([("aa", 0, body)], "icao24 string, batch bigint, body string")
    rows = landing.route_labels(landing.flatten_histories(df)).orderBy("pos").collect()
    assert [r["route"] for r in rows] == ["Unknown → RKSI", "Unknown → Unknown"]


def test_real_metar_forms(spark):
    reports = [
        "METAR RKSI 010000Z 32015G25KT 1 1/2SM -SN SCT010 BKN025 OVC040 M02/M05 A2992",
        "METAR RKSS 010000Z VRB03KT M1/4SM FG OVC002 10/10 A3001",
        "METAR RKPC 010000Z 00000KT 10SM CLR 25/ A2985",
    ]
    df = with_metar_columns(spark.createDataFrame(list(enumerate(reports)), "id int, raw_metar string"))
    rows = [tuple(None if v is None else float(v) for v in r[2:]) for r in df.orderBy("id").collect()]
    assert rows[0] == (320, 15, 1.5, 2500, -2, -5, 29.92)
    assert rows[1] == (None, 3, 0.25, 200, 10, 10, 30.01)
    assert rows[2] == (0, 0, 10, None, 25, None, 29.85)
