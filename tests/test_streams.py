import os

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from contrail.operators import cep, serving
from contrail.sources import adapters
from contrail.streaming import jobs, spikes, topics

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def arrivals(spark, tmp_path_factory):
    """Events in five files; rows come up to nine ids out of order."""
    folder = tmp_path_factory.mktemp("arrivals")
    events = spark.read.parquet(f"{SF}/events.parquet").withColumn(
        "slot", F.floor((F.col("event_id") + F.col("event_id") * 7 % 10) / 205)
    )
    for n in range(5):
        part = str(folder / f"part{n}")
        events.filter(F.col("slot") == n).drop("slot").coalesce(1).write.parquet(part)
        name = next(f for f in os.listdir(part) if f.endswith(".parquet"))
        target = folder / f"events{n}.parquet"
        target.write_bytes((folder / f"part{n}" / name).read_bytes())
        os.utime(target, (1_700_000_000 + n * 10, 1_700_000_000 + n * 10))
    return str(folder)


def stream(spark, folder):
    return topics.read_stream(spark, "flight-position", folder, files_per_trigger=1)


def positions(spark):
    return adapters.positions(spark.read.parquet(f"{SF}/events.parquet"))


def rows(df):
    return sorted(map(str, df.collect()))


def test_spikes_equal_batch_over_many_batches(spark, arrivals):
    columns = ["position_id", "event_type", "d_up", "d_dn"]
    changes = cep.sample_changes(positions(spark))
    batch = (
        cep.altitude_spikes(changes).withColumn("event_type", F.lit("altitude_spike"))
        .unionByName(cep.velocity_spikes(changes).withColumn("event_type", F.lit("velocity_spike")))
    )
    last = positions(spark).agg(F.date_trunc("millisecond", F.max("position_time")).alias("m")).scalar()
    wanted = batch.filter(F.col("position_time") < last - F.expr("INTERVAL 10 MINUTES")).select(columns)
    with spikes.rocks_state(spark):
        got = topics.run_to_table(spikes.stream_spikes(stream(spark, arrivals), bucket_s=300), "spikes").select(columns)
    assert rows(got) == rows(wanted) and len(rows(wanted)) > 300


def test_windows_equal_batch(spark, arrivals):
    got = topics.run_to_table(jobs.windowed(stream(spark, arrivals)), "windows")
    last = positions(spark).agg(F.max("position_time").alias("m")).scalar()
    wanted = serving.window_metrics(positions(spark)).filter(F.col("window_end") <= last - F.expr("INTERVAL 10 MINUTES"))
    assert rows(got) == rows(wanted)


def test_latest_state_equals_batch(spark, arrivals):
    got = jobs.keep_latest(stream(spark, arrivals))
    assert rows(got) == rows(serving.latest(positions(spark), "icao24", "position_time", "position_id"))


def test_late_rows_are_counted(spark, arrivals):
    out = jobs.late_report(stream(spark, arrivals), delay="1 seconds").orderBy("batch").collect()
    assert [r["batch"] for r in out] == [0, 1, 2, 3, 4]
    assert sum(r["rows"] for r in out) == 1000
    assert out[0]["late"] == 0 and sum(r["late"] for r in out) > 0
    on_time = jobs.late_report(stream(spark, arrivals)).agg(F.sum("late")).first()[0]
    assert on_time == 0


def test_decode_splits_rows_and_rejects(spark):
    messages = [b'{"a": 1}', b"not json", None, b"[1, 2]", b'{"a": "x"}', b"null", b'{"b": 3}']
    df = spark.createDataFrame([(None if m is None else bytearray(m),) for m in messages], "value binary")
    rows, rejects = topics.decode(df, "a int")
    assert sorted(str(r["a"]) for r in rows.collect()) == ["1", "None"]
    told = {r["raw"]: r["reason"] for r in rejects.collect()}
    assert told[None] == "no message" and told["not json"] == told["null"] == told['{"a": "x"}'] == "broken message"
    assert rows.count() + rejects.count() == len(messages)


def test_job_goes_on_after_a_restart(spark, arrivals, tmp_path):
    landing = tmp_path / "in"
    landing.mkdir()
    names = sorted(n for n in os.listdir(arrivals) if n.endswith(".parquet") and n.startswith("events"))

    def land(some):
        for name in some:
            (landing / name).write_bytes(open(f"{arrivals}/{name}", "rb").read())

    places = {"target": f"{tmp_path}/state", "checkpoint": f"{tmp_path}/cp"}
    late = {"target": f"{tmp_path}/late", "checkpoint": f"{tmp_path}/late-cp"}
    land(names[:2])
    jobs.keep_latest(stream(spark, str(landing)), **places)
    jobs.late_report(stream(spark, str(landing)), **late)
    land(names[2:])
    got = jobs.keep_latest(stream(spark, str(landing)), **places)
    assert rows(got) == rows(serving.latest(positions(spark), "icao24", "position_time", "position_id"))
    assert rows(jobs.keep_latest(stream(spark, str(landing)), **places)) == rows(got)
    report = jobs.late_report(stream(spark, str(landing)), **late)
    assert sorted(r["batch"] for r in report.collect()) == [0, 1, 2, 3, 4] and report.agg(F.sum("rows")).first()[0] == 1000


def test_table_job_goes_on_after_a_restart(spark, arrivals, tmp_path):
    places = {"path": f"{tmp_path}/out", "checkpoint": f"{tmp_path}/cp"}
    first = topics.run_to_table(stream(spark, arrivals), "p", **places).count()
    assert topics.run_to_table(stream(spark, arrivals), "p", **places).count() == first == 1000


def test_changes_equal_plain_windows():
    rng = np.random.default_rng(4)
    times = np.cumsum(rng.integers(1, 20, 300)) * 1_000_000
    values = pd.Series(rng.integers(-500, 500, 300), dtype="object").where(pd.Series(rng.random(300) < 0.8), None)
    up, down = spikes.changes(times, values.astype("Int64"), 30)
    for at in range(300):
        near = [v for t, v in zip(times, values) if times[at] - 30_000_000 <= t <= times[at] and v is not None]
        v = values[at]
        assert (up[at], down[at]) == ((0, 0) if v is None or v is pd.NA or pd.isna(v) else (v - min(near), v - max(near)))


def test_spike_state_goes_on_after_a_restart_and_forgets(spark, arrivals, tmp_path):
    """Landed in two parts with a restart between them: the same hits, and only samples near the watermark stay."""
    landing = tmp_path / "in"
    landing.mkdir()
    names = sorted(n for n in os.listdir(arrivals) if n.endswith(".parquet") and n.startswith("events"))
    places = {"path": f"{tmp_path}/out", "checkpoint": f"{tmp_path}/cp"}
    for some in (names[:3], names[3:]):
        for name in some:
            (landing / name).write_bytes(open(f"{arrivals}/{name}", "rb").read())
        with spikes.rocks_state(spark):
            got = topics.run_to_table(spikes.stream_spikes(stream(spark, str(landing)), bucket_s=300), "s", **places)
    with spikes.rocks_state(spark):
        once = topics.run_to_table(spikes.stream_spikes(stream(spark, arrivals), bucket_s=300), "s")
    assert rows(got) == rows(once) and got.count() > 300
    with spikes.rocks_state(spark):
        state = spark.read.format("statestore").option("stateVarName", "samples").load(f"{tmp_path}/cp")
        held = state.select(F.explode("list_value").alias("v")).select("v.*") if "list_value" in state.columns else state.select("list_element.*")
        kept, first = held.count(), held.agg(F.min("micros")).first()[0]
    last = positions(spark).agg(F.max(F.unix_micros("position_time"))).first()[0]
    mark = last - 600_000_000
    # whole lists are dropped or cut in half, so none reaches back further than its own bucket and window
    assert 0 < kept < 1000 and first >= mark - 300_000_000 - 2 * spikes.REACH_US
