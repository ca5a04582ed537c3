import collections
import random
from datetime import datetime, timedelta

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from contrail.streaming import jobs, packs, topics

START = datetime(2024, 1, 1, 6)
PLACES = "position_id bigint, airport_code string, position_time timestamp"
READINGS = "airport_code string, observed_at timestamp"


def test_lists_hold_each_row_once():
    rng = random.Random(3)
    rows = [(rng.choice("abc"), rng.randrange(-4, 4), i, None if i % 5 == 0 else str(i)) for i in range(1000)]
    columns = [list(c) for c in zip(*rows)]
    batches = pa.table(columns, ["k", "n", "i", "s"]).to_batches(max_chunksize=70)
    for longest, wanted in ((1000, 24), (10, None)):
        got = packs.pack(batches, ["k", "n"], "rows", longest).to_pylist()
        back = [(g["k"], g["n"], r["i"], r["s"]) for g in got for r in g["rows"]]
        assert sorted(back, key=lambda r: r[2]) == rows
        assert max(len(g["rows"]) for g in got) <= longest and (wanted is None or len(got) == wanted)


def test_many_key_columns_do_not_overflow():
    rows = pa.table({c: [i * p % 997 for i in range(997)] for c, p in zip("abcdefghij", (1, 2, 3, 5, 7, 11, 13, 17, 19, 23))})
    twice = [*rows.append_column("x", [list(range(997))]).to_batches()] * 2
    got = packs.pack(twice, list("abcdefghij"), "rows").to_pylist()
    assert len(got) == 997 and all(g["rows"] == [{"x": g["a"]}] * 2 for g in got)


def test_rows_are_packed_by_task_and_come_back(spark):
    rows = spark.range(500).selectExpr(
        "CASE WHEN id % 9 != 0 THEN id % 4 END AS k", "id", "timestamp_seconds(id) AS t", "cast(id AS decimal(9,2)) AS d"
    )
    wanted = sorted(map(str, rows.filter("k IS NOT NULL").collect()))
    # a task packs only when it holds a batch more than the bound, so more than one list of a key can come
    for most in (1, 1_000_000):
        told = packs.packed(rows, ["k"], "rows", most)
        assert told.columns == ["k", "rows"]
        assert sorted(map(str, told.select("k", F.inline("rows")).collect())) == wanted
    assert told.count() == 4


def landed(spark, folder, places, readings):
    """The n-th of each as the n-th file of its stream."""
    for n, (some, seen) in enumerate(zip(places, readings)):
        spark.createDataFrame(some, PLACES).coalesce(1).write.parquet(f"{folder}/places{n}.parquet")
        spark.createDataFrame(seen, READINGS).coalesce(1).write.parquet(f"{folder}/seen{n}.parquet")


def joined(spark, folder):
    streams = [topics.stream_files(spark, str(folder), name) for name in ("places", "seen")]
    return topics.run_to_table(jobs.departures_with_weather(*streams), "w", f"{folder}/out", f"{folder}/cp")


def test_places_of_an_airport_and_hour_are_one_row_of_the_state(spark, tmp_path):
    places = [(i, "A" if i % 2 else "B", START + timedelta(seconds=i)) for i in range(2000)]
    landed(spark, tmp_path, [places], [[("A", START), ("B", START + timedelta(minutes=10))]])
    got = joined(spark, tmp_path)
    assert got.count() == 1000 + sum(i >= 600 and i % 2 == 0 for i in range(2000))
    state = spark.read.format("statestore").option("joinSide", "left").option("batchId", 0).load(f"{tmp_path}/cp")
    assert state.count() == 2


@pytest.mark.parametrize("seed", [1, 2])
def test_pairs_over_batches_equal_a_plain_search(spark, tmp_path, seed):
    """The second landing starts behind the end of the first, by less than the watermark's delay, and meets its state."""
    rng = random.Random(seed)
    places, readings = [], []
    for n in range(2):
        # whole minutes, so instants are often equal or an hour apart
        minute = lambda: START + timedelta(minutes=rng.randrange(0 if n == 0 else 175, 180 if n == 0 else 360))  # noqa: E731, B023
        places.append([(n * 1000 + i, rng.choice(["A", "B", "C", None]), minute() if rng.random() < 0.95 else None) for i in range(300)])
        seen = [(rng.choice(["A", "B", "D", None]), minute() if rng.random() < 0.95 else None) for _ in range(60)]
        # one place twice, and readings that repeat
        places[-1].append(places[-1][0])
        readings.append(seen + seen[:20])
    hour = timedelta(hours=1)
    told = {r for seen in readings for r in seen if None not in r}
    wanted = collections.Counter(
        (i, a, t, at) for some in places for i, a, t in some if t for b, at in told if a == b and t - hour <= at <= t
    )
    for n in range(2):
        landed(spark, f"{tmp_path}/{n}", [places[n]], [readings[n]])
    streams = [
        spark.readStream.schema(schema).parquet(f"{tmp_path}/in/{name}*.parquet")
        for name, schema in (("places", PLACES), ("seen", READINGS))
    ]
    for n in range(2):
        for name in ("places", "seen"):
            spark.read.parquet(f"{tmp_path}/{n}/{name}0.parquet").write.parquet(f"{tmp_path}/in/{name}{n}.parquet")
        joins = jobs.departures_with_weather(*streams)
        got = topics.run_to_table(joins, "w", f"{tmp_path}/out", f"{tmp_path}/cp")
    assert got.columns == ["position_id", "airport_code", "position_time", "observed_at"]
    assert collections.Counter(tuple(r) for r in got.collect()) == wanted and len(wanted) > 300
    across = [w for w in wanted if w[0] >= 1000 and w[3] < START + timedelta(minutes=175)]
    assert across
