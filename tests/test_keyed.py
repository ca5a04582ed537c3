import os

import pytest
from pyspark.sql import functions as F

from contrail.operators.serving import latest
from contrail.streaming.keyed import KeyedTable

COLUMNS = ["icao24", "position_id", "position_time", "x"]


def batch(spark, number, keys):
    ids = F.col("id") + number * 1000
    return spark.range(keys).select(
        F.concat(F.lit("k"), F.pmod(F.col("id") * 7 + number, F.lit(50))).alias("icao24"),
        ids.alias("position_id"),
        F.timestamp_seconds(F.pmod(F.xxhash64(ids), F.lit(10_000))).alias("position_time"),
        F.lit(number).alias("x"),
    )


def files(root):
    return {
        os.path.join(d, n): os.stat(os.path.join(d, n)).st_mtime_ns
        for d, _, names in os.walk(root) for n in names if n.endswith(".parquet")
    }


def rows(frame):
    return sorted(map(str, frame.select(COLUMNS).collect()))


@pytest.fixture
def table(spark, tmp_path):
    return KeyedTable(spark, f"{tmp_path}/t", "icao24", "position_time", "position_id", buckets=32, compact=3)


def test_batches_equal_the_newest_of_all_rows(spark, table):
    assert table.read(COLUMNS) is None
    seen = None
    for number in range(9):
        new = batch(spark, number, 12)
        seen = new if seen is None else seen.unionByName(new)
        table.merge(new, number)
        assert rows(table.read(COLUMNS)) == rows(latest(seen, "icao24", "position_time", "position_id"))
    # deltas are folded into wholes and deleted
    assert max(len(parts) for parts in table.parts().values()) <= 2 * table.compact
    assert any(whole for parts in table.parts().values() for _, whole in parts)


def test_a_batch_of_ten_keys_touches_ten_buckets_at_most(spark, table):
    table.merge(batch(spark, 0, 500), 0)
    before = files(table.root)
    assert len(table.parts()) > 20
    table.merge(batch(spark, 1, 10), 1)
    after = files(table.root)
    assert all(after[name] == stamp for name, stamp in before.items())
    new = set(after) - set(before)
    assert 0 < len(new) <= 10 and len({name.split("bucket=")[1].split("/")[0] for name in new}) <= 10


def test_a_replayed_batch_changes_nothing(spark, table):
    for number in range(5):
        table.merge(batch(spark, number, 30), number)
    parts, held = table.parts(), rows(table.read(COLUMNS))
    for _ in range(2):
        table.merge(batch(spark, 4, 30), 4)
        assert rows(table.read(COLUMNS)) == held and table.parts() == parts


def test_an_empty_batch(spark, table):
    table.merge(batch(spark, 0, 0), 0)
    table.merge(batch(spark, 1, 5), 1)
    assert table.read(COLUMNS).count() == 5
