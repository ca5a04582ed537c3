import random
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from contrail.operators import layout, serving
from contrail.sources import adapters, landing

SF = "/root/testdata/sf0.1"


def scanned(frame):
    """Rows that the scans of a plan gave out."""
    plan = frame._jdf.queryExecution().executedPlan()
    plan = plan.executedPlan() if plan.getClass().getSimpleName() == "AdaptiveSparkPlanExec" else plan
    plan.execute().count()
    leaves = plan.collectLeaves()
    return sum(leaves.apply(i).metrics().apply("numOutputRows").value() for i in range(leaves.size()))


def morton(t, a, o):
    return sum((t >> b & 1) << 3 * b + 2 | (a >> b & 1) << 3 * b + 1 | (o >> b & 1) << 3 * b for b in range(16))


def test_ranges_hold_the_box_and_little_else():
    rng = random.Random(1)
    for _ in range(60):
        box = []
        for _ in range(3):
            low = rng.randrange(1 << 16)
            box.append((low, min((1 << 16) - 1, low + rng.randrange(1 << rng.randrange(1, 16)))))
        ranges = layout.curve_ranges(box)
        assert 0 < len(ranges) <= layout.MOST_RANGES and all(a <= b for a, b in ranges)
        assert all(x[1] < y[0] for x, y in zip(ranges, ranges[1:]))
        for _ in range(50):
            key = morton(*[rng.randint(low, high) for low, high in box])
            assert any(a <= key <= b for a, b in ranges)
    assert layout.curve_ranges([(0, 65535)] * 3) == [(0, (1 << 48) - 1)]
    assert layout.curve_ranges([(5, 5), (6, 6), (7, 7)], 10**6) == [(morton(5, 6, 7),) * 2]


def test_key_equals_interleaved_steps(spark):
    rows = [(1_704_067_200_000_000 + 3_600_000_000 * 7, 37.5, 127.25), (0, -90.0, -180.0), (86_399_999_999, 90.0, 180.0)]
    df = spark.createDataFrame(rows, "t bigint, latitude double, longitude double").withColumn("position_time", F.timestamp_micros("t"))
    got = [r[0] for r in df.orderBy(F.desc("t")).select(layout.curve_key()).collect()]
    wanted = [
        morton(*[layout.step(v, *span) for v, span in zip((t % layout.DAY_US, a, o), layout.SPANS)])
        for t, a, o in sorted(rows, reverse=True)
    ]
    assert got == wanted


def spread_positions(spark, n=200_000):
    """Positions all over the globe and four days."""
    h = lambda seed, size: F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(size))
    return spark.range(n).select(
        F.col("id").alias("position_id"),
        F.timestamp_micros(F.lit(1_704_067_200_000_000) + h(1, 4 * layout.DAY_US)).alias("position_time"),
        (h(2, 180_000_000) / 1_000_000 - 90).cast("decimal(9,6)").alias("latitude"),
        (h(3, 360_000_000) / 1_000_000 - 180).cast("decimal(9,6)").alias("longitude"),
    )


@pytest.mark.parametrize(
    "start, end, share",
    [
        (datetime(2024, 1, 2, 6), datetime(2024, 1, 2, 7), 0.05),
        (datetime(2024, 1, 1, 22), datetime(2024, 1, 2, 3), 0.2),
        # days hold 0.64 of the rows, the area a fiftieth
        (datetime(2024, 1, 1, 12), datetime(2024, 1, 4, 1), 0.3),
    ],
)
def test_box_reads_a_fraction_of_the_table(spark, tmp_path_factory, start, end, share):
    path = str(tmp_path_factory.getbasetemp() / "curve")
    positions = spread_positions(spark)
    if not (tmp_path_factory.getbasetemp() / "curve").exists():
        small = {"parquet.block.size": "65536", "parquet.page.row.count.limit": "500"}
        layout.write_space_time(positions, path, **small)
    box = layout.read_box(spark, path, start, end, landing.AREA | {"lamax": 60.0, "lomax": 170.0})
    timed = positions.filter(F.col("position_time").between(F.lit(start), F.lit(end)))
    wanted = landing.in_area(timed, **(landing.AREA | {"lamax": 60.0, "lomax": 170.0}))
    assert sorted(map(tuple, box.collect())) == sorted(map(tuple, wanted.select(box.columns).collect()))
    assert 0 < wanted.count() and scanned(box) < share * 200_000


def test_lookups_skip_row_groups(spark, tmp_path):
    flights = adapters.flights(spark.read.parquet(f"{SF}/orders.parquet"))
    layout.write_lookup(flights, f"{tmp_path}/f", values=2000, **{"parquet.block.size": "32768", "parquet.page.size": "4096"})
    table = spark.read.parquet(f"{tmp_path}/f")
    total = table.count()
    assert scanned(table.filter("flight_id IS NOT NULL")) == total
    for column, value in (("icao24", "000042"), ("callsign", "KAL123"), ("icao24", "nobody"), ("origin", "A999")):
        found = serving.find_flights(table, **{column: value})
        wanted = serving.find_flights(flights, **{column: value})
        assert sorted(map(str, found.collect())) == sorted(map(str, wanted.select(found.columns).collect()))
        if value in ("nobody", "A999"):
            assert scanned(found) < 0.05 * total
        else:
            assert scanned(found) < 0.5 * total
