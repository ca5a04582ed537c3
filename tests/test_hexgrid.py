import math

import numpy as np
from pyspark.sql import functions as F

from contrail.functions import hexgrid
from contrail.operators import serving
from contrail.session import written

LEVEL = 3


def places(spark, n=2_000):
    """Points spread evenly over the sphere, and odd ones."""
    h = lambda seed: F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(1 << 30)) / F.lit(float(1 << 30))
    df = spark.range(n).select("id", F.degrees(F.asin(h(1) * 2 - 1)).alias("lat"), (h(2) * 360 - 180).alias("lon"))
    odd = [(-1, 90.0, 10.0), (-2, -90.0, 0.0), (-3, 0.0, 180.0), (-4, 0.0, -180.0), (-5, 37.46, 126.44)]
    return df.unionByName(spark.createDataFrame(odd, "id long, lat double, lon double"))


def with_cells(df, level=LEVEL):
    """Cells as a stored column, so that expressions over them stay short."""
    return written(df.withColumn("cell", hexgrid.hex_cell(F.col("lat"), F.col("lon"), level)), "cells")


def plane(lat, lon, level):
    x = (lon + 180) / 360 * hexgrid.columns_of(level) * math.sqrt(3)
    return x, (np.sin(np.radians(lat)) + 1) / hexgrid._COS / hexgrid.size_of(level)


def test_every_point_is_in_the_cell_with_the_nearest_centre(spark):
    cells = with_cells(places(spark))
    ring = cells.select("id", "lat", "lon", "cell", F.explode(F.concat(F.array("cell"), hexgrid.ring_of(F.col("cell"), LEVEL))).alias("near"))
    found = ring.select("id", "lat", "lon", "cell", "near", *[c.alias(n) for c, n in zip(hexgrid.centre_of(F.col("near"), LEVEL), ("clat", "clon"))]).toPandas()
    row = found["near"].to_numpy() >> hexgrid.ROW_SHIFT & (1 << hexgrid.ROW_SHIFT) - 1
    x, y = plane(found["lat"].to_numpy(), found["lon"].to_numpy(), LEVEL)
    cx, _ = plane(found["clat"].to_numpy(), found["clon"].to_numpy(), LEVEL)
    width = hexgrid.columns_of(LEVEL) * math.sqrt(3)
    dx = np.abs(x - cx) % width
    found["d"] = np.minimum(dx, width - dx) ** 2 + (y - 1.5 * row) ** 2
    own = found[found["cell"] == found["near"]].set_index("id")["d"].sort_index()
    nearest = found.groupby("id")["d"].min().sort_index()
    assert len(own) == 2_005 and (own.to_numpy() <= nearest.to_numpy() + 1e-9).all() and own.max() <= 1 + 1e-9


def test_cells_close_up_and_have_one_size(spark):
    cells = {r["id"]: r["cell"] for r in with_cells(places(spark, 1)).collect()}
    assert cells[-3] == cells[-4]
    counts = with_cells(places(spark, 200_000), 0).groupBy("cell").count().toPandas()
    row = counts["cell"].to_numpy() >> hexgrid.ROW_SHIFT & (1 << hexgrid.ROW_SHIFT) - 1
    inner = counts[(row > 0) & (row < hexgrid.last_row(0))]["count"]
    assert inner.std() < 1.3 * math.sqrt(inner.mean())  # no more than chance


def test_rings(spark):
    cells = with_cells(places(spark, 60)).select("cell").distinct()
    for distance in (1, 2):
        ring = cells.select("cell", hexgrid.ring_of(F.col("cell"), LEVEL, distance).alias("ring"))
        row = hexgrid.row_of(F.col("cell"))
        inner = ring.filter(row.between(distance, hexgrid.last_row(LEVEL) - distance))
        assert inner.filter(F.size("ring") != 6 * distance).count() == 0
        back = ring.select("cell", F.explode("ring").alias("near")).select("cell", hexgrid.ring_of(F.col("near"), LEVEL, distance).alias("r"))
        assert back.filter(~F.array_contains("r", F.col("cell"))).count() == 0


def test_roll_up_equals_recount(spark):
    cells = with_cells(places(spark))
    parent = hexgrid.parent_of(F.col("cell"), LEVEL)
    rolled = cells.groupBy("cell").count().groupBy(parent.alias("p")).agg(F.sum("count").alias("n"))
    recount = cells.select(parent.alias("p")).groupBy("p").agg(F.count(F.lit(1)).alias("n"))
    assert sorted(map(tuple, rolled.collect())) == sorted(map(tuple, recount.collect()))
    # a parent is the own cell of the level above or one beside it
    above = cells.select(hexgrid.hex_cell(F.col("lat"), F.col("lon"), LEVEL - 1).alias("own"), parent.alias("p"))
    beside = F.array_contains(hexgrid.ring_of(F.col("own"), LEVEL - 1), F.col("p"))
    assert above.filter((F.col("own") != F.col("p")) & ~beside).count() == 0
    missing = spark.createDataFrame([(1, None, 1.0), (2, 1.0, None)], "id int, lat double, lon double")
    assert with_cells(missing).filter("cell IS NOT NULL").count() == 0


def test_heatmap_levels_agree(spark):
    rows = places(spark, 3000).select(
        F.col("lat").alias("latitude"), F.col("lon").alias("longitude"), F.timestamp_seconds(F.col("id") % 1800 + 1_700_000_000).alias("position_time"),
        F.col("id").cast("string").alias("icao24"), F.lit(100.0).alias("baro_altitude"),
    )
    fine = serving.hex_counts(rows, 4)
    assert fine.agg(F.sum("samples")).first()[0] == 3005
    up = serving.hex_roll_up(fine, 4)
    assert up.agg(F.sum("samples")).first()[0] == 3005 and up.count() <= fine.count()
