"""Tables laid out for their lookups: a space-time curve for positions, bloom filters for flights.

Positions. Time of day, latitude and longitude are cut into 2^16 steps each and their bits are interleaved,
so rows that are near in all three lie near on the curve. The table is partitioned by day and
ranged and sorted by the curve. A box of area and time becomes a few ranges of the curve: octants
that lie outside are left out, octants inside are taken whole, others are cut further until there are
``MOST_RANGES``. The ranges reach the scan as filters, so row groups and pages without a match are skipped;
the exact box is tested on what is left.

Flights. A file's row groups carry bloom filters on the five lookup columns, so an equality reads only groups
that may hold the value; rows are ranged by aircraft, whose groups also have narrow bounds.
"""

from __future__ import annotations

from datetime import UTC, date, datetime, timedelta

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from contrail.sources.landing import in_area

STEPS_BITS = 16
MOST_RANGES = 48
DAY_US = 86_400_000_000
# time of day, latitude, longitude: low end and width
SPANS = ((0.0, float(DAY_US)), (-90.0, 180.0), (-180.0, 360.0))
LOOKUPS = ("icao24", "callsign", "flight_date", "origin_airport", "dest_airport")

Box = list[tuple[int, int]]


def step(value: float, low: float, width: float) -> int:
    """The step of a value, as :func:`curve_key` counts them."""
    return min((1 << STEPS_BITS) - 1, max(0, int((value - low) / width * (1 << STEPS_BITS))))


def curve_key(time: str = "position_time", latitude: str = "latitude", longitude: str = "longitude") -> Column:
    """The place of a row on its day's curve; null where one of the three is."""
    of_day = F.pmod(F.unix_micros(time), F.lit(DAY_US))
    key = None
    for at, (value, (low, width)) in enumerate(zip((of_day, F.col(latitude), F.col(longitude)), SPANS)):
        place = F.floor((value.cast("double") - F.lit(low)) / F.lit(width) * F.lit(float(1 << STEPS_BITS)))
        place = F.greatest(F.lit(0), F.least(F.lit((1 << STEPS_BITS) - 1), place.cast("long"))).cast("long")
        # greatest and least skip nulls
        place = F.when(value.isNotNull(), place)
        for bit in range(STEPS_BITS):
            part = F.shiftleft(F.shiftright(place, bit).bitwiseAND(F.lit(1).cast("long")), 3 * bit + 2 - at)
            key = part if key is None else key + part
    return key


def curve_ranges(box: Box, most: int = MOST_RANGES) -> list[tuple[int, int]]:
    """Ranges of the curve that hold every step of the box (both ends included), few and close.

    Cells are cut level by level; when cutting on would make more than ``most``, those that are
    left are taken whole.
    """
    whole: list[tuple[int, int]] = []
    open_cells = [(0, (0, 0, 0))]
    for level in range(STEPS_BITS - 1, -2, -1):
        size, cut = 1 << (level + 1), []
        for first, corner in open_cells:
            inside = all(low <= c and c + size - 1 <= high for c, (low, high) in zip(corner, box))
            (whole if inside or level < 0 else cut).append((first, corner) if not inside and level >= 0 else (first, first + size**3 - 1))
        if not cut:
            break
        deeper = []
        half = size // 2
        for first, corner in cut:
            for octant in range(8):
                at = tuple(c + half * (octant >> (2 - axis) & 1) for axis, c in enumerate(corner))
                if all(c <= high and c + half - 1 >= low for c, (low, high) in zip(at, box)):
                    deeper.append((first + octant * half**3, at))
        if len(whole) + len(deeper) > most:
            whole += [(first, first + size**3 - 1) for first, _ in cut]
            break
        open_cells = deeper
    merged: list[tuple[int, int]] = []
    for low, high in sorted(whole):
        if merged and low <= merged[-1][1] + 1:
            merged[-1] = (merged[-1][0], max(high, merged[-1][1]))
        else:
            merged.append((low, high))
    return merged


def write_space_time(positions: DataFrame, path: str, mode: str = "overwrite", **options: str) -> None:
    """Positions by day and along the curve; ranges give tasks of like size whatever a day or an area weighs."""
    order = ["position_date", "curve"]
    placed = positions.withColumns({"position_date": F.to_date("position_time"), "curve": curve_key()})
    placed.repartitionByRange(*order, F.xxhash64("position_id")).sortWithinPartitions(*order).write.mode(mode).options(
        **options
    ).partitionBy("position_date").parquet(path)


def _micros(at: datetime) -> int:
    at = at if at.tzinfo else at.replace(tzinfo=UTC)
    return (at - datetime(1970, 1, 1, tzinfo=UTC)) // timedelta(microseconds=1)


def read_box(spark: SparkSession, path: str, start: datetime, end: datetime, area: dict[str, float]) -> DataFrame:
    """Positions of the layout inside the area from ``start`` to ``end`` (UTC), ends and edges included."""
    low, high = _micros(start), _micros(end)
    days = [low // DAY_US, high // DAY_US]
    sides = [
        (step(area[a], *span), step(area[b], *span))
        for a, b, span in (("lamin", "lamax", SPANS[1]), ("lomin", "lomax", SPANS[2]))
    ]
    # inexact floating products may put an edge one step off
    sides = [(max(0, a - 1), min((1 << STEPS_BITS) - 1, b + 1)) for a, b in sides]

    def near(first: int, last: int) -> Column:
        hours = (max(0, step(first, *SPANS[0]) - 1), min((1 << STEPS_BITS) - 1, step(last, *SPANS[0]) + 1))
        held = [F.col("curve").between(a, b) for a, b in curve_ranges([hours, *sides])]
        test = held[0]
        for more in held[1:]:
            test = test | more
        return test

    day = lambda number: F.lit(date(1970, 1, 1) + timedelta(days=number))
    on = F.col("position_date")
    # days that are cut and whole days are read apart, so each part's ranges reach the scan
    if days[0] == days[1]:
        parts = [((on == day(days[0])), near(low % DAY_US, high % DAY_US))]
    else:
        parts = [((on == day(days[0])), near(low % DAY_US, DAY_US - 1)), ((on == day(days[1])), near(0, high % DAY_US))]
        if days[1] - days[0] > 1:
            parts.append(((on > day(days[0])) & (on < day(days[1])), near(0, DAY_US - 1)))
    timed = F.unix_micros("position_time").between(low, high)
    found = None
    for dated, ranges in parts:
        rows = spark.read.parquet(path).filter(dated).filter(ranges).filter(timed)
        found = rows if found is None else found.unionByName(rows)
    return in_area(found, **area).drop("curve", "position_date")


def write_lookup(flights: DataFrame, path: str, mode: str = "overwrite", values: int = 100_000, **options: str) -> None:
    """Flights with bloom filters on the lookup columns, sized for ``values`` distinct ones a row group."""
    blooms = {}
    for column in LOOKUPS:
        blooms[f"parquet.bloom.filter.enabled#{column}"] = "true"
        blooms[f"parquet.bloom.filter.expected.ndv#{column}"] = str(values)
    order = ["icao24", "flight_id"]
    flights.repartitionByRange(*order).sortWithinPartitions(*order).write.mode(mode).options(**blooms, **options).parquet(path)
