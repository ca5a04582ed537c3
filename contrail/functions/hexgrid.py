"""A hexagonal grid over the globe as column expressions: cells, centres, parents, rings.

The globe is unrolled by the equal-area cylindrical projection whose scale is true at ``PARALLEL`` degrees, and
tiled with hexagons there: all cells cover the same area of the sphere, those near the parallel are regular. A level
has ``COLUMNS << level`` cells around the globe, so cells close up at the antimeridian; each level halves the
width of the one above it. A cell's parent is the cell of the level above that holds its centre.

A cell is one number: level, row from the south, column from the antimeridian.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, functions as F

PARALLEL = 36.0
COLUMNS = 90
ROW_SHIFT, LEVEL_SHIFT = 28, 56
MOST_LEVEL = 20
_COS = math.cos(math.radians(PARALLEL))


def columns_of(level: int) -> int:
    return COLUMNS << level


def size_of(level: int) -> float:
    """The side of a hexagon in the projection, whose unit is the globe's radius."""
    return 2 * math.pi * _COS / columns_of(level) / math.sqrt(3)


def last_row(level: int) -> int:
    """The row that holds the north pole."""
    return math.floor(2 * (2 / _COS / size_of(level)) / 3 + 0.5)


def _packed(level: int, row: Column, column: Column) -> Column:
    around = F.pmod(column, F.lit(columns_of(level)).cast("long"))
    return F.lit(level << LEVEL_SHIFT).cast("long") + F.shiftleft(row, ROW_SHIFT) + around


def _nearest(value: Column) -> Column:
    return F.floor(value + F.lit(0.5)).cast("long")


def hex_cell(latitude: Column, longitude: Column, level: int) -> Column:
    """The cell of a place; null where either part is."""
    x = (longitude.cast("double") + F.lit(180.0)) / F.lit(360.0) * F.lit(float(columns_of(level)))
    y = (F.sin(F.radians(latitude.cast("double"))) + F.lit(1.0)) / F.lit(_COS) / F.lit(size_of(level))
    q, r = x - y / F.lit(3.0), y * F.lit(2.0) / F.lit(3.0)
    s = -q - r
    rq, rr, rs = _nearest(q), _nearest(r), _nearest(s)
    dq, dr, ds = F.abs(rq - q), F.abs(rr - r), F.abs(rs - s)
    # of the three rounded parts the worst follows from the others
    first = (dq > dr) & (dq > ds)
    column = F.when(first, -rr - rs).otherwise(rq)
    row = F.when(~first & (dr >= ds), -rq - rs).otherwise(rr)
    return _packed(level, row, column + F.shiftright(row, 1))


def row_of(cell: Column) -> Column:
    return F.shiftright(cell, ROW_SHIFT).bitwiseAND(F.lit((1 << ROW_SHIFT) - 1).cast("long"))


def column_of(cell: Column) -> Column:
    return cell.bitwiseAND(F.lit((1 << ROW_SHIFT) - 1).cast("long"))


def centre_of(cell: Column, level: int) -> tuple[Column, Column]:
    """(latitude, longitude) of a cell's centre; rows that reach over a pole end there."""
    row, column = row_of(cell), column_of(cell)
    x = column + F.when(row % 2 == 1, F.lit(0.5)).otherwise(F.lit(0.0))
    longitude = x / F.lit(float(columns_of(level))) * F.lit(360.0) - F.lit(180.0)
    rise = row * F.lit(1.5) * F.lit(size_of(level)) * F.lit(_COS) - F.lit(1.0)
    latitude = F.degrees(F.asin(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), rise))))
    return F.when(row.isNotNull(), latitude), longitude


def parent_of(cell: Column, level: int) -> Column:
    """The cell of the level above that holds the cell's centre."""
    return hex_cell(*centre_of(cell, level), level - 1)


def ring_steps(distance: int) -> list[tuple[int, int]]:
    """(column, row) steps to the cells at a distance, in axial coordinates."""
    if not distance:
        return [(0, 0)]
    around = [(1, 0), (0, 1), (-1, 1), (-1, 0), (0, -1), (1, -1)]
    q, r = around[4][0] * distance, around[4][1] * distance
    steps = []
    for dq, dr in around:
        for _ in range(distance):
            steps.append((q, r))
            q, r = q + dq, r + dr
    return steps


def ring_of(cell: Column, level: int, distance: int = 1) -> Column:
    """The cells at a distance, in no order; those beyond a pole do not exist."""
    row, column = row_of(cell), column_of(cell)
    axial = column - F.shiftright(row, 1)
    cells = []
    for dq, dr in ring_steps(distance):
        to = row + F.lit(dr).cast("long")
        there = _packed(level, to, axial + F.lit(dq).cast("long") + F.shiftright(to, 1))
        cells.append(F.when(to.between(0, last_row(level)), there))
    return F.array_distinct(F.array_compact(F.array(*cells)))
