"""Great-circle distances in kilometres on a sphere."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

EARTH_KM = 6371.0088


def _rad(c: Column) -> Column:
    return F.radians(c.cast("double"))


def unit_vector(lat: Column, lon: Column) -> Column:
    """The point as x, y, z on the unit sphere."""
    a, b = _rad(lat), _rad(lon)
    return F.struct(
        (F.cos(a) * F.cos(b)).alias("x"), (F.cos(a) * F.sin(b)).alias("y"), F.sin(a).alias("z")
    )


def arc_km(u: Column, v: Column) -> Column:
    """Distance between two unit vectors, by their straight chord."""
    part = lambda c: F.pow(u[c] - v[c], 2)
    return 2 * EARTH_KM * F.asin(F.least(F.lit(1.0), F.sqrt(part("x") + part("y") + part("z")) / 2))


def _dot(u: list[Column], v: list[Column]) -> Column:
    return u[0] * v[0] + u[1] * v[1] + u[2] * v[2]


def _cross(u: list[Column], v: list[Column]) -> list[Column]:
    return [u[1] * v[2] - u[2] * v[1], u[2] * v[0] - u[0] * v[2], u[0] * v[1] - u[1] * v[0]]


def leg(start: Column, end: Column) -> Column:
    """A great-circle leg between two unit vectors, prepared for ``off_route_km``.

    ``normal`` is the unit normal of its plane and ``ahead`` the direction of
    travel at the start; both are null for a leg without length.
    """
    s, e = ([v[c] for c in "xyz"] for v in (start, end))
    normal = _cross(s, e)
    size = F.sqrt(_dot(normal, normal))
    unit = [F.try_divide(c, size) for c in normal]
    named = lambda parts: F.struct(*[c.alias(n) for c, n in zip(parts, "xyz")])
    return F.struct(
        start.alias("start"),
        end.alias("end"),
        named(unit).alias("normal"),
        named(_cross(unit, s)).alias("ahead"),
        arc_km(start, end).alias("km"),
    )


def off_route_km(point: Column, route: Column) -> Column:
    """Distance of a point (unit vector) to a great-circle leg.

    Behind the start it is the distance to the start, beyond the end the distance
    to the end, and a leg without length counts as its start.
    """
    parts = lambda v: [v[c] for c in "xyz"]
    p = parts(point)
    along = EARTH_KM * F.atan2(_dot(p, parts(route["ahead"])), _dot(p, parts(route["start"])))
    across = F.asin(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), _dot(p, parts(route["normal"])))))
    return (
        F.when(along.isNull() | (along < 0), arc_km(point, route["start"]))
        .when(along > route["km"], arc_km(point, route["end"]))
        .otherwise(F.abs(across) * EARTH_KM)
    )
