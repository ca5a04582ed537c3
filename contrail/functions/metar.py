"""Weather table columns from a raw METAR text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


def _signed(text: Column) -> Column:
    return F.replace(text, F.lit("M"), F.lit("-")).try_cast("decimal(5,1)")


def with_metar_columns(reports: DataFrame, raw: str = "raw_metar") -> DataFrame:
    """The seven columns named by the weather table; a group that is absent gives null.

    Ceiling is the lowest broken or overcast layer, visibility is in whole or
    fractional statute miles, and a variable wind has no direction.
    """
    text = F.col(raw)
    part = lambda pattern, group=1: F.nullif(F.regexp_extract(text, pattern, group), F.lit(""))
    wind = r"\b(\d{3}|VRB)(\d{2,3})(?:G\d{2,3})?KT\b"
    miles = r"(?:^|\s)M?(?:(\d+) )?(\d+)(?:/(\d+))?SM\b"
    number = lambda c: c.try_cast("decimal(9,4)")
    below = F.coalesce(number(part(miles, 3)), F.lit(1).cast("decimal(9,4)"))
    fraction = F.try_divide(number(part(miles, 2)), below)
    layers = F.regexp_extract_all(text, F.lit(r"\b(?:BKN|OVC)(\d{3})"), F.lit(1))
    temperatures = r"\s(M?\d{2})/(M?\d{2})?(?:\s|$)"
    return (
        reports.withColumn("wind_direction_deg", part(wind, 1).try_cast("smallint"))
        .withColumn("wind_speed_knots", part(wind, 2).try_cast("decimal(5,1)"))
        .withColumn(
            "visibility_miles",
            (F.coalesce(number(part(miles, 1)), F.lit(0).cast("decimal(9,4)")) + fraction).cast("decimal(5,2)"),
        )
        .withColumn("ceiling_ft", F.array_min(F.transform(layers, lambda x: x.cast("int") * 100)))
        .withColumn("temperature_c", _signed(part(temperatures, 1)))
        .withColumn("dewpoint_c", _signed(part(temperatures, 2)))
        .withColumn("altimeter_inhg", (part(r"\bA(\d{4})\b").cast("int") / F.lit(100)).cast("decimal(6,2)"))
    )
