"""Text rules of the display and route lines."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# fixed value: the aircraft shown where no snapshot names one
SAMPLE_AIRCRAFT = "71bf5c"


def or_default(value: str | Column, default: str) -> Column:
    """Null and empty text give the default."""
    column = F.col(value) if isinstance(value, str) else value
    return F.coalesce(F.nullif(column, F.lit("")), F.lit(default))


def shown_callsign(callsign: str | Column) -> Column:
    """The default is chosen before trimming, so a blank callsign shows as empty."""
    return F.trim(or_default(callsign, "N/A"))


def min_width(text: Column, width: int) -> Column:
    """Pad to a width, never truncate."""
    return F.rpad(text, F.greatest(F.lit(width), F.length(text)), F.lit(" "))


def utc_text(seconds: Column) -> Column:
    return F.date_format(F.timestamp_seconds(seconds), "yyyy-MM-dd HH:mm:ss 'UTC'")
