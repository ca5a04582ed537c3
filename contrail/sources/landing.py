"""Landed snapshot and history documents to rows, and the snapshot export."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from contrail.functions.text import SAMPLE_AIRCRAFT, min_width, or_default, shown_callsign, utc_text
from contrail.operators.spread import lookup_join
from contrail.schemas import STATE_FIELDS

SNAPSHOT_SCHEMA = "time bigint, states array<array<string>>"
HISTORY_SCHEMA = (
    "array<struct<icao24:string, firstSeen:bigint, estDepartureAirport:string,"
    " lastSeen:bigint, estArrivalAirport:string, callsign:string>>"
)

# the area of interest: fixed defaults, overridable per call
AREA = {"lamin": 33.0, "lamax": 38.9, "lomin": 124.0, "lomax": 130.0}


def parse_snapshots(landed: DataFrame) -> DataFrame:
    """(snapshot_id, body) to (snapshot_id, time, states); broken JSON gives nulls."""
    parsed = F.from_json("body", SNAPSHOT_SCHEMA)
    return landed.withColumn("_p", parsed).select("snapshot_id", "_p.time", "_p.states")


def _field(state: Column, position: int, kind: str) -> Column:
    raw = F.get(state, F.lit(position))
    if kind == "string":
        return raw
    if kind.startswith("array"):
        return F.from_json(raw, kind)
    return raw.try_cast(kind)


def typed_state(state: Column) -> Column:
    """A positional state row as a struct: short rows end in nulls, extras are ignored."""
    return F.struct(*[_field(state, i, kind).alias(name) for i, (name, kind) in enumerate(STATE_FIELDS)])


def flatten_states(landed: DataFrame) -> DataFrame:
    """One row per state, in arrival order ``pos``; a snapshot without states gives none."""
    exploded = parse_snapshots(landed).select("snapshot_id", "time", F.posexplode("states").alias("pos", "state"))
    return exploded.select("snapshot_id", "time", "pos", typed_state(F.col("state")).alias("s")).select(
        "snapshot_id", "time", "pos", "s.*"
    )


def position_time() -> Column:
    return F.timestamp_seconds(F.coalesce("time_position", "last_contact"))


def states_to_positions(states: DataFrame) -> DataFrame:
    """Typed states with the columns of the position table; untimed or unnamed ones are left out."""
    return (
        states.withColumn("position_time", position_time())
        .filter(F.col("icao24").isNotNull() & F.col("position_time").isNotNull())
        .select(
            "icao24",
            F.trim("callsign").alias("callsign"),
            F.lit(None).cast("bigint").alias("flight_id"),
            "position_time",
            "latitude",
            "longitude",
            "baro_altitude",
            "geo_altitude",
            "velocity",
            "true_track",
            "vertical_rate",
            "on_ground",
            "squawk",
        )
    )


def tagged_states(landed: DataFrame) -> DataFrame:
    """Every state and every broken document as one row, with the ``reason`` it is rejected for, else null.

    Documents are parsed once. One that is not a snapshot is a row without position; a
    state without aircraft code or time has its own reason.
    """
    parsed = landed.withColumn(
        "_p",
        F.from_json(
            "body",
            SNAPSHOT_SCHEMA + ", _broken string",
            {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_broken"},
        ),
    )
    is_broken = F.col("_p").isNull() | F.col("_p._broken").isNotNull()
    spread = parsed.withColumn("_bad", is_broken).select(
        "snapshot_id",
        F.when(F.col("_bad"), F.col("body")).alias("body"),
        "_bad",
        "_p.time",
        F.posexplode_outer(F.when(~F.col("_bad"), F.col("_p.states"))).alias("pos", "state"),
    )
    states = (
        spread.filter("_bad OR pos IS NOT NULL")
        .select("*", F.coalesce("body", F.to_json("state")).alias("raw"), typed_state(F.col("state")).alias("s"))
        .select("snapshot_id", "time", "pos", "raw", "_bad", "s.*")
    )
    reason = (
        F.when(F.col("_bad"), "broken document")
        .when(F.col("icao24").isNull() | (F.col("icao24") == ""), "no aircraft code")
        .when(position_time().isNull(), "no position time")
    )
    return states.withColumn("reason", reason).drop("_bad")


def quarantine(landed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Split into good states and rejects (snapshot_id, pos, reason, raw).

    To write both from one parse, write :func:`tagged_states` and split what was written.
    """
    tagged = tagged_states(landed)
    good = tagged.filter("reason IS NULL").drop("raw", "reason")
    return good, tagged.filter("reason IS NOT NULL").select("snapshot_id", "pos", "reason", "raw")


def in_area(df: DataFrame, lamin: float, lamax: float, lomin: float, lomax: float) -> DataFrame:
    """Rows inside the box, edges included; rows without a place drop out."""
    box = lambda low, high: (F.lit(str(low)).cast("decimal(9,6)"), F.lit(str(high)).cast("decimal(9,6)"))
    return df.filter(F.col("latitude").between(*box(lamin, lamax)) & F.col("longitude").between(*box(lomin, lomax)))


def display_lines(states: DataFrame) -> DataFrame:
    """The five shown fields and the text line built from them."""
    shown = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("None"))
    callsign = shown_callsign("callsign")
    line = F.concat(
        F.lit("  ICAO: "),
        F.coalesce(F.col("icao24"), F.lit("None")),
        F.lit(" | 콜사인: "),
        min_width(callsign, 8),
        F.lit(" | 위도: "),
        shown("latitude"),
        F.lit(" | 경도: "),
        shown("longitude"),
        F.lit(" | 고도: "),
        shown("baro_altitude"),
        F.lit("m | 속도: "),
        shown("velocity"),
        F.lit("m/s"),
    )
    return states.select(
        "snapshot_id",
        "pos",
        "icao24",
        callsign.alias("callsign"),
        "latitude",
        "longitude",
        "baro_altitude",
        "velocity",
        line.alias("line"),
    )


def head_states(landed: DataFrame, n: int = 5) -> DataFrame:
    """The first states of each snapshot as they arrived; cut before they are spread into rows."""
    cut = parse_snapshots(landed).withColumn("states", F.slice("states", 1, n))
    exploded = cut.select("snapshot_id", F.posexplode("states").alias("pos", "state"))
    return exploded.select("snapshot_id", "pos", typed_state(F.col("state")).alias("s")).select(
        "snapshot_id", "pos", "s.*"
    )


def snapshot_summary(landed: DataFrame) -> DataFrame:
    return parse_snapshots(landed).select(
        "snapshot_id",
        utc_text(F.coalesce("time", F.lit(0))).alias("response_time"),
        F.coalesce(F.size("states"), F.lit(0)).cast("bigint").alias("aircraft"),
    )


def export_documents(landed: DataFrame, n: int = 10) -> DataFrame:
    """Per snapshot one JSON document with its first states as named records, nulls kept."""
    # the exported record keeps the landed values, so only numbers and flags are typed
    kinds = {"decimal(9,6)": "double", "decimal(8,2)": "double", "decimal(7,2)": "double", "decimal(6,2)": "double"}

    def record(state: Column) -> Column:
        return F.struct(
            *[_field(state, i, kinds.get(kind, kind)).alias(name) for i, (name, kind) in enumerate(STATE_FIELDS)]
        )

    first = F.transform(F.slice(F.coalesce("states", F.array().cast("array<array<string>>")), 1, n), record)
    document = F.struct(F.coalesce("time", F.lit(0)).alias("time"), first.alias("states"))
    return parse_snapshots(landed).select(
        "snapshot_id", F.to_json(document, {"ignoreNullFields": "false"}).alias("document")
    )


def pretty(documents: DataFrame) -> DataFrame:
    """Re-indent exported documents for reading."""
    fields = ", ".join(
        f"{name}:{'double' if kind.startswith('decimal') else kind}" for name, kind in STATE_FIELDS
    )
    typed = F.from_json("document", f"time bigint, states array<struct<{fields}>>")
    return documents.withColumn("document", F.to_json(typed, {"ignoreNullFields": "false", "pretty": "true"}))


def write_export(landed: DataFrame, path: str, n: int = 10) -> None:
    """Write the documents as text, one file line per document."""
    export_documents(landed, n).select("document").write.mode("overwrite").text(path)


def first_exported_aircraft(document: str) -> Column:
    """The code of the first state of an exported document, or the sample code."""
    states = F.from_json(document, "states array<struct<icao24:string>>")["states"]
    return F.coalesce(F.try_element_at(states, F.lit(1))["icao24"], F.lit(SAMPLE_AIRCRAFT))


def flatten_histories(landed: DataFrame, head: int | None = None) -> DataFrame:
    """(icao24, batch, body) to one row per flight, in arrival order ``pos``."""
    flights = F.from_json("body", HISTORY_SCHEMA)
    if head is not None:
        flights = F.slice(flights, 1, head)
    rows = landed.select("icao24", "batch", F.posexplode(flights).alias("pos", "f"))
    return rows.select(
        "icao24",
        "batch",
        "pos",
        F.col("f.callsign").alias("callsign"),
        F.col("f.firstSeen").alias("first_seen"),
        F.col("f.lastSeen").alias("last_seen"),
        F.col("f.estDepartureAirport").alias("dep"),
        F.col("f.estArrivalAirport").alias("arr"),
    )


def route_labels(histories: DataFrame) -> DataFrame:
    dep, arr = or_default("dep", "Unknown"), or_default("arr", "Unknown")
    return histories.withColumn("route", F.concat(dep, F.lit(" → "), arr))


def recent(df: DataFrame, time: str, now: Column, window_s: int = 3600) -> DataFrame:
    """Rows whose epoch second ``time`` lies in [now - window_s, now]."""
    return df.filter(F.col(time).between(now - F.lit(window_s), now))


def history_counts(aircraft: DataFrame, histories: DataFrame) -> DataFrame:
    """History rows per listed aircraft; aircraft without any keep a zero."""
    counted = histories.groupBy("icao24").agg(F.count(F.lit(1)).alias("flights"))
    joined = aircraft.select("icao24").distinct().join(counted, "icao24", "left")
    return joined.select("icao24", F.coalesce("flights", F.lit(0)).alias("flights"))


def newest_snapshot(landed: DataFrame) -> DataFrame:
    """The single newest snapshot: latest time, then highest id."""
    parsed = parse_snapshots(landed)
    # the documents stay where they are: only (time, id) pairs are compared
    top = parsed.agg(F.max(F.struct("time", "snapshot_id")).alias("top"))
    newest = top.select("top.snapshot_id").scalar()
    return landed.filter(F.col("snapshot_id") == newest)


def history_of_newest(landed: DataFrame, histories: DataFrame) -> DataFrame:
    """Histories of the aircraft in the newest snapshot.

    ``is_sample`` marks the aircraft of its first state, the one the chained
    lookup asks for.
    """
    newest = newest_snapshot(landed)
    listed = flatten_states(newest).groupBy("icao24").agg((F.min("pos") == 0).alias("is_sample"))
    return lookup_join(histories, listed, ["icao24"], "inner")
