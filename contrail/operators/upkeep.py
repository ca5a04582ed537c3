"""Table upkeep: seeds, insert-if-absent, defaults, upserts, ids, retention, layout."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from contrail.operators.spread import dense_ids, is_small
from contrail.schemas import (
    AIRLINES,
    AIRPORTS,
    NO_DEFAULT,
    NOW,
    SEED_AIRLINES,
    SEED_AIRPORTS,
    Table,
)

RETENTION_HOURS = 168


def _literal_rows(spark: SparkSession, rows: list[tuple], table: Table) -> DataFrame:
    text = spark.createDataFrame(rows, ", ".join(f"{c.name} string" for c in table.columns))
    return text.select([F.col(c.name).cast(c.type) for c in table.columns])


def seed_airports(spark: SparkSession) -> DataFrame:
    return _literal_rows(spark, SEED_AIRPORTS, AIRPORTS)


def seed_airlines(spark: SparkSession) -> DataFrame:
    return _literal_rows(spark, SEED_AIRLINES, AIRLINES)


def first_per_key(df: DataFrame, keys: list[str], order: list[str | Column]) -> DataFrame:
    """The first row per key; copies are dropped on the map side, before the shuffle."""
    rest = [c for c in df.columns if c not in keys]
    ranked = df.select(*keys, F.struct(*order).alias("_order"), F.struct(*rest).alias("_row"))
    return ranked.groupBy(*keys).agg(F.min_by("_row", "_order").alias("_row")).select(*keys, "_row.*").select(
        df.columns
    )


def insert_ignore(target: DataFrame, batch: DataFrame, keys: list[str], order: list[str | Column]) -> DataFrame:
    """Target plus the batch rows whose key is new; the first of a repeated key wins.

    If the batch is counted small, its keys are broadcast to the target, and only the target
    keys that it names are compared; else both sides are shuffled.
    """
    first, known = first_per_key(batch, keys, order), target.select(*keys)
    if is_small(batch):
        known = known.join(F.broadcast(first.select(*keys)), keys, "left_semi")
    new = first.join(known, keys, "left_anti")
    return target.unionByName(new.select(target.columns))


def apply_defaults(df: DataFrame, table: Table, now: Column) -> DataFrame:
    """Add the columns the input omits, with their defaults; nulls given stay nulls."""
    given = set(df.columns)
    columns = []
    for c in table.columns:
        if c.name in given:
            value = F.col(c.name)
        elif c.default is NOW:
            value = now
        else:
            value = F.lit(None if c.default is NO_DEFAULT else c.default)
        columns.append(value.cast(c.type).alias(c.name))
    return df.select(columns)


def gate_upsert(flights: DataFrame, gate_events: DataFrame) -> DataFrame:
    """Flights with the actual times of their last published gate events."""

    def last(kind: str) -> Column:
        return F.max_by(
            F.when(F.col("gate_event") == kind, F.col("event_time")),
            F.when(F.col("gate_event") == kind, F.struct("published_at", "event_time")),
        )

    latest = gate_events.groupBy("flight_id").agg(
        last("departure").alias("_dep"), last("arrival").alias("_arr")
    )
    return (
        flights.join(latest, "flight_id", "left")
        .withColumn("actual_dep_time", F.coalesce("_dep", "actual_dep_time"))
        .withColumn("actual_arr_time", F.coalesce("_arr", "actual_arr_time"))
        .select(flights.columns)
    )


def assign_ids(df: DataFrame, id_name: str, natural_key: list[str], start: int = 1) -> DataFrame:
    """Fill an auto-increment column in the order of the natural key."""
    return dense_ids(df, natural_key, id_name, start)


def within_retention(df: DataFrame, time: str, hours: int = RETENTION_HOURS) -> DataFrame:
    """Rows at most ``hours`` older than the newest row."""
    newest = df.agg(F.max(time).alias("newest")).scalar()
    return df.filter(F.col(time) >= newest - F.make_dt_interval(hours=F.lit(hours)))


def write_by_date(positions: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Date-partitioned positions, clustered by aircraft and time inside each file.

    Ranges over day, aircraft and time give tasks of like size whatever the
    weight of a day or an aircraft, and a day lies in few files.
    """
    order = ["position_date", "icao24", "position_time"]
    (
        positions.withColumn("position_date", F.to_date("position_time"))
        .repartitionByRange(*order)
        .sortWithinPartitions(*order)
        .write.mode(mode)
        .partitionBy("position_date")
        .parquet(path)
    )


def read_day(spark: SparkSession, path: str, day: str) -> DataFrame:
    return spark.read.parquet(path).filter(F.col("position_date") == F.lit(day).cast("date"))
