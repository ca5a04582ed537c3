"""Joins and time-ordered lookups that hold when one key owns much of the data.

Nothing here puts a whole key into one task. Lookups run on (key, time bucket)
groups over rows that were already combined on the map side, and joins against a
unique side either broadcast after a size check or split the hot keys.
"""

from __future__ import annotations

from collections.abc import Iterator
from weakref import WeakKeyDictionary

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F, Window as W

from contrail.session import written

BROADCAST_ROWS = 100_000

_counted: WeakKeyDictionary[DataFrame, dict[int, bool]] = WeakKeyDictionary()


def is_small(df: DataFrame, rows: int = BROADCAST_ROWS) -> bool:
    """True when the frame is counted to hold at most ``rows`` rows.

    The answer is kept as long as this very frame object lives, so a dimension
    used several times in one query is counted once.
    """
    answers = _counted.setdefault(df, {})
    if rows not in answers:
        answers[rows] = df.select(F.lit(1)).limit(rows + 1).count() <= rows
    return answers[rows]


def lookup_join(
    facts: DataFrame,
    unique: DataFrame,
    on: list[str],
    how: str = "left",
    small_rows: int = BROADCAST_ROWS,
    counted: DataFrame | None = None,
) -> DataFrame:
    """Join to a side holding one row per key.

    A side counted to hold at most ``small_rows`` rows is broadcast; pass 0 to skip
    the count where the side is known to be large. ``counted`` names a frame to
    count instead, one that has at least as many rows. Otherwise both sides are
    shuffled. A side that was counted large, and any that meets a stream, is so by a hint: the
    planner goes by the size of compressed files and would send it through the driver, where it
    is many times as large. Null keys match nothing and are spread over tasks. A hot key is
    split by adaptive execution, which sees the real partition sizes.
    """
    if small_rows and is_small(unique if counted is None else counted, small_rows):
        return facts.join(F.broadcast(unique), on, how)
    has_key = F.lit(True)
    for name in on:
        has_key = has_key & F.col(name).isNotNull()
    spread = F.pmod(F.xxhash64(*facts.columns), F.lit(1024))
    salted = facts.withColumn("_salt", F.when(has_key, 0).otherwise(spread).cast("int"))
    looked_up = unique.withColumn("_salt", F.lit(0))
    looked_up = looked_up.hint("merge") if small_rows or facts.isStreaming else looked_up
    return salted.join(looked_up, [*on, "_salt"], how).drop("_salt")


def time_bucket(time: str | Column, seconds: int) -> Column:
    column = F.col(time) if isinstance(time, str) else time
    return F.floor(F.unix_micros(column) / F.lit(seconds * 1_000_000)).cast("long")


def with_halo(df: DataFrame, time: str, bucket_s: int, halo_s: int) -> DataFrame:
    """Split a series into time buckets that each see ``halo_s`` seconds of the past.

    Adds ``bucket`` and ``is_context``; context rows are copies that later windows
    may look at but must not emit. Buckets are at least as long as the halo, so a
    row is copied once at most.
    """
    if bucket_s < halo_s:
        raise ValueError("bucket must not be shorter than the halo")
    own = time_bucket(time, bucket_s)
    to_next = (own + 1) * F.lit(bucket_s * 1_000_000) - F.unix_micros(time)
    buckets = F.when(to_next <= F.lit(halo_s * 1_000_000), F.array(own, own + 1)).otherwise(F.array(own))
    return df.withColumn("bucket", F.explode(buckets)).withColumn("is_context", F.col("bucket") != own)


def last_known(
    probes: DataFrame,
    facts: DataFrame,
    key: str,
    probe_time: str,
    fact_time: str,
    value: str,
    order_by: str,
    bucket_s: int = 86_400,
) -> DataFrame:
    """As-of lookup: for each distinct (key, probe_time) the value at or before it.

    ``value`` is a struct column of ``facts``; of several facts at one instant the
    greatest ``order_by`` wins. The reach into the past is not limited: each bucket
    starts from the last value of all earlier buckets, carried over a table with one
    row per (key, bucket).
    """
    points = probes.filter(F.col(key).isNotNull() & F.col(probe_time).isNotNull())
    points = points.select(key, F.col(probe_time).alias("_t")).distinct()
    known = (
        facts.filter(F.col(key).isNotNull() & F.col(fact_time).isNotNull())
        .groupBy(key, F.col(fact_time).alias("_t"))
        .agg(F.max_by(value, order_by).alias("_v"))
    )
    both = points.withColumn("_v", F.lit(None).cast(known.schema["_v"].dataType)).withColumn("_probe", F.lit(True))
    both = both.unionByName(known.withColumn("_probe", F.lit(False))).withColumn("_b", time_bucket("_t", bucket_s))

    # last value of each bucket, then of everything before each bucket
    ends = both.groupBy(key, "_b").agg(
        F.max_by("_v", F.when(~F.col("_probe"), F.col("_t"))).alias("_end")
    )
    before = W.partitionBy(key).orderBy("_b").rowsBetween(W.unboundedPreceding, -1)
    carried = ends.select(key, "_b", F.last("_end", ignorenulls=True).over(before).alias("_carry"))

    # facts sort before probes of the same instant, so "at" counts
    running = W.partitionBy(key, "_b").orderBy("_t", "_probe").rowsBetween(W.unboundedPreceding, W.currentRow)
    found = both.withColumn("_in", F.last("_v", ignorenulls=True).over(running)).filter("_probe")
    found = found.join(carried, [key, "_b"], "left")
    return found.select(
        key, F.col("_t").alias(probe_time), F.coalesce("_in", "_carry").alias(value)
    )


def interval_segments(
    intervals: DataFrame, key: str, start: str, end: str, value: str, bucket_s: int
) -> DataFrame:
    """Disjoint segments per (key, time bucket), each with the interval that started last.

    Columns: key, ``bucket``, ``lo``, ``hi`` (microseconds, both inclusive) and the value. Intervals
    are cut at the bucket bounds, so the sweep over a bucket needs no other one; it keeps
    the intervals that are open on a stack, the latest on top.
    """
    width = bucket_s * 1_000_000
    first, last = F.unix_micros(start), F.unix_micros(end)
    cut = (
        intervals.filter(F.col(key).isNotNull() & (F.col(start) <= F.col(end)))
        .select(key, first.alias("begun"), last.alias("over"), F.col(value).cast("bigint").alias(value))
        .withColumn(
            "bucket",
            F.explode(
                F.sequence(
                    F.floor(F.col("begun") / F.lit(width)).cast("bigint"),
                    F.floor(F.col("over") / F.lit(width)).cast("bigint"),
                )
            ),
        )
        .withColumn("lo", F.greatest("begun", F.col("bucket") * width))
        .withColumn("hi", F.least("over", (F.col("bucket") + 1) * width - 1))
        .select(key, "bucket", "begun", "lo", "hi", value)
    )
    ordered = cut.repartition(key, "bucket").sortWithinPartitions(key, "bucket", "begun", value)
    columns = [key, "bucket", "lo", "hi", value]

    def sweep(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        group, now, stack = None, 0, []

        def close(until: float, out: list[tuple]) -> None:
            """Write what the open intervals cover before ``until``."""
            nonlocal now
            while stack and now < until:
                hi, owner = stack[-1]
                if hi < now:
                    stack.pop()
                    continue
                out.append((*group, now, int(min(hi, until - 1)), owner))
                now = int(min(hi + 1, until))

        for batch in batches:
            out: list[tuple] = []
            for k, bucket, lo, hi, owner in batch[columns].itertuples(index=False):
                if (k, bucket) != group:
                    close(float("inf"), out)
                    stack.clear()
                    group = (k, bucket)
                else:
                    close(lo, out)
                now = lo
                stack.append((hi, owner))
            yield pd.DataFrame(out, columns=columns)
        out = []
        close(float("inf"), out)
        yield pd.DataFrame(out, columns=columns)

    kind = intervals.schema[key].dataType.simpleString()
    return ordered.mapInPandas(sweep, f"{key} {kind}, bucket bigint, lo bigint, hi bigint, {value} bigint")


def best_interval(
    points: DataFrame,
    intervals: DataFrame,
    key: str,
    time: str,
    start: str,
    end: str,
    value: str,
    bucket_s: int = 3600,
) -> DataFrame:
    """Points with the value of the interval of their key that holds their time, else null.

    Both ends are inclusive, to the microsecond. Of several intervals the one that started
    last counts, then the highest value. Points are shuffled once, by key and time bucket; inside
    a bucket each takes the last segment that started before it.
    """
    segments = interval_segments(intervals, key, start, end, value, bucket_s)
    at = F.unix_micros(time)
    # points that nothing can hold are spread over tasks
    bucket = F.coalesce(F.floor(at / F.lit(bucket_s * 1_000_000)), F.xxhash64(*points.columns) % 4096).cast("bigint")
    bucket = F.when(F.col(key).isNull(), F.xxhash64(*points.columns) % 4096).otherwise(bucket)
    probes = points.select(*points.columns, bucket.alias("_b"), at.alias("_t"), F.lit(True).alias("_point"))
    starts = segments.select(
        key,
        F.col("bucket").alias("_b"),
        F.col("lo").alias("_t"),
        F.lit(False).alias("_point"),
        F.struct("hi", F.col(value).alias("v")).alias("_s"),
    )
    both = probes.unionByName(starts, allowMissingColumns=True)
    # a segment that starts at the very time of a point comes first
    before = W.partitionBy(key, "_b").orderBy("_t", "_point").rowsBetween(W.unboundedPreceding, W.currentRow)
    found = both.withColumn("_s", F.last("_s", ignorenulls=True).over(before)).filter("_point")
    held = F.when(F.col("_t") <= F.col("_s.hi"), F.col("_s.v"))
    return found.select(*points.columns, held.alias(value))


def dense_ids(df: DataFrame, order_by: list[str], id_name: str, start: int = 1) -> DataFrame:
    """Consecutive ids in the order of ``order_by``, without a global window.

    Rows are range-partitioned and sorted, numbered inside each partition and
    shifted by the size of the partitions before it. The numbered rows are
    written first, so a lost executor cannot number them anew.
    """
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    numbered = written(
        df.repartitionByRange(parts, *order_by)
        .sortWithinPartitions(*order_by)
        .withColumn("_seq", F.monotonically_increasing_id())
        .withColumn("_part", F.shiftright("_seq", 33))
        .withColumn("_seq", F.col("_seq").bitwiseAND(F.lit((1 << 33) - 1))),
        "numbered",
    )
    # one row per partition, so the window below is as small as the task count
    sizes = numbered.groupBy("_part").agg(F.count(F.lit(1)).alias("_size"))
    before = W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    shifts = sizes.select("_part", F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_shift"))
    return (
        numbered.join(F.broadcast(shifts), "_part")
        .withColumn(id_name, F.col("_seq") + F.col("_shift") + F.lit(start))
        .drop("_seq", "_part", "_shift")
    )
