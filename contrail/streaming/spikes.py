"""The altitude and speed rules on a stream, with state across micro-batches.

State is kept per aircraft and time bucket, with the same halo copies as the batch job, so one busy
aircraft is spread over its buckets. Samples are appended to a list in the state store as they come; an
event timer wakes the bucket once the watermark has passed its earliest waiting sample, and all
that it has passed are judged in time order. The order of arrival does not matter. What no
window can reach any more is dropped from the list when it makes up half of it, so a sample is written
once and rewritten once at most on average.

Lists and timers need the RocksDB state store: start the stream inside :func:`rocks_state`.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager
from decimal import Decimal

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from contrail.operators.cep import (
    ALTITUDE_M,
    ALTITUDE_WINDOW_S,
    KNOTS_100_M_PER_H,
    VELOCITY_WINDOW_S,
    WINDOW_BUCKET_S,
)
from contrail.operators.spread import with_halo
from contrail.streaming.jobs import WATERMARK

HIT_SCHEMA = "icao24 string, position_id bigint, micros bigint, event_type string, up bigint, down bigint"
# altitude and speed in hundredths
SAMPLE_SCHEMA = "micros bigint, position_id bigint, alt bigint, vel bigint, is_context boolean"
FIELDS = ["micros", "position_id", "alt", "vel", "is_context"]
PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"

# name, field, window, factor and limit that a change times the factor must reach
RULES = (
    ("altitude_spike", "alt", ALTITUDE_WINDOW_S, 1, int(ALTITUDE_M * 100)),
    ("velocity_spike", "vel", VELOCITY_WINDOW_S, 3600, KNOTS_100_M_PER_H * 100),
)
REACH_US = VELOCITY_WINDOW_S * 1_000_000


@contextmanager
def rocks_state(spark: SparkSession):
    """Streams that start inside keep their state in RocksDB."""
    before = spark.conf.get(PROVIDER, None)
    spark.conf.set(PROVIDER, ROCKS)
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(PROVIDER)
        else:
            spark.conf.set(PROVIDER, before)


def changes(times: np.ndarray, values: pd.Series, seconds: int) -> tuple[np.ndarray, np.ndarray]:
    """Rise over the lowest and fall from the highest value of each trailing window, both ends included.

    Times ascend. Missing values have no change and count for no window.
    """
    series = pd.Series(values.to_numpy("float64", na_value=np.nan), index=pd.to_datetime(times, unit="us"))
    window = series.rolling(f"{seconds}s", closed="both", min_periods=1)
    up, down = series - window.min(), series - window.max()
    return up.fillna(0).to_numpy().astype("int64"), down.fillna(0).to_numpy().astype("int64")


def judge(samples: pd.DataFrame, since: int, passed: int) -> list[tuple]:
    """Hits among the samples of ``since`` <= time < ``passed``; of one instant the lowest id stands."""
    known = samples[samples["micros"] < passed].sort_values(["micros", "position_id"]).drop_duplicates("micros")
    times = known["micros"].to_numpy()
    due = (times >= since) & ~known["is_context"].to_numpy(bool)
    hits = []
    for name, field, seconds, factor, limit in RULES if due.any() else ():
        up, down = changes(times, known[field], seconds)
        found = due & ((up * factor >= limit) | (down * factor <= -limit))
        ids = known["position_id"].to_numpy()
        hits += [
            (int(i), int(t), name, int(u), int(d)) for i, t, u, d in zip(ids[found], times[found], up[found], down[found])
        ]
    return hits


def as_samples(frame: pd.DataFrame) -> list[tuple]:
    """Rows as the state store takes them."""
    whole = lambda value: None if pd.isna(value) else int(value)
    return [(int(t), int(i), whole(a), whole(v), bool(c)) for t, i, a, v, c in frame.itertuples(index=False)]


class SpikeRules(StatefulProcessor):
    """One aircraft and time bucket: waiting samples, how far they were judged, when to wake."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.samples = handle.getListState("samples", SAMPLE_SCHEMA)
        self.judged = handle.getValueState("judged", "until bigint")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        earliest = None
        for frame in rows:
            if len(frame):
                frame = frame[FIELDS].sort_values(["micros", "position_id"]).drop_duplicates("micros")
                self.samples.appendList(as_samples(frame))
                first = int(frame["micros"].iloc[0])
                earliest = first if earliest is None else min(earliest, first)
        if earliest is not None:
            self._wake(earliest, timerValues.getCurrentWatermarkInMs())
        return iter(())

    def _wake(self, micros: int, watermark: int) -> None:
        at = max(micros // 1000 + 1, watermark + 1)
        # those that the watermark has reached go off in this batch
        if not any(watermark < timer <= at for timer in self.handle.listTimers()):
            self.handle.registerTimer(at)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        mark = timerValues.getCurrentWatermarkInMs()
        passed = mark * 1000
        held = self.judged.get()
        since = held[0] if held else 0
        samples = pd.DataFrame(list(self.samples.get()), columns=FIELDS)
        hits = judge(samples, since, passed) if len(samples) else []
        times = samples["micros"].to_numpy("int64")
        waiting, near = times >= passed, times >= passed - REACH_US
        if not near.any():
            self.samples.clear()
            self.judged.clear()
        else:
            if 2 * near.sum() <= len(times):
                self.samples.put(as_samples(samples[near]))
            self.judged.update((passed,))
            # the next sample, or else when the last one can be forgotten
            self._wake(int(times[waiting].min()) if waiting.any() else int(times.max()) + REACH_US, mark)
        rows = [(key[0], *hit) for hit in hits]
        yield pd.DataFrame(rows, columns=["icao24", "position_id", "micros", "event_type", "up", "down"])

    def close(self) -> None:
        pass


def stream_spikes(positions: DataFrame, bucket_s: int = WINDOW_BUCKET_S) -> DataFrame:
    """Hits as (icao24, position_id, position_time, event_type, d_up, d_dn)."""
    hundredths = lambda c: (F.col(c) * Decimal("100")).cast("bigint")
    samples = positions.select(
        "icao24",
        "position_id",
        "position_time",
        F.unix_micros("position_time").alias("micros"),
        hundredths("baro_altitude").alias("alt"),
        hundredths("velocity").alias("vel"),
    ).withWatermark("position_time", WATERMARK)
    halo = with_halo(samples, "position_time", bucket_s, max(ALTITUDE_WINDOW_S, VELOCITY_WINDOW_S))
    hits = halo.groupBy("icao24", "bucket").transformWithStateInPandas(
        SpikeRules(), HIT_SCHEMA, outputMode="append", timeMode="eventTime"
    )
    metres = lambda c: (F.col(c).cast("decimal(18,0)") / Decimal("100")).cast("decimal(9,2)")
    return hits.select(
        "icao24",
        "position_id",
        F.timestamp_micros("micros").alias("position_time"),
        "event_type",
        metres("up").alias("d_up"),
        metres("down").alias("d_dn"),
    )
