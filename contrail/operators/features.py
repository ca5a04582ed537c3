"""Point-in-time delay features, model metrics and drift."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F, Window as W

from contrail.operators.joins import weather_before, with_delays
from contrail.operators.spread import lookup_join, with_halo

LEAD_MIN = 15
TRAILING_S = 3 * 3600


def trailing_departures(cutoffs: DataFrame, departures: DataFrame, trailing_s: int = TRAILING_S) -> DataFrame:
    """For each (origin, cutoff): finished departures in (cutoff - trailing, cutoff] and their delay sum.

    ``departures`` has (origin_airport, at, delay). Both sides are first reduced to
    one row per airport and instant; the window then runs on short time buckets.
    """
    points = cutoffs.select("origin_airport", F.col("cutoff").alias("at")).distinct()
    done = departures.groupBy("origin_airport", "at").agg(
        F.count(F.lit(1)).alias("n"), F.sum("delay").alias("total")
    )
    zero = F.lit(0).cast("bigint")
    both = done.withColumn("probe", F.lit(False)).unionByName(
        points.withColumn("n", zero).withColumn("total", zero).withColumn("probe", F.lit(True))
    )
    frame = (
        W.partitionBy("origin_airport", "bucket")
        .orderBy(F.unix_micros("at"))
        .rangeBetween(-trailing_s * 1_000_000 + 1, W.currentRow)
    )
    return (
        with_halo(both, "at", 86_400, trailing_s)
        .withColumn("recent_flights", F.sum("n").over(frame))
        .withColumn("recent_delay", F.sum("total").over(frame))
        .filter("probe AND NOT is_context")
        .select("origin_airport", F.col("at").alias("cutoff"), "recent_flights", "recent_delay")
    )


def delay_features(flights: DataFrame, weather: DataFrame, lead_min: int = LEAD_MIN) -> DataFrame:
    """What is known about a flight ``lead_min`` minutes before its scheduled departure.

    A departure counts as finished at its actual time, so nothing after the
    cutoff reaches the features.
    """
    delays = with_delays(flights).withColumn(
        "cutoff", F.col("scheduled_dep_time") - F.make_dt_interval(mins=F.lit(lead_min))
    )
    departures = delays.filter("actual_dep_time IS NOT NULL AND origin_airport IS NOT NULL").select(
        "origin_airport", F.col("actual_dep_time").alias("at"), F.col("dep_delay_min").cast("bigint").alias("delay")
    )
    recent = trailing_departures(delays, departures)
    base = delays.select(
        "flight_id",
        "carrier_code",
        "origin_airport",
        "cutoff",
        "scheduled_dep_time",
        F.hour("scheduled_dep_time").alias("dep_hour"),
        (F.weekday("scheduled_dep_time") + 1).alias("dep_weekday"),
        "distance_miles",
        "dep_delay_min",
    )
    joined = lookup_join(base, recent, ["origin_airport", "cutoff"], small_rows=0)
    joined = joined.withColumn("recent_flights", F.coalesce("recent_flights", F.lit(0))).withColumn(
        "recent_mean_delay",
        F.round(F.try_divide(F.col("recent_delay").cast("double"), F.col("recent_flights")), 6),
    )
    return weather_before(
        joined.drop("recent_delay"), weather, ["wind_speed_knots", "visibility_miles"], time="cutoff"
    )


def mean_by_origin(train: DataFrame, scored: DataFrame) -> DataFrame:
    """A baseline prediction: the origin's mean known delay in the training rows."""
    means = train.filter("dep_delay_min IS NOT NULL").groupBy("origin_airport").agg(
        F.round(F.sum("dep_delay_min").cast("decimal(18,0)") / F.count(F.lit(1)), 2)
        .cast("decimal(10,2)")
        .alias("prediction")
    )
    return lookup_join(scored, means, ["origin_airport"])


def model_metrics(scored: DataFrame, by: str = "carrier_code") -> DataFrame:
    """MAE, RMSE and bias overall and per group, from exact decimal sums."""
    error = (F.col("prediction") - F.col("dep_delay_min")).cast("decimal(12,2)")
    known = scored.filter("dep_delay_min IS NOT NULL AND prediction IS NOT NULL").withColumn("e", error)
    rolled = known.rollup(by).agg(
        F.grouping_id().alias("level"),
        F.count(F.lit(1)).alias("rows"),
        F.sum(F.abs("e")).alias("abs_sum"),
        F.sum(F.col("e") * F.col("e")).alias("sq_sum"),
        F.sum("e").alias("sum"),
    )
    mean = lambda c: F.col(c).cast("double") / F.col("rows")
    return rolled.select(
        F.when(F.col("level") == 1, "ALL").otherwise(F.col(by)).alias("group"),
        "rows",
        F.round(mean("abs_sum"), 6).alias("mae"),
        F.round(F.sqrt(mean("sq_sum")), 6).alias("rmse"),
        F.round(mean("sum"), 6).alias("bias"),
    )


def drift_psi(df: DataFrame, is_current: Column, features: dict[str, tuple[float, float]], bins: int = 10) -> DataFrame:
    """Population stability index per feature between a reference and a current part.

    ``features`` maps a column to the range its equal-width bins cover; values
    outside go to the end bins. Empty bins count as a share of 1e-4.
    """

    def bin_of(name: str) -> Column:
        low, high = features[name]
        place = F.floor((F.col(name).cast("double") - low) / ((high - low) / bins))
        return F.greatest(F.lit(0), F.least(F.lit(bins - 1), place)).cast("int")

    # one pass: every row adds one cell per feature, combined before the shuffle
    cells = F.array(
        *[
            F.struct(F.lit(name).alias("feature"), bin_of(name).alias("bin"), F.col(name).isNotNull().alias("given"))
            for name in features
        ]
    )
    counted = (
        df.select(is_current.alias("cur"), F.explode(cells).alias("c"))
        .filter("c.given")
        .groupBy("c.feature", "c.bin")
        .agg(F.count_if(~F.col("cur")).alias("ref_n"), F.count_if("cur").alias("cur_n"))
    )
    totals = counted.groupBy("feature").agg(F.sum("ref_n").alias("ref_all"), F.sum("cur_n").alias("cur_all"))
    # bins nobody fell into have equal floors on both sides and add nothing
    floor = F.lit(1e-4)
    share = lambda n, total: F.greatest(F.try_divide(F.col(n).cast("double"), F.col(total)), floor)
    ref, cur = share("ref_n", "ref_all"), share("cur_n", "cur_all")
    return (
        lookup_join(counted, totals, ["feature"], "inner", small_rows=0)
        .groupBy("feature")
        .agg(
            F.round(F.sum((cur - ref) * F.log(cur / ref)), 6).alias("psi"),
            F.max("ref_all").alias("ref_rows"),
            F.max("cur_all").alias("cur_rows"),
        )
    )
