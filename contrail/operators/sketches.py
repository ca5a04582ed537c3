"""Quantile sketches per period and group: stored once, merged for every wider question.

A sketch holds a bounded sample of its values with weights (KLL). Merging two gives what
one sketch over both parts would promise, so a store of small periods answers for any longer one.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F

from contrail.operators.serving import LATE_MIN
from contrail.operators.spread import lookup_join

K = 1024


def rank_error(k: int = K) -> float:
    """The error of a rank, as a share of the rows, that 99 of 100 answers stay within.

    It is the published fit for this sketch; twice as much is left in less than one of a million answers.
    """
    return 2.296 / k**0.9723


def day_sketches(rows: DataFrame, by: list[str], value: str, late_min: int = LATE_MIN, k: int = K) -> DataFrame:
    """Per group: rows, late rows, sum and sketch of ``value``, nulls left out; combined before the shuffle."""
    known = rows.filter(F.col(value).isNotNull())
    return known.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(F.col(value) >= late_min).alias("late_n"),
        F.sum(F.col(value).cast("decimal(18,6)")).alias("total"),
        F.kll_sketch_agg_double(F.col(value).cast("double"), F.lit(k)).alias("sketch"),
    )


def store(sketches: DataFrame, path: str, period: str) -> None:
    """Put the sketches of whole periods into the table; what it held of these periods is replaced, so a repeat is harmless.

    ``period`` is the column that the table is split by. A task writes groups of its periods only, never their rows.
    """
    (
        sketches.repartition(period)
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy(period)
        .parquet(path)
    )


def merge(sketches: DataFrame, by: list[str], k: int = K) -> DataFrame:
    """The same columns for wider groups, from the sketches alone."""
    return sketches.groupBy(*by).agg(
        F.sum("n").alias("n"),
        F.sum("late_n").alias("late_n"),
        F.sum("total").alias("total"),
        F.kll_merge_agg_double("sketch", F.lit(k)).alias("sketch"),
    )


def figures(merged: DataFrame, by: list[str]) -> DataFrame:
    """The columns of ``serving.delay_stats``; median and p90 are values of the data within the rank error."""
    at = F.kll_sketch_get_quantile_double("sketch", F.array(F.lit(0.5), F.lit(0.9)))
    return merged.withColumn("_q", at).select(
        *by,
        F.col("n").alias("flights"),
        F.round(F.col("total").cast("double") / F.col("n"), 6).alias("mean_delay"),
        F.col("_q")[0].alias("median_delay"),
        F.col("_q")[1].alias("p90_delay"),
        F.round(F.col("late_n").cast("double") / F.col("n"), 6).alias("late_share"),
    )


def measured(rows: DataFrame, answers: DataFrame, by: list[str], value: str, asked: dict[str, float]) -> DataFrame:
    """How far each answered quantile is from the asked rank, counted over all rows: one column ``<answer>_error``.

    An answer stands for all ranks its equal values cover, so the error is zero inside them.
    """
    known = rows.filter(F.col(value).isNotNull()).select(*by, value)
    met = lookup_join(known, answers.select(*by, *asked), by, "inner")
    counts = [F.count(F.lit(1)).alias("_n")]
    for name in asked:
        counts += [F.count_if(F.col(value) < F.col(name)).alias(f"_{name}_below")]
        counts += [F.count_if(F.col(value) <= F.col(name)).alias(f"_{name}_to")]
    counted = met.groupBy(*by).agg(*counts)
    n = F.col("_n").cast("double")
    errors = [
        F.greatest(F.lit(0.0), F.col(f"_{name}_below") / n - rank, rank - F.col(f"_{name}_to") / n).alias(f"{name}_error")
        for name, rank in asked.items()
    ]
    return counted.select(*by, F.col("_n").alias("rows"), *errors)


def feature_sketches(rows: DataFrame, period: Column, features: list[str], k: int = K) -> DataFrame:
    """(period, feature, n, sketch): one pass, each row adds one value per feature."""
    values = F.array(*[F.struct(F.lit(f).alias("feature"), F.col(f).cast("double").alias("x")) for f in features])
    return (
        rows.select(period.alias("period"), F.explode(values).alias("v"))
        .filter("v.x IS NOT NULL AND NOT isnan(v.x)")
        .groupBy("period", "v.feature")
        .agg(F.count(F.lit(1)).alias("n"), F.kll_sketch_agg_double("v.x", F.lit(k)).alias("sketch"))
    )


def _edges(low: float, high: float, bins: int) -> list[float]:
    return [low + (high - low) / bins * i for i in range(1, bins)]


def shares_below(sketch: Column, edges: list[float]) -> Column:
    """The share of values below each edge."""
    # the rank of a value counts the value itself, so ask just under the edge
    under = F.array(*[F.lit(float(np.nextafter(e, -math.inf))) for e in edges])
    return F.kll_sketch_get_rank_double(sketch, under)


def drift(sketches: DataFrame, is_current: Column, ranges: dict[str, tuple[float, float]], bins: int = 10, k: int = K) -> DataFrame:
    """Population stability index per feature between any two sets of stored periods, without the rows.

    Bins and floor are those of ``features.drift_psi``. A feature that one side never saw has an empty
    side there, whose bins all count as the floor. Returns (feature, psi, ref_rows, cur_rows, ref_below, cur_below).
    """
    side = lambda c, cur: F.when(is_current if cur else ~is_current, F.col(c))
    sides = sketches.filter(F.col("feature").isin(*ranges)).groupBy("feature").agg(
        F.coalesce(F.sum(side("n", False)), F.lit(0)).alias("ref_rows"),
        F.coalesce(F.sum(side("n", True)), F.lit(0)).alias("cur_rows"),
        F.kll_merge_agg_double(side("sketch", False), F.lit(k)).alias("_ref"),
        F.kll_merge_agg_double(side("sketch", True), F.lit(k)).alias("_cur"),
    )

    def below(name: str) -> Column:
        told = F.lit(None)
        for feature, (low, high) in ranges.items():
            ranks = shares_below(F.col(f"_{name}"), _edges(low, high, bins))
            told = F.when((F.col("feature") == feature) & (F.col(f"{name}_rows") > 0), ranks).otherwise(told)
        return told

    cut = sides.withColumn("ref_below", below("ref")).withColumn("cur_below", below("cur"))
    nothing = F.array_repeat(F.lit(0.0), bins)

    def shares(name: str) -> Column:
        ends = F.concat(F.array(F.lit(0.0)), F.col(name), F.array(F.lit(1.0)))
        steps = F.transform(F.sequence(F.lit(1), F.lit(bins)), lambda i: F.get(ends, i) - F.get(ends, i - 1))
        return F.transform(F.coalesce(steps, nothing), lambda s: F.greatest(s, F.lit(1e-4)))

    parts = F.zip_with(shares("cur_below"), shares("ref_below"), lambda c, r: (c - r) * F.log(c / r))
    psi = F.round(F.aggregate(parts, F.lit(0.0), lambda a, x: a + x), 6).alias("psi")
    return cut.select("feature", psi, "ref_rows", "cur_rows", "ref_below", "cur_below")


def counted_below(rows: DataFrame, is_current: Column, ranges: dict[str, tuple[float, float]], bins: int = 10) -> DataFrame:
    """What the two arrays of :func:`drift` estimate, counted over all rows; a side without rows is null."""
    cells = F.array(
        *[
            F.struct(
                F.lit(f).alias("feature"),
                F.col(f).cast("double").alias("x"),
                F.array(*[F.lit(e) for e in _edges(low, high, bins)]).alias("edges"),
            )
            for f, (low, high) in ranges.items()
        ]
    )
    values = rows.select(is_current.alias("cur"), F.explode(cells).alias("v")).filter("v.x IS NOT NULL AND NOT isnan(v.x)")
    below = lambda i, cur: F.count_if((F.col("v.x") < F.col("v.edges")[i]) & (F.col("cur") if cur else ~F.col("cur")))
    ref_n, cur_n = F.count_if(~F.col("cur")), F.count_if("cur")
    share = lambda cur, n: F.array(*[F.try_divide(below(i, cur).cast("double"), n) for i in range(bins - 1)])
    return values.groupBy("v.feature").agg(
        F.when(ref_n > 0, share(False, ref_n)).alias("ref_exact"), F.when(cur_n > 0, share(True, cur_n)).alias("cur_exact")
    )
