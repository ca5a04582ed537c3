"""Delay model with Spark ML: gradient-boosted trees, permutation importance and Shapley values."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import GBTRegressor
from pyspark.sql import DataFrame, Window as W, functions as F

from contrail.operators import shapley
from contrail.operators.spread import lookup_join
from contrail.session import written

TEXT = ["carrier_code", "origin_airport"]
NUMBERS = [
    "dep_hour",
    "dep_weekday",
    "distance",
    "recent_flights",
    "recent_mean_delay",
    "wind_speed_knots",
    "visibility_miles",
]
INPUTS = [f"{c}_mean" for c in TEXT] + NUMBERS


def model_rows(features: DataFrame) -> DataFrame:
    """Feature rows with known delay as plain numbers; missing values are marked by -1."""
    number = lambda c: F.coalesce(F.col(c).cast("double"), F.lit(-1.0)).alias(c)
    text = lambda c: F.coalesce(F.col(c), F.lit("")).alias(c)
    prepared = features.filter("dep_delay_min IS NOT NULL").withColumn("distance", F.col("distance_miles"))
    return prepared.select(
        "flight_id",
        "scheduled_dep_time",
        F.col("dep_delay_min").cast("double").alias("label"),
        *[text(c) for c in TEXT],
        *[number(c) for c in NUMBERS],
    )


def split_by_time(rows: DataFrame, share: float = 0.8) -> tuple[DataFrame, DataFrame]:
    """Train on the earlier part, test on the later: no flight of the future is seen."""
    at = rows.agg(F.percentile_approx(F.unix_micros("scheduled_dep_time"), F.lit(share)).alias("t")).scalar()
    when = F.unix_micros("scheduled_dep_time")
    return rows.filter(when <= at), rows.filter(when > at)


@dataclass
class DelayModel:
    """Trees over numbers, and the mean delay that stands for each carrier and origin."""

    trees: PipelineModel
    means: dict[str, DataFrame]
    overall: float


def _encoded(rows: DataFrame, means: dict[str, DataFrame], overall: float) -> DataFrame:
    """Text columns as the mean delay of their value in training; unknown values as the overall mean."""
    for column, table in means.items():
        rows = lookup_join(rows, table, [column])
        rows = rows.withColumn(f"{column}_mean", F.coalesce(f"{column}_mean", F.lit(overall)))
    return rows


def fit(train: DataFrame, iterations: int = 10, depth: int = 4, seed: int = 11, weight: float = 20.0) -> DelayModel:
    """Carriers and airports become numbers, so any count of them will do.

    A value's mean is drawn towards the overall mean as if ``weight`` more rows had that one.
    """
    overall = float(train.agg(F.avg("label").alias("m")).first()["m"] or 0.0)
    means = {}
    for column in TEXT:
        mean = (F.sum("label") + F.lit(overall * weight)) / (F.count("label") + F.lit(weight))
        table = train.groupBy(column).agg(F.round(mean, 6).alias(f"{column}_mean"))
        means[column] = written(table, "delay-means")
    trees = Pipeline(
        stages=[
            VectorAssembler(inputCols=INPUTS, outputCol="features"),
            GBTRegressor(labelCol="label", maxIter=iterations, maxDepth=depth, seed=seed),
        ]
    ).fit(_encoded(train, means, overall))
    return DelayModel(trees, means, overall)


def predict(model: DelayModel, rows: DataFrame) -> DataFrame:
    return model.trees.transform(_encoded(rows, model.means, model.overall))


def score(model: DelayModel, rows: DataFrame) -> DataFrame:
    return predict(model, rows).select("flight_id", "label", "prediction")


def permuted_copies(rows: DataFrame, group_rows: int = 1000) -> DataFrame:
    """Each row once as it is and once per feature with that feature taken from another row.

    The partner is the next row in hash order inside a hash group of about
    ``group_rows`` rows; the groups come from a unique id, so none is large.
    """
    columns = TEXT + NUMBERS
    groups = max(1, rows.count() // group_rows)
    order = W.partitionBy("_g").orderBy(F.xxhash64("flight_id", F.lit(3)), "flight_id")
    whole = order.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    values = F.struct(*columns)
    paired = rows.withColumn("_g", F.pmod(F.xxhash64("flight_id"), F.lit(groups))).withColumn(
        "_other", F.coalesce(F.lead(values).over(order), F.first(values).over(whole))
    )
    variants = F.array(*[F.lit(v) for v in ["", *columns]])
    spread = paired.withColumn("changed", F.explode(variants))
    swapped = [F.when(F.col("changed") == c, F.col(f"_other.{c}")).otherwise(F.col(c)).alias(c) for c in columns]
    return spread.select("flight_id", "label", "changed", *swapped)


def permutation_importance(model: DelayModel, rows: DataFrame) -> DataFrame:
    """Rise of the mean absolute error when one feature is permuted. This is not SHAP."""
    scored = predict(model, permuted_copies(rows))
    errors = scored.groupBy("changed").agg(
        F.avg(F.abs(F.col("label") - F.col("prediction"))).alias("mae"), F.count(F.lit(1)).alias("rows")
    )
    base = errors.filter("changed = ''").select("mae").scalar()
    return errors.filter("changed != ''").select(
        F.col("changed").alias("feature"), F.round(F.col("mae") - base, 6).alias("importance"), "rows"
    )


def shapley_rows(model: DelayModel, rows: DataFrame, background: DataFrame) -> DataFrame:
    """flight_id, prediction, base and the value of every input: base and values add up to the prediction.

    ``background`` are the rows that say how common each branch is, usually those of the training.
    """
    encoded = lambda frame: _encoded(frame, model.means, model.overall)
    trees = shapley.covers(shapley.trees_of(model.trees.stages[-1]), encoded(background), INPUTS)
    scored = predict(model, rows).select("flight_id", "prediction", *INPUTS)
    return shapley.shapley_values(trees, scored, INPUTS, ["flight_id", "prediction"])
