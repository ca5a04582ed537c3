import numpy as np
from pyspark.sql import functions as F

from contrail.operators import features, forest, models, retrieval


def cloud(spark, n=3000):
    noise = lambda seed: (F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(10_000)) / 10_000.0)
    df = spark.range(n).select("id", noise(1).alias("x"), noise(2).alias("y"))
    return df.withColumn("x", F.when(F.col("id") < 5, F.col("x") + 50).otherwise(F.col("x")))


def test_outliers_score_highest(spark):
    scores = forest.isolation_scores(cloud(spark), "id", ["x", "y"], trees=40).toPandas()
    assert len(scores) == 3000 and scores["score"].between(0, 1, inclusive="neither").all()
    assert set(scores.nlargest(5, "score")["id"]) == set(range(5))


def test_forest_does_not_depend_on_partitions(spark):
    a = forest.isolation_scores(cloud(spark, 500).repartition(1), "id", ["x", "y"], trees=10)
    b = forest.isolation_scores(cloud(spark, 500).repartition(7), "id", ["x", "y"], trees=10)
    assert sorted(map(tuple, a.collect())) == sorted(map(tuple, b.collect()))


def flights_with_signal(spark):
    return spark.range(2000).select(
        F.col("id").alias("flight_id"),
        F.timestamp_seconds(F.lit(800_000_000) + F.col("id") * 3600).alias("scheduled_dep_time"),
        (F.col("id") % 24).cast("int").alias("dep_hour"),
        (F.col("id") % 7 + 1).cast("int").alias("dep_weekday"),
        F.lit("000").alias("carrier_code"),
        F.lit("A000").alias("origin_airport"),
        F.lit(100).cast("decimal(8,2)").alias("distance_miles"),
        F.lit(3).cast("bigint").alias("recent_flights"),
        (F.col("id") * 17 % 50).cast("double").alias("recent_mean_delay"),
        F.lit(None).cast("decimal(5,1)").alias("wind_speed_knots"),
        F.lit(5).cast("decimal(5,2)").alias("visibility_miles"),
        (F.col("id") * 17 % 50 * 2 + F.col("id") % 24).cast("int").alias("dep_delay_min"),
    )


def test_model_beats_the_mean_and_finds_the_feature(spark):
    train, test = models.split_by_time(models.model_rows(flights_with_signal(spark)))
    assert train.agg(F.max("scheduled_dep_time")).first()[0] < test.agg(F.min("scheduled_dep_time")).first()[0]
    model = models.fit(train)
    scored = models.score(model, test).toPandas()
    mean = train.agg(F.avg("label")).first()[0]
    assert np.abs(scored["label"] - scored["prediction"]).mean() < 0.5 * np.abs(scored["label"] - mean).mean()
    importance = models.permutation_importance(model, test).toPandas().set_index("feature")["importance"]
    assert importance.idxmax() == "recent_mean_delay"
    assert abs(importance["visibility_miles"]) < 1e-6


def test_drift_is_zero_without_change_and_survives_an_empty_side(spark):
    df = spark.range(1000).select((F.col("id") % 10).cast("double").alias("x"), "id")
    same = features.drift_psi(df, F.col("id") >= 500, {"x": (0.0, 10.0)}).first()
    assert same["psi"] == 0 and same["ref_rows"] == same["cur_rows"] == 500
    assert features.drift_psi(df, F.col("id") < 0, {"x": (0.0, 10.0)}).first()["cur_rows"] == 0


def test_top_passages_in_several_passes(spark):
    vectors = spark.createDataFrame(
        [(i, [float(i % 7 + 1), float(i % 5 - 2), 1.0]) for i in range(60)], "vec_id bigint, embedding array<float>"
    )
    queries = vectors.limit(5).selectExpr("vec_id AS query_id", "cast(embedding AS array<double>) AS vector")
    once = sorted(map(tuple, retrieval.top_passages(vectors, queries, 4).collect()))
    assert sorted(map(tuple, retrieval.top_passages(vectors, queries, 4).collect())) == once
    assert len(once) == 20


def test_chunks_hold_every_word(spark):
    sizes = [0, 1, 13, 14, 15, 63, 64, 65, 114, 115, 400]
    df = spark.createDataFrame([(n, " ".join(f"w{i}" for i in range(n))) for n in sizes], "doc_id bigint, text string")
    seen: dict = {}
    for r in retrieval.chunks(df).collect():
        words = r["text"].split(" ") if r["text"] else []
        seen.setdefault(r["doc_id"], set()).update(words)
        assert r["words"] <= 64
    assert all(seen[n] == {f"w{i}" for i in range(n)} for n in sizes)


def test_forest_is_normalised_by_its_samples(spark):
    same = spark.range(1000).select("id", F.lit(1.0).alias("x"), F.lit(2.0).alias("y"))
    drawn = forest.draw_samples(same, "id", ["x", "y"], 20, 256, 7).groupBy("tree").count()
    assert drawn.agg(F.max("count")).first()[0] <= 256
    # equal rows cannot be split: the path is the mean path of the sample, the score one half
    scores = forest.isolation_scores(same, "id", ["x", "y"], trees=20).toPandas()["score"]
    assert abs(scores - 0.5).max() < 0.01


def test_model_fits_many_airports_and_carriers(spark):
    many = flights_with_signal(spark).withColumn("origin_airport", F.concat(F.lit("A"), F.col("flight_id") * 7 % 5000))
    many = many.withColumn("carrier_code", (F.col("flight_id") % 1000).cast("string"))
    train, test = models.split_by_time(models.model_rows(many))
    model = models.fit(train, iterations=2)
    assert models.score(model, test).filter("prediction IS NULL").count() == 0


def test_vectors_that_cannot_be_compared_take_no_part(spark):
    rows = [(1, [1.0, 0.0], 0), (2, None, 0), (3, [0.0, 1.0], None), (4, [None, 1.0], 1), (5, [0.0, 0.0], 1), (6, [1.0, 1.0], 1), (7, [float("nan"), 1.0], 2)]
    frame = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>, label int")
    centres = retrieval.label_centroids(frame)
    assert {r["query_id"]: r["vector"] for r in centres.collect()} == {0: [1.0, 0.0], 1: [1.0, 1.0]}
    found = retrieval.top_passages(frame, centres, 2).orderBy("query_id", "rank").collect()
    assert [(r["query_id"], r["vec_id"]) for r in found] == [(0, 1), (0, 6), (1, 6), (1, 1)]
    assert retrieval.top_passages(frame, centres.limit(0), 2).count() == 0


def test_many_queries_go_in_blocks(spark):
    noise = lambda seed: F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(1000)) / 500.0 - 1
    frame = spark.range(300).select(F.col("id").alias("vec_id"), F.array(noise(1), noise(2), noise(3)).alias("embedding"))
    asked = spark.range(10_000).select(F.col("id").alias("query_id"), F.array(noise(4), noise(5), noise(6)).alias("vector"))
    found = retrieval.top_passages(frame, asked, 3, block=3000).toPandas()
    assert len(found) == 30_000
    vectors = np.vstack(frame.orderBy("vec_id").toPandas()["embedding"])
    unit = vectors / np.linalg.norm(vectors, axis=1, keepdims=True)
    some = asked.filter("query_id % 997 = 0").toPandas()
    for query, vector in zip(some["query_id"], some["vector"]):
        scores = np.round(unit @ (np.array(vector) / np.linalg.norm(vector)), 9)
        best = sorted(range(300), key=lambda i: (-scores[i], i))[:3]
        mine = found[found["query_id"] == query].sort_values("rank")["vec_id"].tolist()
        assert mine == best
