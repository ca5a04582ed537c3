"""Vector search through inverted lists: learned centres, a list of vectors per centre, exact ranks.

Centres come from a bounded sample by hash (``SAMPLE`` vectors; spherical k-means in one task). Every
comparable vector is in the list of its nearest centre, so the index holds all rows. A query looks into the lists of
its nearest centres, as many as a sample of the queries needs for ``TARGET`` of its exact hits, and what it meets there
is ranked by exact cosine. Nothing but the centres
(bounded by ``MOST_LISTS``) is sent to all tasks: queries are a table and meet the lists in a join on the list number.

A list may hold any share of the vectors, and any number of queries may ask it: lists are cut into slabs
of ``SLAB`` vectors, the queries of a list into blocks, and a group is one slab with one block. A group gives k
rows per query.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window as W, functions as F
from pyspark.sql.functions import pandas_udf

from contrail.operators.retrieval import CELLS, top_passages, usable
from contrail.session import written

SAMPLE = 20_000
MOST_LISTS = 1024
SLAB, QUERY_BLOCK = 4096, 1024
ROUNDS = 12
TARGET = 0.95  # share of the exact hits that probes are chosen for
SEED = 5


def _unit(rows: np.ndarray) -> np.ndarray:
    rows = rows / np.abs(rows).max(1, keepdims=True)
    return rows / np.linalg.norm(rows, axis=1, keepdims=True)


def learn_centres(rows: np.ndarray, lists: int, rounds: int = ROUNDS, seed: int = SEED) -> np.ndarray:
    """Spherical k-means; an empty centre restarts at the row that is worst served."""
    unit = _unit(rows)
    rng = np.random.default_rng(seed)
    centres = unit[rng.choice(len(unit), min(lists, len(unit)), replace=False)]
    for _ in range(rounds):
        close = unit @ centres.T
        own = close.argmax(1)
        sums = np.zeros_like(centres)
        np.add.at(sums, own, unit)
        norms = np.linalg.norm(sums, axis=1)
        worst = np.argsort(close.max(1))
        for at, spare in zip(np.flatnonzero(norms < 1e-12), worst):
            sums[at], norms[at] = unit[spare], 1.0
        centres = sums / norms[:, None]
    return centres


def fit_centres(
    vectors: DataFrame,
    lists: int | None = None,
    sample: int = SAMPLE,
    vec_id: str = "vec_id",
    vector: str = "embedding",
) -> np.ndarray:
    """Centres from the ``sample`` vectors with the lowest hash; about the square root of the rows, if ``lists`` is not given."""
    known = usable(vectors, vector).select(F.xxhash64(F.col(vec_id), F.lit(SEED)).alias("h"), F.col(vector).alias("v"))
    total = known.count()
    if not total:
        return np.zeros((0, 0))
    # far more than the sample are left out by hash before anything is ordered
    part = max(1, total // (2 * sample))
    drawn = known.filter(F.pmod(F.col("h"), F.lit(part)) == 0).orderBy("h", "v").limit(sample).select("v").toPandas()["v"]
    if not len(drawn):
        drawn = known.orderBy("h", "v").limit(sample).select("v").toPandas()["v"]
    lists = lists or min(MOST_LISTS, max(1, round(math.sqrt(total))))
    width = max(len(v) for v in drawn)
    rows = np.vstack([v for v in drawn if len(v) == width]).astype("float64")
    return learn_centres(rows, lists)


def nearest_lists(vector: str, centres, count: int) -> Column:
    """The numbers of the ``count`` nearest centres, best first."""

    @pandas_udf("array<int>")
    def run(column: pd.Series) -> pd.Series:
        rows, found = column.to_numpy(), []
        step = max(1, CELLS // max(1, len(centres.value)))
        for at in range(0, len(rows), step):
            close = _unit(np.vstack(rows[at : at + step]).astype("float64")) @ centres.value.T
            found += list(np.argsort(-close, axis=1, kind="stable")[:, :count].astype("int32"))
        return pd.Series(found, dtype=object)

    return run(vector)


def build_lists(vectors: DataFrame, centres: np.ndarray, vec_id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(list, vec_id, vector) of all comparable vectors as a table sorted by list."""
    shared = vectors.sparkSession.sparkContext.broadcast(centres)
    known = usable(vectors, vector).filter(F.size(vector) == (centres.shape[1] if centres.size else -1))
    placed = known.select(F.col(vec_id).alias("vec_id"), F.col(vector).alias("vector"))
    placed = placed.withColumn("list", nearest_lists("vector", shared, 1)[0])
    return written(placed.repartitionByRange("list", F.xxhash64("vec_id")).sortWithinPartitions("list"), "vector-lists")


def _ranked(passages: pd.DataFrame, queries: pd.DataFrame, k: int) -> pd.DataFrame:
    rows = lambda frame: _unit(np.vstack(frame["vector"]).astype("float64"))
    passages = passages.sort_values("vec_id", kind="stable")
    ids, vectors = passages["vec_id"].to_numpy("int64"), rows(passages)
    take, step = min(k, len(ids)), max(1, CELLS // len(ids))
    places, scores = [], []
    for asked in (queries.iloc[at : at + step] for at in range(0, len(queries), step)):
        found = np.round(rows(asked) @ vectors.T, 9)
        best = np.argsort(-found, axis=1, kind="stable")[:, :take]
        places.append(best.ravel())
        scores.append(np.take_along_axis(found, best, 1).ravel())
    return pd.DataFrame(
        {
            "query_id": np.repeat(queries["query_id"].to_numpy("int64"), take),
            "vec_id": ids[np.concatenate(places)],
            "score": np.concatenate(scores),
        }
    )


def search_lists(lists: DataFrame, centres: np.ndarray, queries: DataFrame, k: int = 5, probes: int = 8) -> DataFrame:
    """(query_id, rank, vec_id, score): the k best vectors in the probed lists, ties to the lower id."""
    shared = lists.sparkSession.sparkContext.broadcast(centres)
    width = centres.shape[1] if centres.size else -1
    asked = usable(queries, "vector").filter((F.size("vector") == width) & F.col("query_id").isNotNull())
    asked = asked.dropDuplicates(["query_id"]).select("query_id", "vector", nearest_lists("vector", shared, probes).alias("lists"))
    asked = asked.select("query_id", "vector", F.explode("lists").alias("list"))
    # pieces of a list and of its queries; counts only, one row per list
    pieces = lambda frame, size, name: frame.groupBy("list").agg(
        F.ceil(F.count(F.lit(1)) / size).cast("int").alias(name)
    )
    asked = written(asked, "vector-queries")
    cuts = pieces(lists, SLAB, "slabs").join(pieces(asked, QUERY_BLOCK, "blocks"), "list")
    cuts = F.broadcast(cuts) if len(centres) <= MOST_LISTS else cuts
    upto = lambda name: F.explode(F.sequence(F.lit(0), F.col(name) - 1))
    left = (
        lists.join(cuts, "list")
        .withColumn("slab", F.pmod(F.xxhash64("vec_id"), F.col("slabs")).cast("int"))
        .select("list", "vec_id", "vector", "slab", upto("blocks").alias("block"))
    )
    right = (
        asked.join(cuts, "list")
        .withColumn("block", F.pmod(F.xxhash64("query_id"), F.col("blocks")).cast("int"))
        .select("list", "query_id", "vector", "block", upto("slabs").alias("slab"))
    )
    group = ["list", "slab", "block"]
    schema = "query_id bigint, vec_id bigint, score double"

    def rank(key: tuple, passages: pd.DataFrame, questions: pd.DataFrame) -> pd.DataFrame:
        if passages.empty or questions.empty:
            return pd.DataFrame({"query_id": [], "vec_id": [], "score": []}).astype({"query_id": "int64", "vec_id": "int64"})
        return _ranked(passages, questions, k)

    found = left.groupBy(group).cogroup(right.groupBy(group)).applyInPandas(rank, schema)
    order = W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def recall(found: DataFrame, exact: DataFrame) -> float:
    """The share of the exact hits (query_id, vec_id) that were found."""
    hits = exact.select("query_id", "vec_id")
    total = hits.count()
    return hits.join(found.select("query_id", "vec_id"), ["query_id", "vec_id"]).count() / total if total else 1.0


def probes_for(lists: DataFrame, centres: np.ndarray, queries: DataFrame, k: int = 5, target: float = TARGET, sample: int = 200) -> int:
    """The lists to probe so that ``target`` of the exact hits lie in them, measured on ``sample`` of the queries.

    The sample's hits come from the exact search; each tells how near its list is to its query.
    """
    width = centres.shape[1] if centres.size else -1
    known = usable(queries, "vector").filter((F.size("vector") == width) & F.col("query_id").isNotNull())
    drawn = known.orderBy(F.xxhash64("query_id", F.lit(SEED)), "query_id").limit(sample)
    drawn = written(drawn.select("query_id", "vector"), "vector-sample")
    exact = top_passages(lists.withColumnRenamed("vector", "embedding"), drawn, k).select("query_id", "vec_id")
    shared = lists.sparkSession.sparkContext.broadcast(centres)
    near = drawn.select("query_id", nearest_lists("vector", shared, len(centres)).alias("order"))
    # at most k places for each query of the sample
    hits = exact.join(lists.select("vec_id", "list"), "vec_id").join(near, "query_id")
    places = hits.select(F.array_position("order", F.col("list")).cast("int").alias("p")).toPandas()["p"].sort_values()
    return int(places.iloc[math.ceil(target * len(places)) - 1]) if len(places) else 1


def search(vectors: DataFrame, queries: DataFrame, k: int = 5, probes: int | None = None, lists: int | None = None) -> DataFrame:
    """Fit, build and search in one go; without ``probes`` as many lists as :func:`probes_for` finds."""
    centres = fit_centres(vectors, lists)
    built = build_lists(vectors, centres)
    return search_lists(built, centres, queries, k, probes or probes_for(built, centres, queries, k))
