"""Passages for retrieval: word chunks, nearest vectors and grounding records."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window as W, functions as F

from contrail.operators.spread import lookup_join

QUERY_BLOCK = 4096
CELLS = 1 << 20  # scores that a task holds at a time


def chunks(documents: DataFrame, size: int = 64, stride: int = 50) -> DataFrame:
    """Documents as overlapping runs of words; together the chunks hold every word."""
    words = F.split("text", " ", -1)
    last = F.floor((F.greatest(F.size("w") - F.lit(size - stride), F.lit(1)) - 1) / F.lit(stride)).cast("int")
    starts = documents.select("doc_id", words.alias("w")).select(
        "doc_id", "w", F.explode(F.sequence(F.lit(0), last)).alias("chunk_no")
    )
    piece = F.slice(F.col("w"), F.col("chunk_no") * stride + 1, F.lit(size))
    return starts.select(
        "doc_id",
        "chunk_no",
        (F.col("chunk_no") * stride).alias("first_word"),
        F.size(piece).alias("words"),
        F.array_join(piece, " ").alias("text"),
    )


def usable(vectors: DataFrame, column: str = "embedding") -> DataFrame:
    """Vectors that can be compared: not null, not empty, no null or non-finite component, not all zero."""
    finite = F.forall(column, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return vectors.filter(F.col(column).isNotNull() & finite & F.exists(column, lambda x: x != 0))


def label_centroids(embeddings: DataFrame) -> DataFrame:
    """One query vector per label: the mean of its vectors, as (query_id, vector). Rows without a label ask nothing."""
    named = usable(embeddings).filter("label IS NOT NULL")
    parts = named.select("label", F.posexplode("embedding").alias("i", "x"))
    means = parts.groupBy("label", "i").agg(F.avg(F.col("x").cast("double")).alias("m"))
    # one group holds as many rows as a vector has dimensions
    vectors = means.groupBy("label").agg(F.sort_array(F.collect_list(F.struct("i", "m"))).alias("v"))
    return vectors.select(F.col("label").cast("bigint").alias("query_id"), F.col("v.m").alias("vector"))


def _block_passages(passages: DataFrame, ids: np.ndarray, matrix: np.ndarray, k: int) -> DataFrame:
    """The k best passages per query and task, for one block of queries."""

    # a task holds this many passages beside all queries of the block, whatever the size of its batches
    step = max(1, CELLS // max(1, len(ids)))

    def best_of(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        unit = matrix / np.linalg.norm(matrix, axis=1, keepdims=True)
        owner, vec, score = np.zeros(0, int), np.zeros(0, "int64"), np.zeros(0)
        reached = np.full(len(ids), -np.inf)  # the k-th best score so far
        for part in (batch.iloc[at : at + step] for batch in batches for at in range(0, len(batch), step)):
            vectors = np.vstack(part["embedding"].to_numpy()).astype("float64")
            found = np.round(unit @ (vectors / np.linalg.norm(vectors, axis=1, keepdims=True)).T, 9)
            # only scores that reach the k-th best so far and of this part can matter; ties stay in
            low = max(0, found.shape[1] - k)
            least = np.maximum(np.partition(found, low, axis=1)[:, low], reached)
            rows, columns = np.nonzero(found >= least[:, None])
            owner = np.concatenate([owner, rows])
            vec = np.concatenate([vec, part["vec_id"].to_numpy("int64")[columns]])
            score = np.concatenate([score, found[rows, columns]])
            order = np.lexsort((vec, -score, owner))
            owner, vec, score = owner[order], vec[order], score[order]
            place = np.arange(len(owner)) - np.searchsorted(owner, owner)
            kept = place < k
            reached[owner[place == k - 1]] = score[place == k - 1]
            owner, vec, score = owner[kept], vec[kept], score[kept]
        if len(owner):
            yield pd.DataFrame({"query_id": ids[owner], "vec_id": vec, "score": score})

    return passages.mapInPandas(best_of, "query_id bigint, vec_id bigint, score double")


def top_passages(passages: DataFrame, queries: DataFrame, k: int = 5, block: int = QUERY_BLOCK) -> DataFrame:
    """The k passages of highest cosine per query vector; ties go to the lower id.

    Exact: each task multiplies its passages with the query matrix and keeps its k
    best per query, then these are merged. Queries go to the tasks in blocks of about
    ``block``, chosen by a hash of the id; the passages are read once per block. A task holds about
    ``CELLS`` scores at a time. Vectors that cannot be compared and queries without an id take no part.
    """
    known = usable(passages).select("vec_id", "embedding")
    asked = usable(queries, "vector").filter("query_id IS NOT NULL").dropDuplicates(["query_id"])
    blocks = max(1, -(-asked.count() // block))
    partial = None
    for number in range(blocks):
        part = asked if blocks == 1 else asked.filter(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == number)
        rows = sorted(part.select("query_id", "vector").collect())
        ids = np.array([r["query_id"] for r in rows], dtype="int64")
        matrix = np.array([r["vector"] for r in rows] or np.zeros((0, 1)), dtype="float64")
        found = _block_passages(known if len(ids) else known.limit(0), ids, matrix, k)
        partial = found if partial is None else partial.unionByName(found)
    # the planner keeps k per query inside each task before the shuffle
    order = W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return partial.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def central_chunks(best: DataFrame, documents: DataFrame) -> DataFrame:
    """(query_id, vec_id, text): of each found document the chunk that has most in common with the others.

    ``best`` holds (query_id, vec_id), a vector standing for the document with its id. A chunk counts its
    distinct words that also stand in another document found for the query; ties go to the earlier
    chunk. The chunks hold every word of a document, so any part of it can be chosen.
    """
    found = best.select("query_id", "vec_id").distinct()
    texts = documents.select("doc_id", "text").filter("text IS NOT NULL")
    wanted = found.select(F.col("vec_id").alias("doc_id")).distinct()
    pieces = chunks(texts.join(wanted, "doc_id", "left_semi")).select(F.col("doc_id").alias("vec_id"), "chunk_no", "text")
    pieces = found.join(pieces, "vec_id")
    spoken = F.array_distinct(F.filter(F.split("text", " ", -1), lambda w: w != ""))
    words = pieces.select("query_id", "vec_id", "chunk_no", F.explode(spoken).alias("word"))
    common = words.groupBy("query_id", "word").agg(F.min("vec_id").alias("low"), F.max("vec_id").alias("high"))
    common = common.filter("low < high").select("query_id", "word")
    place = ["query_id", "vec_id", "chunk_no"]
    counted = words.join(common, ["query_id", "word"]).groupBy(place).agg(F.count(F.lit(1)).alias("n"))
    ranked = pieces.join(counted, place, "left")
    order = F.struct(F.coalesce("n", F.lit(0)), -F.col("chunk_no"), "text")
    return ranked.groupBy("query_id", "vec_id").agg(F.max_by("text", order).alias("text"))


def passages_by_topic(topics: DataFrame, best: DataFrame, texts: DataFrame) -> DataFrame:
    """One row per event type with ids and texts of its passages, best first.

    ``topics`` says which query stands for which event type, ``texts`` holds a text per query and vector;
    a vector without one has an empty text.
    """
    found = best.join(topics, "query_id").select("event_type", "query_id", "rank", "vec_id")
    told = lookup_join(found, texts.select("query_id", "vec_id", "text"), ["query_id", "vec_id"], small_rows=0)
    text = F.coalesce("text", F.lit("")).alias("text")
    listed = told.groupBy("event_type").agg(F.sort_array(F.collect_list(F.struct("rank", "vec_id", text))).alias("p"))
    return listed.select(
        "event_type", F.col("p.vec_id").alias("passages"), F.transform("p", lambda x: x["text"]).alias("passage_texts")
    )


def grounding_records(anomalies: DataFrame, passages: DataFrame) -> DataFrame:
    """Per anomaly one JSON record of what is known about it; the generated texts stay null.

    ``anomalies`` carry flight and weather columns; ``passages`` is one row per
    event type with the ids and texts of its passages. Their part of the record is rendered once
    per event type and put behind the anomaly's own.
    """
    whole = {"ignoreNullFields": "false"}
    own = F.to_json(
        F.struct(
            "event_id",
            "icao24",
            "event_type",
            "severity",
            F.date_format("detected_at", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'").alias("detected_at"),
            "description",
            F.struct("flight_id", "carrier_code", "origin_airport", "dest_airport").alias("flight"),
            F.struct("observed_at", "wind_speed_knots", "visibility_miles").alias("weather"),
        ),
        whole,
    )
    listed = passages.withColumn("_listed", F.to_json(F.struct("passages", "passage_texts"), whole))
    none = F.lit('{"passages":null,"passage_texts":null}')
    # at most one row per event type, so nothing has to be counted
    met = anomalies.join(F.broadcast(listed), "event_type", "left").withColumn("_own", own)
    # the last brace of the one and the first of the other make a comma
    record = F.concat(
        F.expr("left(_own, length(_own) - 1)"), F.lit(","), F.substr(F.coalesce("_listed", none), F.lit(2))
    )
    return met.withColumn("grounding", record).drop("_own", "_listed")
