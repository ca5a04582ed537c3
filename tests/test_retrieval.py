import json
import tracemalloc
from datetime import datetime

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from contrail.operators import index, pairs, retrieval

SF = "/root/testdata/sf0.1"


def clustered(spark, n, width=16, centres=30, seed=3):
    rng = np.random.default_rng(seed)
    middle = rng.standard_normal((centres, width))
    rows = [(i, (middle[rng.integers(centres)] + 0.3 * rng.standard_normal(width)).tolist()) for i in range(n)]
    return spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")


def questions(vectors, step):
    return vectors.filter(F.col("vec_id") % step == 0).selectExpr("vec_id AS query_id", "embedding AS vector")


@pytest.mark.parametrize("slab, block", [(4096, 1024), (50, 7)])
def test_index_finds_what_the_exact_search_finds(spark, monkeypatch, slab, block):
    monkeypatch.setattr(index, "SLAB", slab)
    monkeypatch.setattr(index, "QUERY_BLOCK", block)
    vectors = clustered(spark, 3000)
    asked = questions(vectors, 20)
    exact = retrieval.top_passages(vectors, asked, 5)
    centres = index.fit_centres(vectors)
    lists = index.build_lists(vectors, centres)
    assert lists.count() == 3000 and lists.select("vec_id").distinct().count() == 3000
    found = index.search_lists(lists, centres, asked, 5, probes=8)
    assert index.recall(found, exact) >= 0.9
    # all lists probed: the exact answer, ranks and scores as well
    whole = index.search_lists(lists, centres, asked, 5, probes=len(centres))
    columns = ["query_id", "rank", "vec_id", "score"]
    assert sorted(map(tuple, whole.select(columns).collect())) == sorted(map(tuple, exact.select(columns).collect()))


def test_recall_on_the_given_vectors(spark):
    """They have no clusters to speak of, so many lists have to be probed."""
    vectors = spark.read.parquet(f"{SF}/embeddings.parquet")
    asked = questions(vectors, 20).withColumn("vector", F.col("vector").cast("array<double>"))
    exact = retrieval.top_passages(vectors, asked, 5)
    assert index.recall(index.search(vectors, asked, 5), exact) >= 0.9


def test_one_list_with_all_vectors(spark, monkeypatch):
    monkeypatch.setattr(index, "SLAB", 40)
    vectors = spark.range(400).select(F.col("id").alias("vec_id"), F.array(F.lit(1.0), F.col("id") / 1e6).alias("embedding"))
    asked = questions(vectors, 100)
    exact = retrieval.top_passages(vectors, asked, 3)
    assert index.recall(index.search(vectors, asked, 3, lists=5), exact) == 1.0


def test_odd_vectors_and_no_vectors(spark):
    kind = "vec_id bigint, embedding array<float>"
    odd = spark.createDataFrame([(1, [1.0, 0.0]), (2, None), (3, [0.0, 0.0]), (4, [None, 1.0]), (5, [0.5, 0.5])], kind)
    asked = spark.createDataFrame([(1, [1.0, 0.1]), (2, None), (None, [1.0, 1.0]), (3, [1.0])], "query_id bigint, vector array<double>")
    found = index.search(odd, asked, 5, probes=9).orderBy("rank").collect()
    assert [(r["query_id"], r["vec_id"]) for r in found] == [(1, 1), (1, 5)]
    assert index.search(odd.limit(0), asked).count() == 0


def test_long_turns_make_pairs(spark):
    long = " ".join(f"w{i}" for i in range(5000))
    turns = spark.createDataFrame([(1, 0, "user", long), (1, 1, "assistant", "yes")], "conv_id bigint, turn bigint, role string, text string")
    cleaned = pairs.clean_transcripts(turns)
    assert pairs.answer_pairs(cleaned).count() == 1 and pairs.answer_pairs(cleaned, most_words=2048).count() == 0


def test_any_part_of_a_document_can_be_a_passage(spark):
    filler = lambda name, n: " ".join(f"{name}{i}" for i in range(n))
    docs = [(1, filler("a", 400) + " wind shear on final " + filler("b", 100)), (2, filler("c", 30) + " wind shear on final"), (3, None), (4, "")]
    documents = spark.createDataFrame(docs, "doc_id bigint, text string")
    best = spark.createDataFrame([(0, 1, 1), (0, 2, 2), (0, 3, 3), (0, 4, 4), (1, 1, 1), (0, 5, 9)], "query_id bigint, rank int, vec_id bigint")
    got = {(r["query_id"], r["vec_id"]): r["text"] for r in retrieval.central_chunks(best, documents).collect()}
    assert "wind shear on final" in got[0, 1] and "a350" in got[0, 1] and got[0, 2].endswith("final")
    assert got[1, 1].startswith("a0 ") and got[0, 4] == "" and (0, 3) not in got
    topics = spark.createDataFrame([("altitude_spike", 0)], "event_type string, query_id bigint")
    row = retrieval.passages_by_topic(topics, best, retrieval.central_chunks(best, documents)).first()
    assert row["passages"] == [1, 2, 3, 4, 9] and row["passage_texts"][2:] == ["", "", ""]


def test_memory_of_a_search_does_not_follow_its_queries(monkeypatch):
    """A block of queries against a batch of passages is scored part by part, with the same answer."""
    rng = np.random.default_rng(8)
    ids, matrix = np.arange(3000), rng.standard_normal((3000, 8))
    embedding = rng.standard_normal((4000, 8)).round(1)
    embedding[2000:2100] = embedding[:100]  # ties
    batch = pd.DataFrame({"vec_id": rng.permutation(4000), "embedding": list(embedding)})

    class Task:
        def mapInPandas(self, run, schema):
            tracemalloc.start()
            found = pd.concat(run(iter([batch, batch.iloc[:0]])))
            self.peak = tracemalloc.get_traced_memory()[1]
            tracemalloc.stop()
            return found

    task = Task()
    got = retrieval._block_passages(task, ids, matrix, 5)
    assert task.peak < 60e6  # all scores at once take 96 MB
    monkeypatch.setattr(retrieval, "CELLS", 1 << 30)
    whole = retrieval._block_passages(Task(), ids, matrix, 5)
    assert len(got) == 15000 and got.equals(whole)
    unit = lambda m: m / np.linalg.norm(m, axis=1, keepdims=True)
    scores = (unit(matrix[:50]) @ unit(embedding).T).round(9)
    for n in range(50):
        best = sorted(zip(-scores[n], batch["vec_id"]))[:5]
        assert [(-s, v) for s, v in best] == [(r.score, r.vec_id) for r in got[got["query_id"] == n].itertuples()]


@pytest.mark.parametrize("cells", [1, 50, 1 << 20])
def test_lists_and_ranks_part_by_part(spark, monkeypatch, cells):
    monkeypatch.setattr(index, "CELLS", cells)
    rng = np.random.default_rng(2)
    rows = lambda n: rng.integers(1, 4, (n, 3)).astype("float64")
    passages = pd.DataFrame({"vec_id": rng.permutation(40), "vector": list(rows(40))})
    queries = pd.DataFrame({"query_id": range(9), "vector": list(rows(9))})
    got = index._ranked(passages, queries, 4)
    close = lambda a, b: round(float(a @ b / np.linalg.norm(a) / np.linalg.norm(b)), 9)
    for q in queries.itertuples():
        best = sorted((-close(q.vector, p.vector), p.vec_id) for p in passages.itertuples())[:4]
        found = got[got["query_id"] == q.query_id]
        assert list(found["vec_id"]) == [v for _, v in best] and np.allclose(found["score"], [-s for s, _ in best])
    if cells > 1:
        return
    vectors = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(rows(30))], "vec_id bigint, embedding array<double>")
    centres = index._unit(rows(4))
    for r in index.build_lists(vectors, centres).collect():
        assert r["list"] == int(np.argmax(index._unit(np.array([r["vector"]])) @ centres.T))


def test_records_hold_the_passages_rendered_once(spark):
    kinds = """event_id bigint, icao24 string, event_type string, severity string, detected_at timestamp, description string,
        flight_id bigint, carrier_code string, origin_airport string, dest_airport string, observed_at timestamp,
        wind_speed_knots decimal(5,1), visibility_miles decimal(5,2)"""
    at = datetime(2024, 1, 1, 5, 6, 7, 89)
    odd = 'a "b" \\ } { \n 대한민국'
    rows = [
        (1, "k", "altitude_spike", "LOW", at, odd, 7, "001", "A1", "A}2", at, None, None),
        (2, None, "unasked", None, None, None, None, None, None, None, None, None, None),
        (3, "k", None, "LOW", at, "", 7, "001", "A1", None, at, None, None),
    ]
    anomalies = spark.createDataFrame(rows, kinds)
    passages = spark.createDataFrame([("altitude_spike", [4, 9], [odd, ""])], "event_type string, passages array<bigint>, passage_texts array<string>")
    records = retrieval.grounding_records(anomalies, passages)
    assert records.columns == ["event_type", *[c for c in anomalies.columns if c != "event_type"], "passages", "passage_texts", "grounding"]
    # per anomaly only its own fields are turned into text
    assert "_listed" in records._jdf.queryExecution().analyzed().toString()
    got = {r["event_id"]: json.loads(r["grounding"]) for r in records.collect()}
    assert got[1]["passages"] == [4, 9] and got[1]["passage_texts"] == [odd, ""] and got[1]["description"] == odd
    assert got[1]["flight"] == {"flight_id": 7, "carrier_code": "001", "origin_airport": "A1", "dest_airport": "A}2"}
    assert got[1]["detected_at"] == "2024-01-01T05:06:07.000089Z" and list(got[1])[-2:] == ["passages", "passage_texts"]
    for missing in (got[2], got[3]):
        assert missing["passages"] is None and missing["passage_texts"] is None and len(missing) == 10
    assert got[2]["weather"] == {"observed_at": None, "wind_speed_knots": None, "visibility_miles": None}
