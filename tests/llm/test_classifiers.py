"""Toxicity and quality: held-out accuracy, slopes, and odd rows."""

import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from contrail.llm import learning, quality, toxicity
from contrail.llm.queries import QUERIES


def sentence(draw, n=8):
    return " ".join("".join(draw.choice(["an", "or", "ti", "he", "lo"]) for _ in range(3)) for _ in range(n))


def corpus(draw, n):
    texts, labels = [], []
    for k in range(n):
        sentences = [sentence(draw) for _ in range(draw.randint(1, 12))]
        toxic = k % 4 == 0
        if toxic:
            at = draw.randrange(len(sentences))
            sentences[at] += " " + draw.choice(["vilethen", "vileor", "scum"])
        texts.append(". ".join(sentences).encode())
        labels.append(int(toxic))
    return texts, labels


def test_toxicity_learns_sentences_from_document_labels():
    draw = random.Random(1)
    model = toxicity.fit(*corpus(draw, 400))
    texts, labels = corpus(draw, 200)
    right = 0
    for text, label in zip(texts, labels):
        found = toxicity.sentence_odds(text.decode(), model)
        guilty = [(a, b) for a, b, odds in found if odds > 0]
        right += (len(guilty) > 0) == bool(label)
        for a, b in guilty:
            assert "vile" in text.decode()[a:b] or "scum" in text.decode()[a:b]
    assert right >= 195


def test_network_slopes_are_right():
    draw = np.random.default_rng(0)
    texts = [bytes(draw.integers(97, 103, n).astype(np.uint8)) for n in (0, 3, 40, 1200)]
    wanted = np.array([1, 0, 1, 0], np.float32)
    net = quality.Network()
    net.layers = {k: v.astype(np.float64) for k, v in net.layers.items()}
    net.learned = True

    def loss():
        p = np.clip(net.scores(texts), 1e-12, 1 - 1e-12)
        return -np.mean(wanted * np.log(p) + (1 - wanted) * np.log(1 - p))

    slopes = net.gradients(texts, wanted)
    for name, layer in net.layers.items():
        flat = layer.reshape(-1)
        places = [97 * 8 + 1, 100 * 8] if name == "embedding" else [0, len(flat) - 1]
        for at in places:
            kept = flat[at]
            flat[at] = kept + 1e-5
            up = loss()
            flat[at] = kept - 1e-5
            down = loss()
            flat[at] = kept
            assert abs((up - down) / 2e-5 - np.ravel(slopes[name])[at]) < 2e-3, name


def test_echo_marks_repeats():
    text = np.frombuffer(b"abcdefXabcdef", np.uint8)
    assert [int(s) >= 256 for s in quality.symbols(text)] == [False] * 7 + [True] * 3 + [False] * 3


def test_scores_do_not_depend_on_the_batch():
    net = quality.fit([b"good prose here " * 20, b"@@ ## @@ ## " * 20] * 10, [1, 0] * 10)
    texts = [b"", b"x", b"good prose here " * 300, b"@@ ## " * 5, b"a" * 5000]
    alone = [net.scores([text])[0] for text in texts]
    assert np.allclose(net.scores(texts), alone, atol=1e-5)
    assert net.scores([b"good prose here " * 9])[0] > 0.5 > net.scores([b"@@ ## @@ ## " * 9])[0]


@pytest.mark.parametrize("name, label, least", [("op2_toxicity", "toxic", 0.9), ("op8_quality", "quality", 0.97)])
def test_held_out_accuracy(spark, name, label, least):
    folder = "/root/testdata/sf0.01"
    rows = QUERIES[name](spark, folder).collect()
    truth = {r.doc_id: r[label] for r in spark.read.parquet(f"{folder}/labels.parquet").collect()}
    assert len(rows) == spark.read.parquet(f"{folder}/documents.parquet").count()
    right = total = 0
    for row in rows:
        assert row.held_out == (zlib.crc32(str(row.doc_id).encode()) % 3 == 1)
        assert 0 <= row.score <= 1 and row.predicted == int(row.score >= (0.7 if label == "toxic" else 0.5))
        if row.held_out and row.doc_id in truth:
            total += 1
            right += row.predicted == truth[row.doc_id]
    assert right / total >= least


@pytest.mark.parametrize("module, label", [(toxicity, "toxic"), (quality, "quality")])
def test_odd_rows(spark, module, label):
    rows = [(1, "fine words"), (2, None), (3, ""), (4, "a" * 200_000), (5, "x. " * 4000), (6, "same"), (6, "same"), (None, "no id")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("score", F.lit("x")).withColumn("y", F.lit(1))
    labels = spark.createDataFrame([(1, 1), (2, 0), (3, None), (6, 1), (6, 0), (None, 1), (9, 0)], f"doc_id long, {label} int")
    found = module.score_documents(docs, labels).collect()
    assert len(found) == len(rows) and all(0 <= r.score <= 1 for r in found)
    assert len({r.score for r in found if r.doc_id == 6}) == 1
    assert module.score_documents(docs, labels.limit(0)).count() == len(rows)
    assert module.score_documents(docs.limit(0), labels).count() == 0


def test_sample_is_bounded_and_never_held_out(spark):
    docs = spark.range(3000).select(F.col("id").alias("doc_id"), F.lit("t").alias("text"))
    labels = spark.range(3000).select(F.col("id").alias("doc_id"), F.lit(1).alias("toxic"))
    drawn = [r.doc_id for r in learning.training_sample(docs, labels, "toxic", 500).collect()]
    assert len(drawn) == 500 and all(zlib.crc32(str(k).encode()) % 3 != 1 for k in drawn)


def plain_score(text, at):
    """The network's forward pass in plain loops."""
    codes = []
    for i, byte in enumerate(text):
        gram = text[i : i + 4]
        echo = len(gram) == 4 and len(text) > 4 and any(text[i - lag : i - lag + 4] == gram for lag in range(1, 33) if lag <= i)
        codes.append(byte + 256 * echo)
    strides = max(2, -(-len(text) // 4) + 1)
    codes += [0] * (strides * 4 - len(codes))
    filters = []
    for f in range(strides - 1):
        seen = np.concatenate([at["embedding"][code] for code in codes[4 * f : 4 * f + 8]])
        weights = np.concatenate([at["left"], at["right"]])
        filters.append(np.maximum(seen @ weights + at["shift"], 0))
    tops, start = [], 0
    while not tops or start < len(filters) - 16:
        tops.append(np.max(filters[start : start + 128], axis=0))
        start += 112
    logit = np.concatenate([np.mean(tops, axis=0), np.max(tops, axis=0)]) @ at["output"] + at["bias"][0]
    return 1 / (1 + np.exp(-logit))


def test_forward_pass_against_plain_loops_whole_and_in_slabs():
    draw = np.random.default_rng(8)
    net = quality.Network()
    net.layers = {name: layer.astype(np.float64) for name, layer in net.layers.items()}
    net.learned = True
    for n in (0, 1, 4, 5, 8, 60, 448, 511, 512, 513, 515, 516, 960, 2000, 3333):
        text = bytes(draw.integers(97, 100, n).astype(np.uint8))
        wanted = plain_score(text, net.layers)
        assert abs(net.scores([text, b"other"])[0] - wanted) < 1e-6
        for slab in (400, 448, 1000):
            assert abs(net.scores([text], slab)[0] - wanted) < 1e-6


def test_long_text_takes_bounded_memory():
    import tracemalloc

    net = quality.Network()
    net.learned = True
    text = b"a text that goes on and on, " * 1_000_000
    tracemalloc.start()
    score = net.scores([text])[0]
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert 0 <= score <= 1 and peak < 200_000_000
