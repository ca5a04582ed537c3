"""Toxicity by multiple-instance learning.

Only documents carry labels. A sentence's probability is logistic in its distinct
words and word stems, a document's is the noisy-or of its sentences: it is clean if every sentence
is. Maximum likelihood of the document labels trains the word weights, and the
sentence probabilities then say where the offence stands.

Null texts count as empty; a text without sentences has score 0. Without any labelled
row the model knows no words and scores by its bias alone. Whole texts are scored,
however long; repeated rows are scored alike.
"""

from __future__ import annotations

import re
from array import array
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, functions as F

from contrail.llm.learning import fitted, model_of, training_sample
from contrail.llm.text import blobs, held_out

THRESHOLD = 0.7
SENTENCE = re.compile(r"[^.!?\n]+")
WORD = re.compile(r"[^\W\d_]+")
STEMS = (4, 5, 6)
LEAST_DOCS = 3
FEATURES, LEAST_LEAN = 5000, 2.0
SELECT_ROUNDS, ROUNDS = 200, 400
RATE = 1.0
PENALTY, PENALTY_DOCS = 2e-5, 1.0  # the least mean slope a feature must have, and documents it must explain
BIAS = -5.0
SAMPLE_ROWS = 8000


def features(word: str) -> list[str]:
    """A word and its stems; a stem ends in a star."""
    return [word, *(word[:size] + "*" for size in STEMS if len(word) > size)]


def _sentences(text: bytes) -> Iterator[set[str]]:
    """The distinct features of each sentence."""
    for match in SENTENCE.finditer(text.decode()):
        yield {name for word in WORD.findall(match.group().lower()) for name in features(word)}


def _leaning(texts: list[bytes], wanted: np.ndarray) -> dict[str, int]:
    """Codes of the features that stand in toxic documents clearly more often than in clean ones."""
    seen: Counter = Counter()
    for text, label in zip(texts, wanted):
        if label:
            seen.update(set().union(*_sentences(text)))
    others = dict.fromkeys(seen, 0)  # features of clean documents alone cannot lean
    for text, label in zip(texts, wanted):
        if not label:
            for name in others.keys() & set().union(*_sentences(text)):
                others[name] += 1
    clean, toxic = max(1, int((wanted == 0).sum())), max(1, int((wanted == 1).sum()))
    lean = {}
    for name, n in seen.items():
        rate, other = n / toxic, others[name] / clean
        both = (n + others[name]) / (clean + toxic)
        if n + others[name] >= LEAST_DOCS:
            lean[name] = (rate - other) / max(1e-9, both * (1 - both) * (1 / clean + 1 / toxic)) ** 0.5
    chosen = sorted((name for name, z in lean.items() if z >= LEAST_LEAN), key=lambda name: (-lean[name], name))
    return {name: code for code, name in enumerate(chosen[:FEATURES])}


def fit(texts: list[bytes], labels: list[int]) -> dict:
    """Feature weights and bias that maximise the noisy-or likelihood of the labels."""
    wanted = np.array(labels, float)
    codes = _leaning(texts, wanted)
    word_of, sentence_of, document_of = array("q"), array("q"), array("q")
    for document, text in enumerate(texts):
        for names in _sentences(text):
            known = sorted(codes[name] for name in names & codes.keys())
            word_of.extend(known)
            sentence_of.extend([len(document_of)] * len(known))
            document_of.append(document)
    word_of, sentence_of = np.array(word_of, np.int64), np.array(sentence_of, np.int64)
    document_of = np.array(document_of, np.int64)
    size, n_sentences, n_docs = len(codes), len(document_of), max(1, len(texts))
    weights, bias = np.zeros(size), BIAS
    grown, bias_grown = np.full(size, 1e-8), 1e-8
    penalty = PENALTY + PENALTY_DOCS / n_docs
    for step in range(ROUNDS if n_sentences else 0):
        if step == SELECT_ROUNDS:
            # what has been selected is fitted on under a smaller penalty
            penalty /= 5
        logits = bias + np.bincount(sentence_of, weights[word_of], n_sentences)
        clean = np.logaddexp(0, logits)  # minus the log of "this sentence is clean"
        all_clean = np.bincount(document_of, clean, len(texts))
        toxic = -np.expm1(-all_clean)
        pull = np.where(wanted > 0, -np.exp(-all_clean) / np.maximum(toxic, 1e-9), 1.0)
        slope = pull[document_of] * np.exp(logits - clean) / n_docs
        gradient = np.bincount(word_of, slope[sentence_of], size)
        grown += gradient**2
        bias_grown += slope.sum() ** 2
        # proximal step: what does not pay for its penalty stays at zero
        pace = RATE / np.sqrt(grown)
        weights = weights - pace * gradient
        weights = np.sign(weights) * np.maximum(np.abs(weights) - pace * penalty, 0)
        bias -= RATE * slope.sum() / np.sqrt(bias_grown)
    kept = {name: float(weights[code]) for name, code in codes.items() if abs(weights[code]) > 1e-3}
    return {"weights": kept, "heads": {name.rstrip("*")[: min(STEMS)] for name in kept}, "bias": float(bias)}


def sentence_odds(text: str, model: dict) -> list[tuple[int, int, float]]:
    """Start, end and log odds of every sentence, in code points."""
    weigh, heads, bias, head = model["weights"].get, model["heads"], model["bias"], min(STEMS)
    found = []
    for match in SENTENCE.finditer(text):
        odds = bias
        hits = {word for word in WORD.findall(match.group().lower()) if word[:head] in heads}
        if hits:
            names = {name for word in hits for name in features(word)}
            odds += sum(weigh(name, 0.0) for name in sorted(names))
        found.append((match.start(), match.end(), odds))
    return found


SCORED = "struct<score: double, n_sentences: long, starts: array<long>, ends: array<long>, chances: array<double>>"


def score(text: str | Column, model: Broadcast, least: float = 0.5) -> Column:
    """The noisy-or score of a text column, with the sentences of probability ``least`` and more."""

    @F.arrow_udf(SCORED)
    def run(column: pa.Array) -> pa.Array:
        known = model_of(model)
        scores, counts, starts, ends, chances = [], [], [], [], []
        for body in blobs(column):
            found = sentence_odds(body.decode(), known)
            odds = np.array([odd for _, _, odd in found])
            clean = np.logaddexp(0, odds)
            scores.append(float(-np.expm1(-clean.sum())))
            counts.append(len(found))
            chance = np.exp(odds - clean)
            guilty = np.flatnonzero(chance >= least).tolist()
            starts.append([found[at][0] for at in guilty])
            ends.append([found[at][1] for at in guilty])
            chances.append([float(chance[at]) for at in guilty])
        longs = pa.list_(pa.int64())
        return pa.StructArray.from_arrays(
            [pa.array(scores, pa.float64()), pa.array(counts, pa.int64()), pa.array(starts, longs),
             pa.array(ends, longs), pa.array(chances, pa.list_(pa.float64()))],
            ["score", "n_sentences", "starts", "ends", "chances"],
        )

    return run.asNondeterministic()(text)


def train(
    docs: DataFrame, labels: DataFrame, label: str = "toxic", rows: int = SAMPLE_ROWS, **sample
) -> Broadcast:
    """The model, learned from a bounded sample of the rows that are not held out."""
    return fitted(training_sample(docs, labels, label, rows, **sample), fit)


def score_documents(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: id, held_out, score, predicted and the offending sentences."""
    model = train(docs, labels, doc_id=doc_id, text=text)
    scored = docs.select(F.col(doc_id).alias("doc_id"), score(F.col(text), model).alias("s"))
    return scored.select(
        "doc_id",
        held_out("doc_id").alias("held_out"),
        "s.score",
        (F.col("s.score") >= THRESHOLD).cast("int").alias("predicted"),
        "s.n_sentences",
        F.col("s.starts").alias("sentence_starts"),
        F.col("s.ends").alias("sentence_ends"),
        F.col("s.chances").alias("sentence_chances"),
    )
