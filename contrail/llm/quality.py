"""Quality by a byte-level convolutional network, in numpy.

A text's bytes become symbols: the byte, and whether its four-gram stood within the
last ``ECHO`` bytes. Symbols are embedded; learned filters of eight bytes, four apart,
run over chunks that overlap and together cover the whole document. Each filter is
max-pooled inside a chunk, and the mean and the maximum over the chunks give one
probability. All layers, embeddings included, are learned by back-propagation.

Null texts count as empty; every text is scored whole, the empty one as a text of
padding. Texts of more than ``SLAB_BYTES`` are laid out slab by slab, so memory does not grow with them. Without any labelled row all scores are one half.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, functions as F

from contrail.llm.learning import fitted, model_of, training_sample
from contrail.llm.text import blobs, held_out, slabs

THRESHOLD = 0.5
ECHO = 32
CHANNELS = 8
STRIDE = 4  # filters span two strides
FILTERS = 16
CHUNK, CHUNK_STEP = 128, 112  # filter positions of a chunk, and from one to the next
SLAB_BYTES = 1_000_000
EPOCHS = 8
DOCS_PER_STEP = 32
RATE = 0.01
SAMPLE_ROWS = 2500


def symbols(text: np.ndarray) -> np.ndarray:
    """Byte values, 256 higher where the four-gram that starts there is an echo."""
    out = text.astype(np.int16)
    if len(text) > 4:
        grams = text[:-3].astype(np.uint32)
        for shift in (1, 2, 3):
            grams = grams << np.uint32(8) | text[shift : len(text) - 3 + shift]
        echo = np.zeros(len(grams), bool)
        for lag in range(1, min(ECHO, len(grams) - 1) + 1):
            echo[lag:] |= grams[lag:] == grams[:-lag]
        out[: len(grams)] += echo * np.int16(256)
    return out


def _rows(size: int) -> int:
    """Strides of a text of so many bytes."""
    return max(2, -(-size // STRIDE) + 1)


def _chunks(filters: int) -> np.ndarray:
    """First filter position and end of each chunk."""
    starts = np.arange(0, max(1, filters - (CHUNK - CHUNK_STEP)), CHUNK_STEP)
    return np.stack([starts, np.minimum(starts + CHUNK, filters)], 1)


class Layout:
    """Texts laid end to end in strides, padded by zeros; chunks never reach into the next text.

    Without texts, some symbols of a text with the strides and chunks that they fill.
    """

    def __init__(self, texts: list[bytes], own: np.ndarray | None = None, strides: int = 0, chunks: np.ndarray | None = None):
        if own is not None:
            self.flat = np.zeros(strides * STRIDE, np.int16)
            self.flat[: len(own)] = own
            self.starts, self.ends = chunks.T
            return
        rows = [_rows(len(text)) for text in texts]
        firsts = np.cumsum(rows) - rows
        flat = np.zeros(sum(rows) * STRIDE, np.int16)
        starts, ends, owners = [], [], []
        for number, text in enumerate(texts):
            at = int(firsts[number])
            flat[at * STRIDE : at * STRIDE + len(text)] = symbols(np.frombuffer(text, np.uint8))
            own = at + _chunks(rows[number] - 1)
            starts.append(own[:, 0])
            ends.append(own[:, 1])
            owners.append(np.full(len(own), number))
        self.flat, self.n = flat, len(texts)
        self.starts, self.ends, self.owners = map(np.concatenate, (starts, ends, owners))
        self.chunks = np.bincount(self.owners, minlength=len(texts))
        self.first_chunk = np.cumsum(self.chunks) - self.chunks


class Network:
    def __init__(self, seed: int = 7):
        draw = np.random.default_rng(seed)
        width = CHANNELS * STRIDE
        self.layers = {
            "embedding": draw.normal(0, 0.5, (512, CHANNELS)),
            "left": draw.normal(0, 0.2, (width, FILTERS)),
            "right": draw.normal(0, 0.2, (width, FILTERS)),
            "shift": np.zeros(FILTERS),
            "output": draw.normal(0, 0.1, 2 * FILTERS),
            "bias": np.zeros(1),
        }
        self.layers = {name: layer.astype(np.float32) for name, layer in self.layers.items()}
        self.learned = False

    def _filtered(self, layout: Layout) -> tuple[np.ndarray, np.ndarray]:
        at = self.layers
        strides = at["embedding"][layout.flat].reshape(-1, STRIDE * CHANNELS)
        found = strides[:-1] @ at["left"]
        found += strides[1:] @ at["right"]
        found += at["shift"]
        return strides, np.maximum(found, 0, out=found)

    def _pooled(self, layout: Layout, tops: np.ndarray) -> np.ndarray:
        mean = np.add.reduceat(tops, layout.first_chunk) / layout.chunks[:, None]
        return np.concatenate([mean, np.maximum.reduceat(tops, layout.first_chunk)], 1)

    def _tops(self, layout: Layout) -> np.ndarray:
        """The maximum of every filter in every chunk."""
        _, found = self._filtered(layout)
        # chunks overlap: reduceat over (start, end) pairs, the gaps between thrown away
        edges = np.stack([layout.starts, np.minimum(layout.ends, len(found) - 1)], 1).ravel()
        tops = np.maximum.reduceat(found, edges)[::2]
        last = layout.ends >= len(found)
        tops[last] = np.maximum(tops[last], found[-1])
        return tops

    def _pooled_long(self, text: bytes, slab: int) -> np.ndarray:
        """What :meth:`_pooled` gives for one text, from runs of its chunks."""
        chunks = _chunks(_rows(len(text)) - 1)
        step = max(1, slab // (CHUNK_STEP * STRIDE))
        total, most = np.zeros(FILTERS), np.zeros(FILTERS, np.float32)  # filters are never below zero
        for first in range(0, len(chunks), step):
            starts, ends = chunks[first : first + step].T
            low, high = int(starts[0]), int(ends[-1]) + 1  # strides
            a, b = low * STRIDE, min(high * STRIDE, len(text))
            seen = max(0, a - ECHO)  # echoes look back, four-grams ahead
            own = symbols(np.frombuffer(text[seen : b + 3], np.uint8))[a - seen : b - seen]
            piece = Layout([], own, high - low, np.stack([starts - low, ends - low], 1))
            tops = self._tops(piece)
            total += tops.sum(0, np.float64)
            most = np.maximum(most, tops.max(0))
        return np.concatenate([total / len(chunks), most]).astype(np.float32)[None]

    def scores(self, texts: list[bytes], slab: int = SLAB_BYTES) -> np.ndarray:
        if not self.learned:
            return np.full(len(texts), 0.5)
        out = []
        for start, stop in slabs(texts, slab):
            if stop - start == 1 and len(texts[start]) > slab:
                pooled = self._pooled_long(texts[start], slab)
            else:
                layout = Layout(texts[start:stop])
                pooled = self._pooled(layout, self._tops(layout))
            logits = pooled @ self.layers["output"] + self.layers["bias"]
            out.append(1 / (1 + np.exp(-logits.astype(float))))
        return np.concatenate(out) if out else np.zeros(0)

    def gradients(self, texts: list[bytes], wanted: np.ndarray) -> dict[str, np.ndarray]:
        at, layout = self.layers, Layout(texts)
        strides, found = self._filtered(layout)
        inside = layout.starts[:, None] + np.arange(CHUNK)
        inside = np.minimum(inside, (layout.ends - 1)[:, None])
        values = found[inside]
        best = np.take_along_axis(inside, values.argmax(1), 1)  # chunk x filter: the position that won
        tops = values.max(1)
        pooled = self._pooled(layout, tops)
        logits = pooled @ at["output"] + at["bias"]
        slope = ((1 / (1 + np.exp(-logits))) - wanted) / len(texts)
        slope = slope.astype(np.float32)
        to_mean = slope[:, None] * at["output"][:FILTERS] / layout.chunks[:, None]
        to_max = slope[:, None] * at["output"][FILTERS:]
        to_tops = to_mean[layout.owners]
        leads = tops == pooled[layout.owners, FILTERS:]
        ties = np.add.reduceat(leads.astype(np.float32), layout.first_chunk)
        to_tops = to_tops + leads * (to_max / ties)[layout.owners]
        to_tops = to_tops * (tops > 0)
        change = {"output": pooled.T @ slope, "bias": np.array([slope.sum()]), "shift": to_tops.sum(0)}
        change["left"], change["right"] = np.zeros_like(at["left"]), np.zeros_like(at["right"])
        change["embedding"] = np.zeros_like(at["embedding"])
        for one in range(FILTERS):
            rows, pull = best[:, one], to_tops[:, one]
            change["left"][:, one] = pull @ strides[rows]
            change["right"][:, one] = pull @ strides[rows + 1]
            for side, offset in (("left", 0), ("right", 1)):
                spread = (pull[:, None] * at[side][:, one]).reshape(-1, CHANNELS)
                places = ((rows + offset)[:, None] * STRIDE + np.arange(STRIDE)).ravel()
                np.add.at(change["embedding"], layout.flat[places], spread)
        return change

    def fit(self, texts: list[bytes], labels: list[int]) -> Network:
        """Adam over shuffled mini-batches; the order is fixed by a seed."""
        if not texts:
            return self
        draw, wanted = np.random.default_rng(11), np.array(labels, np.float32)
        first = {name: np.zeros_like(layer) for name, layer in self.layers.items()}
        second = {name: np.zeros_like(layer) for name, layer in self.layers.items()}
        step, epochs = 0, max(EPOCHS, min(60, 20_000 // len(texts)))
        for epoch in range(epochs):
            order = draw.permutation(len(texts))
            rate = RATE * (1 - 0.9 * epoch / epochs)
            for start in range(0, len(order), DOCS_PER_STEP):
                chosen = order[start : start + DOCS_PER_STEP]
                step += 1
                for name, slope in self.gradients([texts[k] for k in chosen], wanted[chosen]).items():
                    first[name] += 0.1 * (slope - first[name])
                    second[name] += 0.01 * (slope**2 - second[name])
                    move = (first[name] / (1 - 0.9**step)) / (np.sqrt(second[name] / (1 - 0.99**step)) + 1e-8)
                    self.layers[name] -= (rate * move).astype(np.float32)
        self.learned = True
        return self


def fit(texts: list[bytes], labels: list[int]) -> Network:
    return Network().fit(texts, labels)


def score(text: str | Column, model: Broadcast) -> Column:
    """The quality of a text column, from 0 to 1."""

    @F.arrow_udf("double")
    def run(column: pa.Array) -> pa.Array:
        # rounded, as a product's last digits depend on what else is in the batch
        return pa.array(np.round(model_of(model).scores(blobs(column)), 5), pa.float64())

    return run.asNondeterministic()(text)


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", rows: int = SAMPLE_ROWS, **sample) -> Broadcast:
    """The network, learned from a bounded sample of the rows that are not held out."""
    return fitted(training_sample(docs, labels, label, rows, **sample), fit)


def score_documents(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: id, held_out, score, predicted."""
    model = train(docs, labels, doc_id=doc_id, text=text)
    scored = docs.select(F.col(doc_id).alias("doc_id"), score(F.col(text), model).alias("score"))
    return scored.select(
        "doc_id",
        held_out("doc_id").alias("held_out"),
        "score",
        (F.col("score") >= THRESHOLD).cast("int").alias("predicted"),
    )
