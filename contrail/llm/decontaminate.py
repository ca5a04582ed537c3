"""Benchmark decontamination with a generalised suffix automaton.

The words of all test items build one automaton. A document's words are streamed
through it and the longest match ending at each word is tracked: where it reaches
the window length, the last window of words also stands in an item. An item shorter
than the window is one window of its own. A document is contaminated when its hit
words reach a share of all its words; spans can also be cut out of the text.

Automata hold a bounded number of bytes of items. A larger benchmark is cut into
blocks, documents are scanned for one block after the other, and the hits are merged.

Null texts have no words, in documents and in items; items without words never occur.
Items repeated under one id count once; items without an id hit but are not listed.
"""

from __future__ import annotations

import hashlib
import pickle
from collections.abc import Iterable
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, functions as F

from contrail.llm.text import WORD, blobs, free_name, words
from contrail.session import written

WINDOW = 13
COVERAGE = 20  # contaminated from one hit word in twenty
BLOCK_BYTES = 8_000_000
PAIR_BITS = 22


class Automaton:
    """Suffix automaton of several word sequences; no match runs from one into the next."""

    def __init__(self, items: Iterable[tuple[str | None, list[bytes]]], window: int = WINDOW):
        self.window = window
        self.codes: dict[bytes, int] = {}
        self.steps: list[dict[int, int]] = [{}]
        self.link, self.longest = [-1], [0]
        coded = []
        for item, parts in items:
            if parts:
                coded.append((item, [self.codes.setdefault(part, len(self.codes)) for part in parts]))
        for _, sequence in coded:
            last = 0
            for code in sequence:
                last = self._extend(last, code)
        self.least = min((len(sequence) for _, sequence in coded), default=window)
        self.least = min(self.least, window)
        self._mark(coded)
        self.pairs = np.zeros(1 << PAIR_BITS, bool)
        for _, sequence in coded:
            codes = np.array(sequence, np.int64)
            self.pairs[self._pair(codes[:-1], codes[1:])] = True

    def _extend(self, last: int, code: int) -> int:
        steps, link, longest = self.steps, self.link, self.longest
        if code in steps[last]:
            there = steps[last][code]
            return there if longest[there] == longest[last] + 1 else self._clone(last, code, there)
        new = len(steps)
        steps.append({})
        longest.append(longest[last] + 1)
        link.append(0)
        at = last
        while at >= 0 and code not in steps[at]:
            steps[at][code] = new
            at = link[at]
        if at >= 0:
            there = steps[at][code]
            link[new] = there if longest[there] == longest[at] + 1 else self._clone(at, code, there)
        return new

    def _clone(self, at: int, code: int, there: int) -> int:
        steps, link, longest = self.steps, self.link, self.longest
        new = len(steps)
        steps.append(dict(steps[there]))
        longest.append(longest[at] + 1)
        link.append(link[there])
        link[there] = new
        while at >= 0 and steps[at].get(code) == there:
            steps[at][code] = new
            at = link[at]
        return new

    def _mark(self, coded: list[tuple[str | None, list[int]]]) -> None:
        """What a match in each state says: its window's items, and the short items that end there."""
        size = len(self.steps)
        self.windows: list[set | None] = [None] * size
        self.shorts: list[list | None] = [None] * size
        self.base = [-1] * size  # the state of the last ``window`` words
        self.short = [-1] * size  # nearest state, self or up the links, where a short item ends
        order = sorted(range(size), key=self.longest.__getitem__)
        for state in order[1:]:
            up = self.link[state]
            if self.longest[state] >= self.window:
                self.base[state] = state if self.longest[up] < self.window else self.base[up]
        for item, sequence in coded:
            state = 0
            for at, code in enumerate(sequence):
                state = self.steps[state][code]
                if at + 1 >= self.window:
                    base = self.base[state]
                    if self.windows[base] is None:
                        self.windows[base] = set()
                    self.windows[base].add(item)
            if len(sequence) < self.window:
                if self.shorts[state] is None:
                    self.shorts[state] = []
                self.shorts[state].append(item)
        for state in order[1:]:
            self.short[state] = state if self.shorts[state] else self.short[self.link[state]]

    def _pair(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        return (left * 1_000_003 + right * 7_919) & ((1 << PAIR_BITS) - 1)

    def _runs(self, codes: np.ndarray) -> list[tuple[int, int]]:
        """Stretches that may hold a window: known words, neighbours that some item has too."""
        if self.least < 2:
            good, extra = codes >= 0, 0
        else:
            good, extra = self.pairs[self._pair(codes[:-1], codes[1:])] & (codes[:-1] >= 0) & (codes[1:] >= 0), 1
        edges = np.flatnonzero(np.diff(np.concatenate(([0], good.view(np.int8), [0]))))
        starts, ends = edges[::2], edges[1::2] + extra
        wide = ends - starts >= self.least
        return list(zip(starts[wide].tolist(), ends[wide].tolist()))

    def scan(self, parts: list[bytes]) -> tuple[list[tuple[int, int]], set]:
        """Merged hit spans in words (end exclusive), and the items that occur."""
        spans: list[tuple[int, int]] = []
        found: set = set()
        if not parts or not self.codes:
            return spans, found
        codes = np.array(list(map(self.codes.get, parts, repeat(-1))), np.int64)
        steps, link, longest, window = self.steps, self.link, self.longest, self.window
        for start, end in self._runs(codes):
            state = length = 0
            for at, code in enumerate(codes[start:end].tolist(), start):
                while state and code not in steps[state]:
                    state = link[state]
                    length = longest[state]
                there = steps[state].get(code)
                if there is None:
                    continue
                state, length = there, length + 1
                reach = 0
                if length >= window:
                    found |= self.windows[self.base[state]]
                    reach = window
                mark = self.short[state]
                while mark >= 0:
                    if longest[mark] <= length:
                        found.update(self.shorts[mark])
                        reach = max(reach, longest[mark])
                    mark = self.short[link[mark]] if link[mark] > 0 else -1
                if reach:
                    _join(spans, at + 1 - reach, at + 1)
        return spans, found


def _join(spans: list[tuple[int, int]], start: int, end: int) -> None:
    """Add a span that ends last, swallowing those it touches."""
    while spans and spans[-1][1] >= start:
        start = min(start, spans.pop()[0])
    spans.append((start, end))


_built: dict[bytes, Automaton] = {}


def _automaton(content: bytes) -> Automaton:
    """One automaton per Python worker."""
    key = hashlib.sha256(content).digest()
    if key not in _built:
        _built.clear()
        window, items = pickle.loads(content)
        _built[key] = Automaton([(item, words(text)) for item, text in items], window)
    return _built[key]


def blocks(benchmark: DataFrame, item_id: str, text: str, window: int, block_bytes: int) -> list[Broadcast]:
    """The items as broadcasts of about ``block_bytes`` bytes each; their number grows with the benchmark."""
    spark = benchmark.sparkSession
    items = benchmark.select(F.col(item_id).cast("string").alias("item"), F.col(text).cast("binary").alias("words"))
    items = items.filter(F.octet_length("words") > 0).distinct()
    size = items.agg(F.sum(F.octet_length("words"))).first()[0] or 0
    count = max(1, -(-size // block_bytes))
    placed = items.withColumn("block", F.pmod(F.xxhash64("item", "words"), F.lit(count)))
    shared = []
    for block in range(count):
        rows = placed.filter(F.col("block") == block).select("item", "words").collect()
        content = (window, sorted(((r["item"], bytes(r["words"])) for r in rows), key=lambda r: (r[0] or "", r[1])))
        shared.append(spark.sparkContext.broadcast(pickle.dumps(content)))
    return shared


SCANNED = "struct<n_words: long, starts: array<long>, ends: array<long>, items: array<string>>"


def scan(text: Column, block: Broadcast) -> Column:
    """Hit spans and items of a text column, for one block of the benchmark."""

    @F.arrow_udf(SCANNED)
    def run(column: pa.Array) -> pa.Array:
        automaton = _automaton(block.value)
        counts, starts, ends, items = [], [], [], []
        for body in blobs(column):
            parts = words(body)
            spans, found = automaton.scan(parts)
            counts.append(len(parts))
            starts.append([a for a, _ in spans])
            ends.append([b for _, b in spans])
            items.append(sorted(found - {None}))
        longs = pa.list_(pa.int64())
        return pa.StructArray.from_arrays(
            [pa.array(counts, pa.int64()), pa.array(starts, longs), pa.array(ends, longs),
             pa.array(items, pa.list_(pa.string()))], ["n_words", "starts", "ends", "items"]
        )

    return run.asNondeterministic()(text)


def merge_spans(starts: Column, ends: Column) -> Column:
    """Spans of several blocks as one sorted list of disjoint spans."""
    longs = pa.list_(pa.int64())

    @F.arrow_udf("struct<starts: array<long>, ends: array<long>>")
    def run(first: pa.Array, last: pa.Array) -> pa.Array:
        left, right = [], []
        for a, b in zip(first.to_pylist(), last.to_pylist()):
            spans: list[tuple[int, int]] = []
            for start, end in sorted(zip(a or [], b or []), key=lambda span: (span[1], span[0])):
                _join(spans, start, end)
            left.append([s for s, _ in spans])
            right.append([e for _, e in spans])
        return pa.StructArray.from_arrays([pa.array(left, longs), pa.array(right, longs)], ["starts", "ends"])

    return run.asNondeterministic()(starts, ends)


def with_hits(
    docs: DataFrame,
    benchmark: DataFrame,
    text: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
    window: int = WINDOW,
    block_bytes: int = BLOCK_BYTES,
    column: str = "hits",
) -> DataFrame:
    """The documents with a struct ``column``: n_words, starts, ends, items, n_hit, contaminated.

    A column of that name in the input is replaced. Spans count words and exclude the end.
    """
    kept = [name for name in docs.columns if name.lower() != column.lower()]
    docs = docs.select(*kept)
    shared = blocks(benchmark, item_id, item_text, window, block_bytes)
    if len(shared) == 1:
        scanned = docs.withColumn(column, scan(F.col(text), shared[0]))
    else:
        # rows of one text are scanned once and meet again by the text's digest
        texts = docs.select(F.col(text).alias("body")).filter("body is not null")
        parts = []
        for block in shared:
            part = texts.select(F.sha2("body", 256).alias("digest"), scan(F.col("body"), block).alias("hit"))
            parts.append(written(part.dropDuplicates(["digest"]), "decontaminate"))
        union = parts[0]
        for part in parts[1:]:
            union = union.unionByName(part)
        merged = union.groupBy("digest").agg(
            F.max("hit.n_words").alias("n_words"),
            F.flatten(F.collect_list("hit.starts")).alias("starts"),
            F.flatten(F.collect_list("hit.ends")).alias("ends"),
            F.array_distinct(F.flatten(F.collect_list("hit.items"))).alias("items"),
        )
        spans = merge_spans(F.col("starts"), F.col("ends"))
        merged = merged.select("digest", "n_words", spans.alias("spans"), "items")
        digest = free_name(docs, "_digest")
        merged = merged.select(
            F.col("digest").alias(digest),
            F.struct("n_words", "spans.starts", "spans.ends", "items").alias(column),
        )
        scanned = docs.join(merged, F.sha2(F.col(text), 256) == F.col(digest), "left").drop(digest)
    none = F.array().cast("array<long>")
    field = lambda name: F.col(column).getField(name)
    n_words = F.coalesce(field("n_words"), F.lit(0).cast("long"))
    n_hit = F.aggregate(
        F.arrays_zip(F.coalesce(field("starts"), none).alias("a"), F.coalesce(field("ends"), none).alias("b")),
        F.lit(0).cast("long"),
        lambda total, span: total + span["b"] - span["a"],
    )
    counted = scanned.select(
        *[F.col(name) for name in kept],
        F.struct(
            n_words.alias("n_words"),
            F.coalesce(field("starts"), none).alias("starts"),
            F.coalesce(field("ends"), none).alias("ends"),
            F.coalesce(field("items"), F.array().cast("array<string>")).alias("items"),
            n_hit.alias("n_hit"),
            ((n_hit > 0) & (COVERAGE * n_hit >= n_words)).alias("contaminated"),
        ).alias(column),
    )
    return counted


def cut_spans(text: str | Column, starts: str | Column, ends: str | Column, least: int = WINDOW) -> Column:
    """The text without its hit spans of at least ``least`` words; what stands between words goes with them."""

    @F.arrow_udf("string")
    def run(column: pa.Array, first: pa.Array, last: pa.Array) -> pa.Array:
        out = []
        for body, starts, ends in zip(column.cast(pa.binary()).to_pylist(), first.to_pylist(), last.to_pylist()):
            wide = [(a, b) for a, b in zip(starts or [], ends or []) if b - a >= least]
            if body and wide:
                places = [m.span() for m in WORD.finditer(body.lower())]
                pieces, done = [], 0
                for a, b in wide:
                    pieces.append(body[done : places[a][0]])
                    done = places[b - 1][1]
                body = b"".join([*pieces, body[done:]])
            out.append(None if body is None else body.decode())
        return pa.array(out, pa.string())

    return run.asNondeterministic()(text, starts, ends)
