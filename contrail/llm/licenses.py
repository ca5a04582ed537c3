"""License scans: licence phrases, and an exact set-similarity join with licence templates.

Phrases are searched as consecutive words. Templates are sets of words. A text block,
some consecutive words of a line or of the whole text, meets a template when it holds
the required share of the template's words. The join is exact and filtered three ways, with all words in
one global order, rarest in the whole corpus first: a block must hold a word of the
template's prefix, must be long enough, and the places of the first shared word in
both orders must leave room for the overlap. What the join finds is confirmed by place: the
shared words must stand in a stretch of the block that is not longer than the template
over the share, so words scattered over a paragraph, or a longer notice around them, are no match.
A stretch inside a longer one that met another licence's template gives no label of its own.

Null texts count as empty. Lines and templates of any length are covered: a line longer than a block
is cut into blocks that overlap by half, so every run of half a block's words stands
whole in one, and half a block is as long as the longest stretch that can meet a template. The same blocks run over the words of the whole text, for notices that are
wrapped over several lines. Repeated rows are scanned alike. The templates and phrases are given
as parameters; their number does not depend on the data.
"""

from __future__ import annotations

import math
import pickle
from collections import Counter
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, functions as F

from contrail.llm.text import blobs, words

# The phrases of the contract, and notices by which licences are declared.
PHRASES = (
    ("mit", "under the mit license"),
    ("apache-2", "apache license version 2"),
    ("cc-by-nc", "cc by nc"),
)
TEMPLATES = (
    ("mit", "released under the mit license"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and "
            "associated documentation files"),
    ("apache-2", "licensed under the apache license version 2 0"),
    ("cc-by-nc", "licensed under cc by nc 4 0"),
    ("cc-by-nc", "creative commons attribution noncommercial 4 0 international license"),
    ("cc-by-sa", "licensed under cc by sa 4 0"),
    ("cc-by-sa", "creative commons attribution sharealike 4 0 international license"),
    ("gpl-2", "licensed under the gnu general public license version 2"),
    ("gpl-3", "licensed under the gnu general public license version 3"),
    ("lgpl-3", "licensed under the gnu lesser general public license version 3"),
    ("agpl-3", "licensed under the gnu affero general public license version 3"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided "
            "that the following conditions are met"),
    ("mpl-2", "this source code form is subject to the terms of the mozilla public license v 2 0"),
    ("apache-2", "licensed under the apache license version 2 0 the license you may not use this file except in compliance "
                 "with the license you may obtain a copy of the license at http www apache org licenses license 2 0"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby "
            "granted provided that the above copyright notice and this permission notice appear in all copies"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated "
            "documentation files the software to deal in the software without restriction including without limitation the "
            "rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit "
            "persons to whom the software is furnished to do so subject to the following conditions the above copyright "
            "notice and this permission notice shall be included in all copies or substantial portions of the software"),
    ("unlicense", "this is free and unencumbered software released into the public domain"),
)
CONTAINMENT = 0.95
LEAST_BLOCK = 64

Labelled = tuple[tuple[str, str], ...]


def _token_set(notice: str) -> frozenset[bytes]:
    return frozenset(words(notice.encode()))


def token_counts(docs: DataFrame, text: str, tokens: frozenset[bytes]) -> dict[bytes, int]:
    """How often each template word stands in all documents; one row per word and task comes together."""
    wanted = sorted(tokens)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter = Counter()
        keep = tokens
        for batch in batches:
            for body in blobs(batch.column("text")):
                found = Counter(words(body))
                for token in keep.intersection(found):
                    held[token] += found[token]
        if held:
            names = sorted(held)
            yield pa.RecordBatch.from_arrays(
                [pa.array([n.decode() for n in names]), pa.array([held[n] for n in names], pa.int64())], ["token", "n"]
            )

    counted = docs.select(F.col(text).alias("text")).mapInArrow(run, "token string, n long")
    rows = counted.groupBy("token").agg(F.sum("n").alias("n")).collect()
    return dict.fromkeys(wanted, 0) | {row["token"].encode(): row["n"] for row in rows}


def outermost(some: list[tuple], every: list[tuple]) -> list[tuple]:
    """The stretches that no longer one of another label covers; both lists hold (start, end, label, containment)."""
    ends: dict[str, int] = {}  # label -> the furthest end among the stretches seen so far
    firsts: dict[str, int] = {}  # the earliest start of a stretch that ends there
    inner, ordered = set(), sorted(set(every), key=lambda s: (s[0], -s[1]))
    for start, end, label, share in ordered:
        # what has been seen starts before, or at the same place and ends no sooner
        if any(far > end or far == end and firsts[name] < start for name, far in ends.items() if name != label):
            inner.add((start, end, label, share))
        if end > ends.get(label, -1):
            ends[label], firsts[label] = end, start
    return [stretch for stretch in some if stretch not in inner]


class Join:
    """Templates against text blocks, both as word lists in the global order."""

    def __init__(self, templates: Labelled, phrases: Labelled, counts: dict[bytes, int], containment: float):
        order = sorted(counts, key=lambda token: (counts[token], token))
        self.rank = {token: rank for rank, token in enumerate(order)}
        self.labels = [label for label, _ in templates]
        self.lists = [sorted(self.rank[token] for token in _token_set(notice)) for _, notice in templates]
        self.needed = [max(1, math.ceil(containment * len(ranks) - 1e-9)) for ranks in self.lists]
        # the longest stretch that may hold a template's words
        self.longest = [max(1, math.floor(len(words(notice.encode())) / containment + 1e-9)) for _, notice in templates]
        self.block_words = max([LEAST_BLOCK, *(2 * longest for longest in self.longest)])
        # rank of a prefix word -> (template, its place in the template's order)
        self.prefixes: dict[int, list[tuple[int, int]]] = {}
        for number, (ranks, need) in enumerate(zip(self.lists, self.needed)):
            for place, rank in enumerate(ranks[: len(ranks) - need + 1]):
                self.prefixes.setdefault(rank, []).append((number, place))
        self.is_prefix = np.zeros(len(order) + 1, bool)  # the last stands for words of no template
        self.is_prefix[list(self.prefixes)] = True
        self.phrases = [(label, words(phrase.encode())) for label, phrase in phrases]

    def matches(self, block: list[int]) -> list[tuple[int, float]]:
        """Templates that a block of sorted distinct ranks meets, with their containment."""
        seen: set[int] = set()
        found = []
        for mine, rank in enumerate(block):
            for number, place in self.prefixes.get(rank, ()):
                if number in seen:
                    continue
                seen.add(number)  # the first shared word: all others stand behind it in both orders
                need, ranks = self.needed[number], self.lists[number]
                if len(block) < need or 1 + min(len(ranks) - place - 1, len(block) - mine - 1) < need:
                    continue
                shared = len(set(block).intersection(ranks))
                if shared >= need:
                    found.append((number, shared / len(ranks)))
        return found

    def place(self, block: list[int], number: int) -> tuple[int, int, float] | None:
        """The first stretch of a block that holds most of a template's words, and no more words than the template allows."""
        wanted, longest = set(self.lists[number]), self.longest[number]
        held: Counter = Counter()
        best, left = None, 0
        for right, rank in enumerate(block):
            if rank not in wanted:
                continue
            held[rank] += 1
            # keep to the allowed length, and begin with a word that is not held twice
            while right - left >= longest or block[left] not in wanted or held[block[left]] > 1:
                if block[left] in wanted:
                    held[block[left]] -= 1
                    if not held[block[left]]:
                        del held[block[left]]
                left += 1
            if len(held) >= self.needed[number] and (best is None or len(held) > best[2]):
                best = (left, right + 1, len(held))
        return best and (best[0], best[1], best[2] / len(wanted))

    def _stretch(self, ranks: np.ndarray, hits: np.ndarray, start: int, end: int) -> list[tuple]:
        """Where some consecutive words meet a template, from overlapping blocks: (start, end, label, containment)."""
        found, step = set(), self.block_words // 2
        for first in range(start, max(start + 1, end - self.block_words + step), step):
            last = min(first + self.block_words, end)
            if not hits[first:last].any():
                continue
            block = np.unique(ranks[first:last])
            met = self.matches(block[block >= 0].tolist())
            inside = ranks[first:last].tolist() if met else []
            for number, _ in met:
                if place := self.place(inside, number):
                    found.add((first + place[0], first + place[1], self.labels[number], place[2]))
        return sorted(found)

    def scan(self, text: bytes) -> dict:
        lines = [words(line) for line in text.split(b"\n")]
        parts = [part for line in lines for part in line]
        places, base = [], set()
        for label, phrase in self.phrases:
            at = -1
            while True:
                try:
                    at = parts.index(phrase[0], at + 1)
                except ValueError:
                    break
                if parts[at : at + len(phrase)] == phrase:
                    places.append(at)
                    base.add(label)
        ranks = np.array(list(map(self.rank.get, parts, repeat(-1))), np.int64)
        spans, wrapped = [], []
        hits = self.is_prefix[ranks]
        if hits.any():
            start = 0
            for line in lines:
                spans += self._stretch(ranks, hits, start, start + len(line))
                start += len(line)
            if sum(map(bool, lines)) > 1:
                wrapped = self._stretch(ranks, hits, 0, len(parts))
            every = spans + wrapped
            spans, wrapped = (outermost(some, every) for some in (spans, wrapped))
        best = max([1.0 if base else 0.0, *(share for *_, share in spans + wrapped)])
        labels = base.union(label for _, _, label, _ in spans + wrapped)
        return {
            "n_words": len(parts), "n_base": len(places), "first_word": min(places, default=None),
            "last_word": max(places, default=None), "base_labels": sorted(base), "labels": sorted(labels),
            "score": best, "blocks": spans, "wrapped": wrapped,
        }


SCANNED = (
    "struct<n_words: long, n_base: long, first_word: long, last_word: long, base_labels: array<string>, "
    "labels: array<string>, score: double, "
    "blocks: array<struct<start: long, end: long, label: string, containment: double>>, "
    "wrapped: array<struct<start: long, end: long, label: string, containment: double>>>"
)
BLOCKS = pa.list_(
    pa.struct([("start", pa.int64()), ("end", pa.int64()), ("label", pa.string()), ("containment", pa.float64())])
)
FIELDS = {
    "n_words": pa.int64(), "n_base": pa.int64(), "first_word": pa.int64(), "last_word": pa.int64(),
    "base_labels": pa.list_(pa.string()), "labels": pa.list_(pa.string()), "score": pa.float64(), "blocks": BLOCKS,
    "wrapped": BLOCKS,
}

_joins: dict[bytes, Join] = {}


def scan(text: Column, shared: Broadcast) -> Column:
    """Phrases and template matches of a text column."""

    @F.arrow_udf(SCANNED)
    def run(column: pa.Array) -> pa.Array:
        content = shared.value
        if content not in _joins:
            _joins.clear()
            _joins[content] = Join(*pickle.loads(content))
        rows = [_joins[content].scan(body) for body in blobs(column)]
        arrays = []
        for name, kind in FIELDS.items():
            values = [row[name] for row in rows]
            if kind == BLOCKS:
                values = [[dict(zip(("start", "end", "label", "containment"), b)) for b in v] for v in values]
            arrays.append(pa.array(values, kind))
        return pa.StructArray.from_arrays(arrays, list(FIELDS))

    return run.asNondeterministic()(text)


def scan_documents(
    docs: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    templates: Labelled = TEMPLATES,
    phrases: Labelled = PHRASES,
    containment: float = CONTAINMENT,
) -> DataFrame:
    """One row per document: id, words, phrase places, labels, score and matching blocks of lines and of the whole text (in words)."""
    tokens = frozenset().union(*(_token_set(notice) for _, notice in templates)) if templates else frozenset()
    counts = token_counts(docs, text, tokens)
    content = pickle.dumps((templates, phrases, counts, containment))
    shared = docs.sparkSession.sparkContext.broadcast(content)
    found = docs.select(F.col(doc_id).alias("doc_id"), scan(F.col(text), shared).alias("s"))
    return found.select("doc_id", "s.*")
