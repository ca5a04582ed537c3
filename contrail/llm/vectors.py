"""Near copies among embeddings: random-hyperplane sign hashing, exact cosines, components.

Vectors of one label are compared. Each of several tables cuts the space by its own
random hyperplanes; vectors on the same side of all of them share a bucket, and pairs
that share a bucket are verified by their cosine in double precision. What verified
pairs connect is a component.

A pair at the threshold falls on the same side of a random hyperplane with probability
1 - angle / pi. The hyperplanes of a table grow with the logarithm of the rows, so buckets of
unrelated vectors stay small, and there are as many tables as it takes to meet such a pair
with probability ``RECALL`` at any size; closer pairs are met more surely. This is the only
approximation: nothing below the threshold is linked, and no bucket is capped.

Equal vectors of a label are one node with a count. A bucket of more than ``TILE`` nodes is
dealt into tiles, and every pair of tiles is one group, so a group holds about two tiles
whatever the bucket holds. A pair that meets in several tables counts in the first of them
only, which its two rows of bucket numbers tell. A group gives one row per member that has
links (how many, and the least member it is connected with), never its pairs.

Rows without id or label and vectors that are null, empty, zero or hold a null or
non-finite component link with nothing: they keep their row, with no links and their own id as
component. Vectors of different length are never linked. Repeated rows each keep their
row and count as links of each other; an id that stands on several vectors belongs to all of them, and
a component is named by the least id on any of its vectors.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from contrail.llm.links import connected
from contrail.llm.topk import usable
from contrail.session import written

THRESHOLD = 0.93
RECALL = 0.995
BUCKET_ROWS = 16  # unrelated vectors a bucket holds on average
LEAST_BITS, MOST_BITS = 8, 30
TILE = 1024
SMALL = 48  # members up to which groups are compared side by side
SEED = 20_11


def layout(rows: int, threshold: float = THRESHOLD, recall: float = RECALL) -> tuple[int, int]:
    """(hyperplanes of a table, tables) for so many rows."""
    bits = math.ceil(math.log2(max(rows, 1) / BUCKET_ROWS)) if rows > BUCKET_ROWS else 0
    bits = min(MOST_BITS, max(LEAST_BITS, bits))
    same = 1 - math.acos(threshold) / math.pi
    return bits, max(1, math.ceil(math.log(1 - recall) / math.log1p(-(same**bits))))


def _rows(column: pa.Array) -> list[np.ndarray]:
    values = column.flatten().to_numpy(zero_copy_only=False).astype(float)
    ends = np.cumsum(column.value_lengths().to_numpy(zero_copy_only=False))
    return np.split(values, ends[:-1]) if len(ends) else []


def unit_rows(vectors: list[np.ndarray]) -> np.ndarray:
    """Vectors of length one, padded with zeros; scaled first, so squares neither overflow nor vanish."""
    out = np.zeros((len(vectors), max(map(len, vectors), default=0)))
    for row, vector in enumerate(vectors):
        out[row, : len(vector)] = vector
    out /= np.abs(out).max(1, keepdims=True)
    return out / np.linalg.norm(out, axis=1, keepdims=True)


def bucket_numbers(units: np.ndarray, length: int, bits: int, tables: int) -> np.ndarray:
    """One bucket number per vector and table: which side of the table's hyperplanes the vector is on."""
    planes = np.random.default_rng([SEED, length]).standard_normal((length, tables * bits))
    sides = (units[:, :length] @ planes > 0).reshape(len(units), tables, bits)
    return (sides @ (1 << np.arange(bits))).astype(np.int32)


def sign_codes(vector: str, bits: int, tables: int) -> Column:
    @F.arrow_udf("array<int>")
    def run(column: pa.Array) -> pa.Array:
        vectors = _rows(column)
        lengths = np.array([len(v) for v in vectors])
        codes = np.zeros((len(vectors), tables), np.int32)
        for length in np.unique(lengths).tolist():
            own = np.flatnonzero(lengths == length)
            codes[own] = bucket_numbers(unit_rows([vectors[i] for i in own]), length, bits, tables)
        return pa.FixedSizeListArray.from_arrays(pa.array(codes.ravel()), tables).cast(pa.list_(pa.int32()))

    return run.asNondeterministic()(vector)


def _near(units: np.ndarray, starts: np.ndarray, sizes: np.ndarray, threshold: float) -> Iterator[tuple]:
    """Index pairs of near rows inside the groups."""
    rows = np.arange(len(units))
    ends = np.repeat(starts + sizes, sizes)
    small = np.repeat(sizes <= SMALL, sizes)
    for lag in range(1, int(sizes[sizes <= SMALL].max(initial=1))):
        left = rows[small & (rows + lag < ends)]
        cosines = np.einsum("ij,ij->i", units[left], units[left + lag])
        left = left[cosines >= threshold]
        yield left, left + lag
    for start, size in zip(starts[sizes > SMALL].tolist(), sizes[sizes > SMALL].tolist()):
        for at in range(start, start + size, 256):
            own = units[at : min(at + 256, start + size)]
            left, right = np.nonzero(own @ units[at : start + size].T >= threshold)
            later = right > left
            yield at + left[later], at + right[later]


def group_links(
    units: np.ndarray,
    starts: np.ndarray,
    copies: np.ndarray,
    codes: np.ndarray,
    table: np.ndarray,
    side: np.ndarray,
    threshold: float,
) -> tuple[np.ndarray, np.ndarray]:
    """Per row its links (with repetitions of the other side) and the least row it is connected with.

    ``side`` is the tile of a row in groups of two tiles, where only pairs across count, and -1 - row elsewhere.
    """
    sizes = np.diff(np.append(starts, len(units)))
    added, root = np.zeros(len(units), np.int64), np.arange(len(units))
    before = np.arange(codes.shape[1])
    lefts, rights = [], []
    for left, right in _near(units, starts, sizes, threshold):
        for at in range(0, len(left), 1 << 16):
            a, b = left[at : at + (1 << 16)], right[at : at + (1 << 16)]
            across = side[a] != side[b]
            a, b = a[across], b[across]
            met = ((codes[a] == codes[b]) & (before < table[a][:, None])).any(1)
            a, b = a[~met], b[~met]
            np.add.at(added, a, copies[b])
            np.add.at(added, b, copies[a])
            lefts.append(a.astype(np.int32))
            rights.append(b.astype(np.int32))
    left = np.concatenate(lefts) if lefts else np.zeros(0, int)
    right = np.concatenate(rights) if rights else np.zeros(0, int)
    while len(left):
        least = np.minimum(root[left], root[right])
        np.minimum.at(root, root[left], least)
        np.minimum.at(root, root[right], least)
        np.minimum.at(root, left, least)
        np.minimum.at(root, right, least)
        root = root[root]
        apart = root[left] != root[right]
        left, right = left[apart], right[apart]
    while (root[root] != root).any():
        root = root[root]
    return added, root


KEYS = ["label", "length", "place", "code", "low", "high"]


def _group_starts(table: pa.Table) -> np.ndarray:
    fresh = np.zeros(table.num_rows, bool)
    fresh[:1] = True
    for name in KEYS:
        column = table.column(name).combine_chunks()
        if name == "label":
            column = column.dictionary_encode().indices
        values = column.to_numpy(zero_copy_only=False)
        fresh[1:] |= values[1:] != values[:-1]
    return np.flatnonzero(fresh)


def _verified(members: DataFrame, threshold: float) -> DataFrame:
    """(node, links, root) per member with links; groups stand together in the sorted partitions."""

    def found(table: pa.Table, starts: np.ndarray) -> pa.RecordBatch:
        column = lambda name: table.column(name).combine_chunks()
        plain = lambda name: column(name).to_numpy(zero_copy_only=False)
        units = unit_rows(_rows(column("vector")))
        codes = column("codes").flatten().to_numpy(zero_copy_only=False).reshape(len(units), -1)
        inside = plain("low") == plain("high")
        side = np.where(inside, -1 - np.arange(len(units)), plain("own"))
        added, root = group_links(units, starts, plain("copies"), codes, plain("place"), side, threshold)
        nodes, linked = plain("node"), added > 0
        return pa.RecordBatch.from_arrays(
            [pa.array(x) for x in (nodes[linked], added[linked], nodes[root[linked]])], ["node", "links", "root"]
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []  # the last group so far may go on in the next batch
        waiting = 0
        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(batch)
            waiting += batch.num_rows
            if waiting < 4 * TILE:
                continue
            table = pa.Table.from_batches(held)
            starts = _group_starts(table)
            last = int(starts[-1])
            if last:
                yield found(table.slice(0, last), starts[:-1])
            held = table.slice(last).combine_chunks().to_batches()
            waiting = table.num_rows - last
        if held:
            table = pa.Table.from_batches(held)
            yield found(table, _group_starts(table))

    return members.mapInArrow(run, "node long, links long, root long")


def _members(nodes: DataFrame, tile: int) -> DataFrame:
    """Nodes once per group they are compared in; buckets of one are left out before any vector moves."""
    keys = nodes.select("node", "label", "length", F.posexplode("codes").alias("place", "code"))
    bucket = ["label", "length", "place", "code"]
    sizes = keys.groupBy(bucket).agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    tiles = sizes.select(*bucket, F.ceil(F.col("n") / tile).cast("int").alias("tiles"))
    busy = keys.join(tiles, bucket).groupBy("node").agg(F.collect_list(F.struct("place", "tiles")).alias("busy"))
    spread = nodes.join(busy, "node").select("*", F.inline("busy")).drop("busy")
    own = F.pmod(F.xxhash64("node", "place"), F.col("tiles")).cast("int")
    spread = spread.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
    return spread.select(
        "label",
        "length",
        "place",
        F.element_at("codes", F.col("place") + 1).alias("code"),
        F.least("own", "other").alias("low"),
        F.greatest("own", "other").alias("high"),
        "own",
        "node",
        "copies",
        "vector",
        "codes",
    )


def near_copies(
    embeddings: DataFrame,
    vec_id: str = "vec_id",
    vector: str = "embedding",
    label: str = "label",
    threshold: float = THRESHOLD,
    recall: float = RECALL,
    tile: int = TILE,
) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for every row; see the module for what links."""
    rows = embeddings.select(
        F.col(vec_id).cast("long").alias("vec_id"), F.col(vector).alias("vector"), F.col(label).alias("label")
    )
    fit = F.col("vec_id").isNotNull() & F.col("label").isNotNull() & usable("vector")
    fit = F.coalesce(fit & F.exists("vector", lambda x: x != 0), F.lit(False))
    distinct = rows.filter(fit).groupBy("label", "vector").agg(
        F.min("vec_id").alias("least"), F.count(F.lit(1)).alias("copies")
    )
    distinct = written(distinct.withColumn("node", F.monotonically_increasing_id()), "vectors-distinct")
    bits, tables = layout(distinct.count(), threshold, recall)
    nodes = distinct.select(
        "node",
        F.col("label").cast("string").alias("label"),
        "vector",
        "copies",
        F.size("vector").alias("length"),
        sign_codes("vector", bits, tables).alias("codes"),
    )
    nodes = written(nodes, "vectors-codes")
    members = _members(nodes, tile).repartition(*KEYS).sortWithinPartitions(*KEYS)
    found = written(_verified(members, threshold), "vectors-links")
    counts = found.groupBy("node").agg(F.sum("links").alias("links"))
    roots = connected(found.select(F.col("root").alias("a"), F.col("node").alias("b")))
    told = distinct.join(counts, "node", "left").join(roots, "node", "left")
    told = written(
        told.select(
            "label",
            "vector",
            "least",
            (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"),
            F.coalesce("root", "node").alias("root"),
        ),
        "vectors-classes",
    )
    smallest = told.groupBy("root").agg(F.min("least").alias("component_id"))
    classes = told.join(smallest, "root").select("label", "vector", "n_links", "component_id")
    linked = rows.filter(fit).join(classes, ["label", "vector"]).select("vec_id", "n_links", "component_id")
    alone = rows.filter(~fit).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    kept = F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False))
    return linked.unionByName(alone).withColumn("kept", kept)
