"""Exact top-k by integer inner product: columnar branch and bound.

Vectors become integers, floor(256 x). Candidates lie dimension by dimension; scores
grow one block of dimensions after the other. What the dimensions still to come can
add is at most the product of the remaining norms, so a candidate whose score and
remaining mass stay below a query's k-th best is out, and the survivors are compacted
before the next block.

Queries are broadcast in blocks of a fixed size, every block against all rows, and a
task keeps k rows per query. Vectors that are null or hold a null or non-finite
component take no part; shorter vectors count as padded with zeros. Candidates with the
query's own id are left out. Repeated candidate rows each take a place; of repeated
query rows the least vector counts. Scores beyond 64 bits are cut to that range.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, Window as W, functions as F

K = 5
QUERY_BLOCK = 4096
CHUNK = 4096  # candidates that are looked at together
SEED_CHUNK = 256  # the first few set the first bounds
DIMENSIONS = 8  # of a block
SPARSE = 0.1  # share of pairs left at which pairs are followed one by one
PAIRS = 2_000_000  # of a (query, candidate) matrix

EXACT = float(1 << 53)


def usable(vector: str | Column) -> Column:
    column = F.col(vector) if isinstance(vector, str) else vector
    finite = F.forall(column, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return column.isNotNull() & finite


def to_integers(values: list[np.ndarray]) -> np.ndarray:
    """Rows of floor(256 x), padded with zeros; Python integers where floats would not be exact."""
    width = max((len(value) for value in values), default=0)
    out = np.zeros((len(values), width))
    for row, value in enumerate(values):
        out[row, : len(value)] = value
    out = np.floor(256.0 * out)
    if out.size and np.abs(out).max() ** 2 * max(1, width) >= EXACT:
        return np.array([[int(x) for x in row] for row in out], object).reshape(out.shape)
    return out


class Search:
    """Best k of each query so far."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, k: int = K):
        self.ids, self.vectors, self.k = ids, vectors, k
        self.owner = np.zeros(0, np.int64)
        self.scores = np.zeros(0, vectors.dtype)
        self.found = np.zeros(0, np.int64)

    def _least(self) -> np.ndarray:
        """The k-th best score of each query, minus infinity while it has fewer."""
        least = np.full(len(self.ids), -np.inf)
        counts = np.bincount(self.owner, minlength=len(self.ids))
        lasts = np.cumsum(counts) - 1
        full = counts >= self.k
        least[full] = self.scores[lasts[full]].astype(float)
        return least

    def _merge(self, owner: np.ndarray, scores: np.ndarray, found: np.ndarray) -> None:
        other = found != self.ids[owner]
        owner = np.concatenate([self.owner, owner[other]])
        scores = np.concatenate([self.scores, scores[other]])
        found = np.concatenate([self.found, found[other]])
        order = np.lexsort((found, -scores, owner))
        owner, scores, found = owner[order], scores[order], found[order]
        firsts = np.searchsorted(owner, owner)
        kept = np.arange(len(owner)) - firsts < self.k
        self.owner, self.scores, self.found = owner[kept], scores[kept], found[kept]

    def look_at(self, ids: np.ndarray, vectors: np.ndarray) -> None:
        """Let candidates compete, a chunk at a time."""
        if not len(self.ids) or not len(ids):
            return
        width = max(self.vectors.shape[1], vectors.shape[1])
        queries, vectors = _widened(self.vectors, width), _widened(vectors, width)
        chunk = max(1, min(CHUNK, PAIRS // len(self.ids)))
        at = 0
        while at < len(ids):
            size = min(chunk, SEED_CHUNK) if len(self.owner) < self.k * len(self.ids) else chunk
            part = vectors[at : at + size]
            large = max(_reach(queries) * _reach(part) * max(1, width), 0)
            if queries.dtype == object or part.dtype == object or large >= EXACT:
                self._plainly(ids[at : at + size], part.astype(object), queries.astype(object))
            else:
                self._bounded(ids[at : at + size], np.ascontiguousarray(part.T), queries)
            at += size

    def _plainly(self, ids: np.ndarray, vectors: np.ndarray, queries: np.ndarray) -> None:
        low, high = -(1 << 63), (1 << 63) - 1
        scores = np.array([[min(max(int(s), low), high) for s in row] for row in queries.dot(vectors.T)], object)
        self.scores = self.scores.astype(object)
        owner, which = np.divmod(np.arange(scores.size), len(ids))
        self._merge(owner, scores.ravel(), ids[which])

    def _bounded(self, ids: np.ndarray, columns: np.ndarray, queries: np.ndarray) -> None:
        blocks = [slice(a, a + DIMENSIONS) for a in range(0, len(columns), DIMENSIONS)] or [slice(0, 0)]
        # the blocks with most mass first: what remains gets small soon
        mass = [float((columns[b] ** 2).sum()) for b in blocks]
        blocks = [blocks[i] for i in sorted(range(len(blocks)), key=lambda i: -mass[i])]
        left = np.cumsum([(columns[b] ** 2).sum(0) for b in reversed(blocks)], 0)[::-1]
        right = np.cumsum([(queries[:, b] ** 2).sum(1) for b in reversed(blocks)], 0)[::-1]
        least = self._least()
        here = np.arange(len(ids))
        scores = np.zeros((len(queries), len(ids)))
        pairs: tuple[np.ndarray, np.ndarray] | None = None
        for number, block in enumerate(blocks):
            if pairs is None:
                scores = scores + queries[:, block] @ columns[block][:, here]
            else:
                owner, which = pairs
                scores = scores + np.einsum("pd,dp->p", queries[owner, block], columns[block][:, which])
            if number + 1 == len(blocks):
                break
            rest_x, rest_q = np.sqrt(left[number + 1]), np.sqrt(right[number + 1])
            if pairs is None:
                alive = scores + rest_q[:, None] * rest_x[None, here] >= least[:, None] - 1
                some = alive.any(0)
                here, scores, alive = here[some], scores[:, some], alive[:, some]
                if alive.size and alive.mean() <= SPARSE:
                    owner, which = np.nonzero(alive)
                    pairs, scores = (owner, here[which]), scores[owner, which]
            else:
                owner, which = pairs
                alive = scores + rest_q[owner] * rest_x[which] >= least[owner] - 1
                pairs, scores = (owner[alive], which[alive]), scores[alive]
        if pairs is None:
            owner, which = np.nonzero(scores >= least[:, None])
            self._merge(owner, scores[owner, which], ids[here[which]])
        else:
            owner, which = pairs
            good = scores >= least[owner]
            self._merge(owner[good], scores[good], ids[which[good]])


def _widened(rows: np.ndarray, width: int) -> np.ndarray:
    if rows.shape[1] == width:
        return rows
    return np.concatenate([rows, np.zeros((len(rows), width - rows.shape[1]), rows.dtype)], 1)


def _reach(rows: np.ndarray) -> float:
    return float(np.abs(rows).max()) if rows.size else 0.0


def _vectors(column: pa.Array) -> list[np.ndarray]:
    values = column.values.to_numpy(zero_copy_only=False).astype(float)
    offsets = column.offsets.to_numpy()
    return [values[a:b] for a, b in zip(offsets, offsets[1:])]


def _block_hits(rows: DataFrame, queries: Broadcast, k: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, vectors = pickle.loads(queries.value)
        search = Search(ids, to_integers(vectors), k)
        for batch in batches:
            found = to_integers(_vectors(batch.column("vector")))
            search.look_at(batch.column("vec_id").to_numpy(zero_copy_only=False), found)
        if len(search.owner):
            arrays = [search.ids[search.owner], search.found, [int(s) for s in search.scores]]
            yield pa.RecordBatch.from_arrays(
                [pa.array(a, pa.int64()) for a in arrays], ["query_id", "vec_id", "score"]
            )

    return rows.mapInArrow(run, "query_id long, vec_id long, score long")


def top_k(
    vectors: DataFrame,
    queries: DataFrame,
    vec_id: str = "vec_id",
    vector: str = "embedding",
    k: int = K,
    query_block: int = QUERY_BLOCK,
) -> DataFrame:
    """(query_id, rank, vec_id, score): the k best candidates of every query, ties to the smaller id."""

    def chosen(frame: DataFrame) -> DataFrame:
        return frame.select(
            F.col(vec_id).cast("long").alias("vec_id"), F.col(vector).cast("array<double>").alias("vector")
        ).filter(F.col("vec_id").isNotNull() & usable("vector"))

    rows, asked = chosen(vectors), chosen(queries).groupBy("vec_id").agg(F.min("vector").alias("vector"))
    blocks = max(1, -(-asked.count() // query_block))
    hits = None
    for block in range(blocks):
        part = asked.filter(F.pmod(F.xxhash64("vec_id"), F.lit(blocks)) == block).sort("vec_id").toArrow()
        part = part.combine_chunks()
        lists = part.column("vector").chunk(0) if part.num_rows else pa.array([], pa.list_(pa.float64()))
        content = (part.column("vec_id").to_numpy(), _vectors(lists))
        shared = vectors.sparkSession.sparkContext.broadcast(pickle.dumps(content))
        found = _block_hits(rows, shared, k)
        hits = found if hits is None else hits.unionByName(found)
    order = W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = hits.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    return ranked.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
