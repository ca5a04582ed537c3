"""SimHash fingerprints and the classes of documents whose fingerprints lie close.

A fingerprint has a bit for each of 64 majorities over the hashes of a text's word
shingles. Two fingerprints are linked when they differ in at most four bits, and
a class is what links connect.

Candidates come from pigeonring filtering. The 64 bits form a ring of five segments.
If two fingerprints differ in at most four bits, some segment starts a chain whose
cumulative differences over 1, 2, ... 5 segments are at most 0, 1, 2, 3, 4. So the
first segment of the chain is equal, and of the second, cut in three, two parts are
equal: that is the bucket key. Inside a bucket the chain is followed segment by
segment, and what survives has passed the full Hamming check, its last link.

Only distinct fingerprints are compared, so copies never multiply. A bucket of up to
``BUCKET`` fingerprints is compared inside one row. The members of larger buckets go
another, equally exact way that never pairs them: two fingerprints are within four
bits exactly if some word is within two bits of both, so they meet at such midpoints.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from contrail.llm.links import connected
from contrail.llm.text import blobs, free_name
from contrail.session import written

SEED = 42
MAX_DIFF = 4
SHINGLE = 4
CHUNK = 1 << 16


def fingerprint(text: bytes, size: int = SHINGLE) -> int:
    """Majority bits over XXH64 of the word shingles; no words give zero."""
    parts = text.lower().split()
    if not parts:
        return 0
    ends = np.cumsum([len(part) + 1 for part in parts])
    starts = (ends - [len(part) + 1 for part in parts]).tolist()
    stops = (ends[size - 1 :] - 1).tolist() if len(parts) >= size else [int(ends[-1]) - 1]
    joined, digest = b" ".join(parts), xxhash.xxh64_intdigest
    counts = np.zeros(64, np.int64)
    for at in range(0, len(stops), CHUNK):
        hashes = [digest(joined[a:b], SEED) for a, b in zip(starts[at : at + CHUNK], stops[at : at + CHUNK])]
        bits = np.unpackbits(np.array(hashes, "<u8").view(np.uint8), bitorder="little").reshape(-1, 64)
        counts += bits.sum(0, dtype=np.int64)
    majority = (2 * counts > len(stops)).astype(np.uint8)
    return int(np.packbits(majority, bitorder="little").view("<u8")[0])


def fingerprints(text: str | Column) -> Column:
    """The signed 64-bit fingerprint of a text column; null texts have no words."""

    @F.arrow_udf("long")
    def run(column: pa.Array) -> pa.Array:
        found = np.array([fingerprint(text) for text in blobs(column)], np.uint64)
        return pa.array(found.view(np.int64))

    return run.asNondeterministic()(text)


# the ring: segment widths, and where each starts
WIDTHS = (13, 13, 13, 13, 12)
STARTS = (0, 13, 26, 39, 52)
BUCKET = 1024
PARTS = 3


def _part_masks(width: int) -> list[int]:
    """Masks over a segment that leave out one of its parts each."""
    edges = [width * part // PARTS for part in range(PARTS + 1)]
    whole = (1 << width) - 1
    return [whole & ~(((1 << b) - 1) ^ ((1 << a) - 1)) for a, b in zip(edges, edges[1:])]


def bucket_keys(fp: Column) -> Column:
    """All bucket keys of a fingerprint: chain start, its segment, two parts of the next one."""
    segments = [
        F.shiftrightunsigned(fp, start).bitwiseAND(F.lit((1 << width) - 1)) for start, width in zip(STARTS, WIDTHS)
    ]
    keys = []
    for first in range(len(WIDTHS)):
        second = (first + 1) % len(WIDTHS)
        for part, mask in enumerate(_part_masks(WIDTHS[second])):
            variant = first * PARTS + part
            masked = segments[second].bitwiseAND(F.lit(mask))
            keys.append(F.lit(variant << 26) + F.shiftleft(segments[first], 13) + masked)
    return F.array(*keys)


def chain_viable(left: np.ndarray, right: np.ndarray, first: int) -> np.ndarray:
    """Whether the chain from segment ``first`` keeps within its budgets; the last link is the Hamming check."""
    differ = left ^ right
    turn = np.uint64(STARTS[first])
    if first:
        differ = (differ >> turn) | (differ << np.uint64(64 - STARTS[first]))
    viable, reach = np.ones(differ.shape, bool), 0
    for link in range(len(WIDTHS)):
        reach += WIDTHS[(first + link) % len(WIDTHS)]
        budget = (link + 1) * MAX_DIFF // len(WIDTHS)
        low = differ if reach == 64 else differ & np.uint64((1 << reach) - 1)
        viable &= np.bitwise_count(low) <= budget
        if not viable.any():
            break
    return viable


def spanning_links(members: np.ndarray, first: int) -> list[tuple[int, int]]:
    """Links that connect what is linked within one bucket: (smallest of the class, member)."""
    members = np.sort(members)
    codes = members.view(np.uint64)
    near = chain_viable(codes[:, None], codes[None, :], first)
    links, free = [], np.ones(len(members), bool)
    for root in range(len(members)):
        if not free[root]:
            continue
        free[root] = False
        frontier = np.array([root])
        while len(frontier):
            frontier = np.flatnonzero(near[frontier].any(0) & free)
            free[frontier] = False
            links += [(int(members[root]), int(members[at])) for at in frontier]
    return links


def _bucket_links(key: str, members: str) -> Column:
    kind = pa.list_(pa.struct([("a", pa.int64()), ("b", pa.int64())]))

    @F.arrow_udf("array<struct<a: long, b: long>>")
    def run(keys: pa.Array, groups: pa.Array) -> pa.Array:
        found = []
        for code, group in zip(keys.to_pylist(), groups):
            first = (code >> 26) // PARTS
            found.append([{"a": a, "b": b} for a, b in spanning_links(group.values.to_numpy(), first)])
        return pa.array(found, kind)

    return run.asNondeterministic()(key, members)


def midpoint_masks() -> list[int]:
    """Every word of at most two set bits, as signed longs."""
    masks = [0] + [1 << a for a in range(64)] + [1 << a | 1 << b for a in range(64) for b in range(a)]
    return np.array(masks, np.uint64).view(np.int64).tolist()


def fingerprint_links(distinct: DataFrame, bucket: int = BUCKET) -> DataFrame:
    """Links (a, b), a < b, that connect all distinct fingerprints ``fp`` within four bits."""
    keyed = written(distinct.select("fp", F.explode(bucket_keys(F.col("fp"))).alias("key")), "simhash-keys")
    sizes = written(
        keyed.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1"), "simhash-buckets"
    )
    small = keyed.join(sizes.filter(F.col("n") <= bucket).select("key"), "key")
    small = small.groupBy("key").agg(F.collect_list("fp").alias("members"))
    links = small.select(F.explode(_bucket_links("key", "members")).alias("link")).select("link.a", "link.b")
    large = sizes.filter(F.col("n") > bucket).select("key")
    if not large.isEmpty():
        masks = F.array(*[F.lit(mask) for mask in midpoint_masks()])
        crowded = keyed.join(large, "key").select("fp").distinct()
        middles = crowded.select("fp", F.explode(F.transform(masks, lambda m: F.col("fp").bitwiseXOR(m))).alias("mid"))
        # a midpoint has at most 2081 words within two bits, so the lists are bounded
        met = middles.groupBy("mid").agg(F.collect_list("fp").alias("members")).filter(F.size("members") > 1)
        met = met.select(F.array_min("members").alias("a"), F.explode("members").alias("b")).filter("a < b")
        links = links.unionByName(met)
    return links.distinct()


def _rooted(marked: DataFrame, bucket: int) -> DataFrame:
    """(fp, least, root) for every distinct fingerprint: its least document and the least fingerprint of its class."""
    distinct = written(marked.groupBy("fp").agg(F.min("doc_id").alias("least")), "simhash-distinct")
    roots = connected(fingerprint_links(distinct.select("fp"), bucket))
    rooted = distinct.join(roots.withColumnRenamed("node", "fp"), "fp", "left")
    return rooted.select("fp", "least", F.coalesce("root", "fp").alias("root"))


def simhash_classes(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", bucket: int = BUCKET) -> DataFrame:
    """One row per document: its id, ``fp`` and ``component_id``, the smallest id its links reach.

    Repeated rows each keep their row. A null id counts for no class; a class of
    nothing else has a null ``component_id``.
    """
    marked = docs.select(F.col(doc_id).alias("doc_id"), fingerprints(F.col(text)).alias("fp"))
    marked = written(marked, "simhash-fingerprints")
    rooted = _rooted(marked, bucket)
    smallest = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    classes = rooted.join(smallest, "root").select("fp", "component_id")
    return marked.join(classes, "fp").select("doc_id", "fp", "component_id")


def representatives(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", bucket: int = BUCKET) -> DataFrame:
    """One row of each class, with all its columns: the smallest id; of several rows with that id the least text hash.

    A class whose ids are all null keeps one row too.
    """
    digest = F.xxhash64(F.coalesce(F.col(text), F.lit("")))
    marked = docs.select(F.col(doc_id).alias("doc_id"), digest.alias("th"), fingerprints(F.col(text)).alias("fp"))
    marked = written(marked, "simhash-fingerprints")
    roots = _rooted(marked, bucket).select("fp", "root")
    place = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "th")
    # combined per task and per fingerprint before the join, so copies of any number meet it as one row
    counts = marked.groupBy("fp", place.alias("place")).agg(F.count(F.lit(1)).alias("n"))
    firsts = counts.groupBy("fp").agg(F.min(F.struct("place", "n")).alias("first"))
    best = firsts.join(roots, "fp").groupBy("root").agg(F.min("first").alias("best"))
    best = written(best, "simhash-kept")
    kept_id, kept_th = free_name(docs, "_kept_id"), free_name(docs, "_kept_th")
    best = best.select(
        F.col("best.place.doc_id").alias(kept_id), F.col("best.place.th").alias(kept_th), F.col("best.n").alias("n")
    )
    same = F.col(doc_id).eqNullSafe(F.col(kept_id)) & (digest == F.col(kept_th))
    kept = docs.join(best.select(kept_id, kept_th), same, "left_semi")
    if best.filter("n > 1").isEmpty():
        return kept
    # some chosen rows are repeated: one of each stays
    single = kept.withColumn(kept_th, digest).dropDuplicates([doc_id, kept_th])
    return single.select(*docs.columns)
