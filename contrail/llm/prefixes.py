"""The prefix trie of rebuilt conversations, screened by a count-min sketch of prefix digests.

A conversation c is rebuilt from the first h turns of conversation c - c % 20 and its own turns
behind its first h, h being crc32 of its decimal id modulo 4. Every distinct sequence of
first turns is a node. All but the root's row per conversation comes from one digest per
prefix; texts are read once, for their digest and their count of words, and never move.

Screening. Every prefix adds one to a cell in each row of a count-min sketch. The least of
its cells is never below the prefix's count, so an estimate of one proves that a single
conversation holds the prefix. Its node, and with it the whole tail, is then known from that
conversation alone and is emitted in place. Only the other prefixes, shared or colliding, are
shuffled and grouped exactly. The sketch has a fixed largest size (``MOST_CELLS`` per row, one bit
each for "more than one"); with more prefixes than that it screens less, the result is the same.

A digest of a prefix is made of sums over its turns of SHA-256 parts of (place, turn), six
parts of 32 bits, so all prefixes of a conversation come from running sums, and a conversation
of any length is cut into blocks of places. Two prefixes count as equal if their 192 bits of
sums are; random ones never meet in practice. Subtree sums need no walk either: a conversation owns the nodes
whose smallest member it is, which are the lower end of its path, and adds suffix sums
over what it owns to the nodes above.

Digests of the members that end at a node come from pieces of at most 4,096 ids each, streamed
through one SHA-256 in order.

Defined cases: a null turn comes first, null roles and texts are empty; turns of equal number follow
the order of their digests, repeated rows are repeated turns. Rows without a conv_id take no part. A
conversation whose turns all fall away ends at the root. An empty table has no node, not even a root.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from contrail.llm.text import sha256_hex
from contrail.session import written

FAMILY = 20  # conversations that share an opening
LANES = 6
BLOCK_BITS = 10
CHUNK_BITS = 12
SKETCH_ROWS = 3
LEAST_CELLS, MOST_CELLS = 1 << 16, 1 << 26
WORDS = "[^\\x20\\x09-\\x0D]+"
SUMS = [f"s{i}" for i in range(LANES)]


def running_sums(rows: DataFrame, key: str, block: str, order: str | list[str], names: list[str]) -> DataFrame:
    """Each named column as its sum over the key's rows up to this one.

    Sums of whole blocks are carried over, and rows are ordered inside their blocks only.
    """
    totals = rows.groupBy(key, block).agg(*[F.sum(name).alias(name) for name in names])
    earlier = W.partitionBy(key).orderBy(block).rowsBetween(W.unboundedPreceding, -1)
    carried = totals.select(
        key, block, *[F.coalesce(F.sum(name).over(earlier), F.lit(0)).alias(f"_{name}") for name in names]
    )
    inside = W.partitionBy(key, block).orderBy(order).rowsBetween(W.unboundedPreceding, W.currentRow)
    sums = {name: F.sum(name).over(inside) + F.col(f"_{name}") for name in names}
    return rows.join(carried, [key, block]).withColumns(sums).drop(*[f"_{name}" for name in names])


def turns(conversations: DataFrame, conv_id: str, turn: str, role: str, text: str) -> DataFrame:
    """(conv_id, turn, digest, words, block): what the trie needs of a turn."""
    held = conversations.select(
        F.col(conv_id).cast("long").alias("conv_id"),
        F.col(turn).cast("long").alias("turn"),
        F.coalesce(F.col(role), F.lit("")).alias("role"),
        F.coalesce(F.col(text), F.lit("")).alias("text"),
    ).filter("conv_id IS NOT NULL")
    content = F.concat(F.octet_length("role").cast("string"), F.lit(":"), "role", "text")
    first = F.lit(-(1 << 62))  # null turns, before all others
    return held.select(
        "conv_id",
        "turn",
        F.substring(F.unhex(sha256_hex(content)), 1, 16).alias("digest"),
        F.regexp_count("text", F.lit(WORDS)).cast("long").alias("words"),
        F.coalesce(F.shiftright("turn", BLOCK_BITS), first).alias("block"),
    )


def rebuilt(given: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(conv_id, place, digest, words, last) of all rebuilt turns, and (conv_id, turns) of all conversations."""
    order = [F.asc_nulls_first("turn"), F.asc("digest")]
    placed = running_sums(given.withColumn("place", F.lit(1).cast("long")), "conv_id", "block", order, ["place"])
    placed = written(placed.select("conv_id", F.col("place") - 1, "digest", "words").toDF("conv_id", "place", "digest", "words"), "prefix-places")
    kept = F.crc32(F.col("conv_id").cast("string").cast("binary")) % 4
    base = F.col("conv_id") - F.col("conv_id") % FAMILY
    opening = placed.filter((base == F.col("conv_id")) & (F.col("place") < 3)).groupBy("conv_id").agg(
        F.array_sort(F.collect_list(F.struct("place", "digest", "words"))).alias("opening")
    )
    none = F.array().cast("array<struct<place: bigint, digest: binary, words: bigint>>")
    counted = given.groupBy("conv_id").agg(F.count(F.lit(1)).alias("n"))
    told = counted.withColumns({"base": base, "h": kept}).join(
        opening.withColumnRenamed("conv_id", "base"), "base", "left"
    )
    told = told.withColumn("opening", F.slice(F.coalesce("opening", none), F.lit(1), F.col("h").cast("int")))
    told = told.withColumn("taken", F.size("opening").cast("long"))
    told = told.withColumn("turns", F.col("taken") + F.greatest(F.col("n") - F.col("h"), F.lit(0)))
    told = written(told.select("conv_id", "h", "opening", "taken", "turns"), "prefix-conversations")
    inherited = told.select("conv_id", "turns", F.inline("opening"))
    own = placed.join(told.select("conv_id", "h", "taken", "turns"), "conv_id").filter("place >= h")
    own = own.select("conv_id", "turns", (F.col("place") - F.col("h") + F.col("taken")).alias("place"), "digest", "words")
    rows = inherited.unionByName(own)
    return rows.withColumn("last", F.col("place") + 1 == F.col("turns")).drop("turns"), told.select("conv_id", "turns")


def _node(depth: Column, sums: list[Column]) -> Column:
    """The digest of a prefix."""
    text = F.concat_ws(",", *[x.cast("string") for x in (depth, *sums)])
    return F.substring(F.unhex(sha256_hex(text)), 1, 16)


def prefix_rows(rows: DataFrame) -> DataFrame:
    """(conv_id, depth, node, parent, words, last) of every conversation's prefixes but the empty one."""
    parts = sha256_hex(F.concat(F.col("place").cast("string").cast("binary"), F.col("digest")))
    lanes = {
        name: F.conv(F.substring(parts, 8 * i + 1, 8), 16, 10).cast("long") for i, name in enumerate(SUMS)
    }
    own = [f"own_{name}" for name in SUMS]
    rows = rows.withColumns(lanes).withColumn("block", F.shiftright("place", BLOCK_BITS)).drop("digest")
    rows = written(rows.withColumns({o: F.col(s) for o, s in zip(own, SUMS)}), "prefix-turns")
    summed = running_sums(rows, "conv_id", "block", "place", SUMS)
    depth = F.col("place") + 1
    return summed.select(
        "conv_id",
        depth.alias("depth"),
        _node(depth, [F.col(s) for s in SUMS]).alias("node"),
        _node(F.col("place"), [F.col(s) - F.col(o) for s, o in zip(SUMS, own)]).alias("parent"),
        "words",
        "last",
    )


def root() -> Column:
    return _node(F.lit(0), [F.lit(0)] * LANES)


def cells(node: str, width: int) -> list[Column]:
    """The node's cell in every row of the sketch, numbered through."""
    return [F.pmod(F.xxhash64(F.lit(i), node), F.lit(width)) + F.lit(i * width) for i in range(SKETCH_ROWS)]


def width_for(prefixes: int, most: int = MOST_CELLS) -> int:
    """Cells of a sketch row: four a prefix, a power of two between the two limits."""
    return min(most, max(LEAST_CELLS, 1 << max(0, 4 * prefixes - 1).bit_length()))


def sketch(prefixes: DataFrame, width: int) -> bytes:
    """A bit per cell that counts more than one; at most ``SKETCH_ROWS * MOST_CELLS`` bits, 25 MB."""
    counted = prefixes.select(F.explode(F.array(*cells("node", width))).alias("cell")).groupBy("cell").agg(
        F.count(F.lit(1)).alias("n")
    )
    page = F.bitmap_bucket_number(F.col("cell") + 1)
    bits = counted.filter("n > 1").groupBy(page.alias("page")).agg(
        F.bitmap_construct_agg(F.bitmap_bit_position(F.col("cell") + 1)).alias("bits")
    )
    pages = bits.toArrow()
    whole = bytearray(SKETCH_ROWS * width // 8)
    for page, held in zip(pages.column("page").to_pylist(), pages.column("bits").to_pylist()):
        whole[(page - 1) * 4096 : page * 4096] = held
    return bytes(whole)


def maybe_shared(node: str, width: int, crowded: Broadcast) -> Column:
    """False where the sketch proves that one conversation alone holds the prefix."""

    @F.arrow_udf("boolean")
    def run(*columns: pa.Array) -> pa.Array:
        bits = np.frombuffer(crowded.value, np.uint8)
        shared = np.ones(len(columns[0]), bool)
        for column in columns:
            cell = column.to_numpy(zero_copy_only=False)
            shared &= (bits[cell >> 3] >> (cell & 7) & 1).astype(bool)
        return pa.array(shared)

    return run(*cells(node, width))


def _ends(enders: DataFrame) -> DataFrame:
    """(node, ends_sha256) of (node, conv_id); ids meet in pieces, and a node's pieces are streamed."""
    chunk = F.shiftright("conv_id", CHUNK_BITS)
    ids = F.transform(F.array_sort(F.collect_list("conv_id")), lambda x: x.cast("string"))
    pieces = enders.groupBy("node", chunk.alias("chunk")).agg(F.array_join(ids, ",").alias("ids"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node, state = None, hashlib.sha256()
        for batch in batches:
            nodes, digests = [], []
            for at, ids in zip(batch.column("node").to_pylist(), batch.column("ids").to_pylist()):
                if at == node:
                    state.update(b",")
                else:
                    if node is not None:
                        nodes.append(node)
                        digests.append(state.hexdigest())
                    node, state = at, hashlib.sha256()
                state.update(ids.encode())
            yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.binary()), pa.array(digests, pa.string())], NAMES)
        if node is not None:
            last = [pa.array([node], pa.binary()), pa.array([state.hexdigest()])]
            yield pa.RecordBatch.from_arrays(last, NAMES)

    ordered = pieces.repartition("node").sortWithinPartitions("node", "chunk").select("node", "ids")
    return ordered.mapInArrow(run, "node binary, ends_sha256 string")


NAMES = ["node", "ends_sha256"]


def _subtrees(shared: DataFrame, stats: DataFrame, tails: DataFrame, every: DataFrame) -> DataFrame:
    """(node, n_leaves, saved_tokens) over the subtrees of the grouped nodes.

    A conversation adds, to each of its grouped prefixes, what it owns from there on downwards.
    """
    owned = shared.join(stats.select("node", "owner", "n_convs", "n_children"), "node")
    own = F.col("owner") == F.col("conv_id")
    owned = owned.select(
        "conv_id",
        "depth",
        "node",
        F.when(own, (F.col("n_convs") - 1) * F.col("words")).otherwise(0).alias("saved"),
        F.when(own & (F.col("n_children") == 0), 1).otherwise(0).cast("long").alias("leaves"),
    )
    zero = F.lit(0).cast("long")
    # the root is on every path and saves nothing itself; a leaf proven by the sketch counts below all grouped prefixes
    ends = tails.select("conv_id", "depth", F.lit(None).cast("binary").alias("node"), zero.alias("saved"), (zero + 1).alias("leaves"))
    tops = every.select("conv_id", zero.alias("depth"), root().alias("node"), zero.alias("saved"), zero.alias("leaves"))
    rows = owned.unionByName(ends).unionByName(tops).withColumn("up", -F.col("depth"))
    rows = written(rows.withColumn("block", F.shiftright("up", BLOCK_BITS)), "prefix-owned")
    summed = running_sums(rows, "conv_id", "block", "up", ["saved", "leaves"])
    adding = summed.filter("node IS NOT NULL AND (saved > 0 OR leaves > 0)")
    return adding.groupBy("node").agg(F.sum("leaves").alias("n_leaves"), F.sum("saved").alias("saved_tokens"))


def prefix_trie(
    conversations: DataFrame,
    conv_id: str = "conv_id",
    turn: str = "turn",
    role: str = "role",
    text: str = "text",
    most_cells: int = MOST_CELLS,
) -> DataFrame:
    """One row per node: its smallest member, depth, parent, members, children, leaves, saved words and digest of ends."""
    spark = conversations.sparkSession
    given = written(turns(conversations, conv_id, turn, role, text), "prefix-given")
    rows, every = rebuilt(given)
    prefixes = written(prefix_rows(rows), "prefix-nodes")
    width = width_for(prefixes.count(), most_cells)
    crowded = spark.sparkContext.broadcast(sketch(prefixes, width))
    marked = prefixes.select(
        "*",
        maybe_shared("node", width, crowded).alias("shared"),
        (F.col("depth") == 1).alias("top"),
        maybe_shared("parent", width, crowded).alias("parent_crowded"),
    )
    marked = marked.withColumn("parent_shared", F.col("top") | F.col("parent_crowded")).drop("top", "parent_crowded")
    marked = written(marked, "prefix-marked")
    shared, lone = marked.filter("shared"), marked.filter("NOT shared")

    zero = F.lit(0).cast("long")
    groups = shared.groupBy("node").agg(
        F.count(F.lit(1)).alias("n_convs"),
        F.min("conv_id").alias("owner"),
        F.max("depth").alias("depth"),
        F.max("parent").alias("parent"),
        F.max("parent_shared").alias("parent_shared"),
    )
    top = every.agg(F.count(F.lit(1)).alias("n_convs"), F.min("conv_id").alias("owner")).filter("n_convs > 0").select(
        root().alias("node"),
        "n_convs",
        "owner",
        zero.alias("depth"),
        F.lit(None).cast("binary").alias("parent"),
        F.lit(False).alias("parent_shared"),
    )
    groups = written(groups.unionByName(top), "prefix-groups")
    children = groups.select("parent").unionByName(lone.filter("parent_shared").select("parent"))
    children = children.filter("parent IS NOT NULL").groupBy("parent").agg(F.count(F.lit(1)).alias("n_children"))
    stats = groups.join(children.withColumnRenamed("parent", "node"), "node", "left")
    stats = written(stats.withColumn("n_children", F.coalesce("n_children", zero)), "prefix-stats")

    enders = shared.filter("last").select("node", "conv_id")
    enders = enders.unionByName(every.filter("turns = 0").select(root().alias("node"), "conv_id"))
    below = _subtrees(shared, stats, lone.filter("last").select("conv_id", "depth"), every)
    nobody = F.sha2(F.lit(""), 256)
    owners = stats.select(F.col("node").alias("parent"), F.col("owner").alias("above"))
    grouped = (
        stats.join(owners, "parent", "left")
        .join(below, "node", "left")
        .join(_ends(enders), "node", "left")
        .select(
            F.col("owner").alias("conv_id"),
            "depth",
            # a parent that one conversation alone holds is this node's only member
            F.when(F.col("depth") == 0, F.lit(None)).when(F.col("parent_shared"), F.col("above")).otherwise(F.col("owner"))
            .alias("parent_conv_id"),
            "n_convs",
            "n_children",
            F.when(F.col("n_children") == 0, 1).otherwise(F.coalesce("n_leaves", zero)).cast("long").alias("n_leaves"),
            F.coalesce("saved_tokens", zero).alias("saved_tokens"),
            F.coalesce("ends_sha256", nobody).alias("ends_sha256"),
        )
    )
    one = F.lit(1).cast("long")
    alone = lambda frame, above: frame.select(
        "conv_id",
        "depth",
        above.alias("parent_conv_id"),
        one.alias("n_convs"),
        F.when(F.col("last"), 0).otherwise(1).cast("long").alias("n_children"),
        one.alias("n_leaves"),
        zero.alias("saved_tokens"),
        F.when(F.col("last"), sha256_hex(F.col("conv_id").cast("string"))).otherwise(nobody).alias("ends_sha256"),
    )
    first = alone(lone.filter("parent_shared").join(owners, "parent"), F.col("above"))
    return grouped.unionByName(first).unionByName(alone(lone.filter("NOT parent_shared"), F.col("conv_id")))
