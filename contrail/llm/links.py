"""Connected components of a link table, as repeated joins."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from contrail.session import written


def _star(links: DataFrame, large: bool) -> DataFrame:
    """Hang each node's neighbours below the smallest of them (large: the larger ones only)."""
    if large:
        ways = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    else:
        ways = links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = ways.groupBy("a").agg(F.least("a", F.min("b")).alias("m"))
    hung = ways.join(least, "a")
    if large:
        moved = hung.filter("b > a").select(F.col("m").alias("a"), "b")
    else:
        moved = hung.select(F.col("m").alias("a"), "b").unionByName(least.select(F.col("m").alias("a"), F.col("a").alias("b")))
    return moved.filter("a <> b").distinct()


def connected(links: DataFrame) -> DataFrame:
    """(node, root): the smallest node that links (a, b) connect with it; nodes without links are absent.

    Alternating stars: every round roughly squares the reach, and each round is written
    to the shared folder, so neither plan nor lineage grows.
    """
    links = written(links.select("a", "b").filter("a <> b").distinct(), "links")
    before = None
    while True:
        links = written(_star(_star(links, True), False), "links")
        now = links.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    # every link now runs from a root to a node
    return links.select(F.col("b").alias("node"), F.col("a").alias("root")).unionByName(
        links.select(F.col("a").alias("node"), F.col("a").alias("root")).distinct()
    )
