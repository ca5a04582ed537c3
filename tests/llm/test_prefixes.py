import hashlib
import random
import re
import zlib

import duckdb
import pytest
from pyspark.sql import functions as F

from contrail.llm import prefixes, queries

KIND = "conv_id long, turn long, role string, text string"


def brute(rows):
    """All nodes from whole sequences in dictionaries."""
    own: dict = {}
    for conv, turn, role, text in rows:
        if conv is not None:
            role, text = role or "", text or ""
            digest = hashlib.sha256(f"{len(role.encode())}:{role}{text}".encode()).digest()[:16]
            own.setdefault(conv, []).append((turn is not None, turn or 0, digest, role, text))
    plain = {c: [t[3:] for t in sorted(turns)] for c, turns in own.items()}
    built = {}
    for c, turns in plain.items():
        h = zlib.crc32(str(c).encode()) % 4
        built[c] = tuple(plain.get(c - c % 20, [])[:h] + turns[h:])
    nodes: dict = {}
    for c, turns in built.items():
        for d in range(len(turns) + 1):
            nodes.setdefault(turns[:d], []).append(c)
    children: dict = {}
    for node in nodes:
        if node:
            children.setdefault(node[:-1], []).append(node)

    def below(node):
        inner = [below(child) for child in children.get(node, [])]
        words = len(re.findall(r"[^\x20\x09-\x0D]+", node[-1][1])) if node else 0
        return sum(x[0] for x in inner) or 1, sum(x[1] for x in inner) + (len(nodes[node]) - 1) * words

    out = []
    for node, members in nodes.items():
        ends = ",".join(str(c) for c in sorted(members) if len(built[c]) == len(node))
        parent = min(nodes[node[:-1]]) if node else None
        digest = hashlib.sha256(ends.encode()).hexdigest()
        out.append((min(members), len(node), parent, len(members), len(children.get(node, [])), *below(node), digest))
    return sorted(out, key=str)


def ran(frame, **options):
    return sorted(map(tuple, prefixes.prefix_trie(frame, **options).collect()), key=str)


def talk(seed, convs=120, most=6, start=0):
    """Conversations that draw their turns from few texts, so prefixes are shared at all depths."""
    rng = random.Random(seed)
    rows = []
    for c in range(start, start + convs):
        for t in range(rng.randrange(1, most)):
            text = rng.choice(["a b", "c", "", "  d\te \n", "very long " * 5])
            rows.append((c, t, rng.choice(["user", "assistant"]), text))
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("cells", [prefixes.MOST_CELLS, 1 << 15])
def test_trie_equals_brute_force(spark, cells):
    rows = talk(1) + talk(2, 40, 3, 1000) + [(7000 + i, 0, "user", f"only {i}") for i in range(30)]
    frame = spark.createDataFrame(rows, KIND).repartition(5)
    assert ran(frame, most_cells=cells) == brute(rows)


def test_a_sketch_that_screens_nothing_changes_nothing(spark, monkeypatch):
    monkeypatch.setattr(prefixes, "LEAST_CELLS", 1 << 15)
    monkeypatch.setattr(prefixes, "width_for", lambda n, most: 1 << 15)
    rows = talk(3, 60)
    monkeypatch.setattr(prefixes, "cells", lambda node, width: [F.lit(i * width).cast("long") for i in range(3)])
    assert ran(spark.createDataFrame(rows, KIND)) == brute(rows)


def test_long_conversations_and_many_copies(spark, monkeypatch):
    monkeypatch.setattr(prefixes, "BLOCK_BITS", 3)
    monkeypatch.setattr(prefixes, "CHUNK_BITS", 2)
    rows = [(40, t, "user", f"turn {t}") for t in range(300)] + [(60, t, "user", f"turn {t}") for t in range(300)]
    rows += [(c, t, "user", f"copy {t}") for c in range(100, 160) for t in range(4)]
    assert ran(spark.createDataFrame(rows, KIND)) == brute(rows)


def test_odd_rows(spark):
    rows = [
        (20, None, None, None), (20, 0, "user", "x"), (20, 0, "user", "x"), (20, 0, "user", "a"), (21, 3, None, "y"),
        (None, 0, "user", "lost"), (23, None, "user", ""), (22, 5, "u", "ab"), (22, 5, "ua", "b"), (-40, 0, "user", "minus"),
        (-41, 0, "user", "minus"), (5, 1, "user", "first of all"), (5, 0, "user", "late"), (6, 0, "user", "w " * 200_000),
    ]
    assert ran(spark.createDataFrame(rows, KIND)) == brute(rows)


def test_turnless_conversations_end_at_the_root(spark):
    """An opening that replaces all turns of a conversation whose base is absent."""
    c = next(c for c in range(21, 40) if zlib.crc32(str(c).encode()) % 4 == 1)
    rows = [(c, 0, "user", "gone")]
    got = ran(spark.createDataFrame(rows, KIND))
    assert got == brute(rows) == [(c, 0, None, 1, 0, 1, 0, hashlib.sha256(str(c).encode()).hexdigest())]


def test_empty_table_and_clashing_names(spark):
    assert ran(spark.createDataFrame([], KIND)) == []
    rows = talk(4, 30)
    frame = spark.createDataFrame(rows, KIND)
    for name in ("node", "depth", "block", "place", "digest", "words", "parent", "n_convs", "last"):
        frame = frame.withColumn(name, F.lit(7))
    assert ran(frame) == brute(rows)


def test_query_equals_its_sql_and_brute_force(spark):
    folder = "/root/testdata/sf0.001"
    got = sorted(map(tuple, queries.QUERIES["op13_prefix_trie"](spark, folder).collect()), key=str)
    names = queries.QUERIES["op13_prefix_trie"](spark, folder).columns
    con = duckdb.connect()
    con.sql(f"CREATE VIEW conversations AS SELECT * FROM '{folder}/conversations.parquet'")
    told = con.sql(queries.ORACLES["op13_prefix_trie"])
    assert told.columns == names
    rows = con.sql("SELECT conv_id, turn, role, text FROM conversations").fetchall()
    assert got == sorted(told.fetchall(), key=str) == brute(rows)


def test_screening_leaves_most_tails_alone(spark):
    rows = [(c, t, "user", f"{c} {t}") for c in range(200) for t in range(6)]
    nodes = prefixes.prefix_rows(prefixes.rebuilt(prefixes.turns(spark.createDataFrame(rows, KIND), *KIND.replace(",", "").split()[::2]))[0])
    width = prefixes.width_for(nodes.count())
    crowded = spark.sparkContext.broadcast(prefixes.sketch(nodes, width))
    shared = nodes.filter(prefixes.maybe_shared("node", width, crowded))
    exact = nodes.groupBy("node").count()
    several = exact.filter("count > 1").count()
    kept = shared.select("node").distinct()
    assert exact.filter("count > 1").join(kept, "node").count() == several
    assert kept.count() <= several + 0.05 * exact.count()
