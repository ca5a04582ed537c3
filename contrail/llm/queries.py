"""Registered queries of the text operators and their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from contrail.llm import alignment, bpe, decontaminate, dedup, extract, licenses, pii, prefixes, quality, simhash
from contrail.llm import topk, toxicity, vectors
from contrail.llm.text import bound_batches, sha256_hex

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def register(query):
    QUERIES[query.__name__] = query
    return query


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    bound_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@register
def op1_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document encoded and decoded again, as digests."""
    ranks = bpe.load(spark, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    coded = bpe.encode_documents(docs, ranks)
    return coded.select(
        "doc_id",
        (F.octet_length("token_ids") / 4).cast("long").alias("n_tokens"),
        sha256_hex(F.col("token_ids")).alias("ids_sha256"),
        sha256_hex(F.col("decoded")).alias("decoded_sha256"),
    )


@register
def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's fingerprint and class."""
    classes = simhash.simhash_classes(table(spark, sf_dir, "documents"))
    return classes.select(
        "doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id"
    )


@register
def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's words that stand in a window of a test item."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    hits = decontaminate.with_hits(docs, table(spark, sf_dir, "benchmark"))
    return hits.select(
        "doc_id",
        "hits.n_words",
        "hits.n_hit",
        F.size("hits.items").cast("long").alias("n_items"),
        sha256_hex(F.array_join(F.array_sort("hits.items"), ",")).alias("items_sha256"),
        "hits.contaminated",
    )


# words as the contracts take them: only A-Z change case
_SQL_WORDS = (
    "regexp_extract_all(translate(coalesce({0}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), "
    "'[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"
)

ORACLES["op7_decontamination"] = f"""
WITH items AS (
    SELECT item_id, {_SQL_WORDS.format("text")} AS w FROM benchmark
), windows AS (
    SELECT DISTINCT item_id, least(13, len(w)) AS size, array_to_string(w[i : i + least(13, len(w)) - 1], ' ') AS gram
    FROM items, LATERAL (SELECT unnest(range(1, len(w) - least(13, len(w)) + 2)) AS i) WHERE len(w) > 0
), docs AS (
    SELECT doc_id, {_SQL_WORDS.format("text")} AS w FROM documents
), sizes AS (SELECT DISTINCT size FROM windows
), grams AS (
    SELECT doc_id, i, size, array_to_string(w[i : i + size - 1], ' ') AS gram
    FROM docs, sizes, LATERAL (SELECT unnest(range(1, len(w) - size + 2)) AS i) WHERE len(w) >= size
), hits AS (
    SELECT g.doc_id, g.i, g.size, s.item_id FROM grams g JOIN windows s ON g.size = s.size AND g.gram = s.gram
), hit_words AS (
    SELECT doc_id, count(DISTINCT i + k) AS n_hit
    FROM (SELECT DISTINCT doc_id, i, size FROM hits), LATERAL (SELECT unnest(range(0, size)) AS k) GROUP BY doc_id
), hit_items AS (
    SELECT doc_id, count(*) AS n_items, sha256(string_agg(item, ',' ORDER BY item)) AS items_sha256
    FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM hits) GROUP BY doc_id
)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
       CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, coalesce(items_sha256, sha256('')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM docs d LEFT JOIN hit_words USING (doc_id) LEFT JOIN hit_items USING (doc_id)
"""


@register
def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's personal data, plain (counts, base digest) and disguised as well (spans)."""
    found = pii.find_documents(table(spark, sf_dir, "documents"))
    return found.select(
        "doc_id", "n_email", "n_ip", "n_card", "n_phone", sha256_hex(F.col("base")).alias("base_sha256"), "spans"
    )


@register
def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's toxicity, with the sentences that give offence."""
    return toxicity.score_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@register
def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's quality."""
    return quality.score_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@register
def op5_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five best candidates of every fiftieth vector."""
    vectors = table(spark, sf_dir, "embeddings")
    return topk.top_k(vectors, vectors.filter(F.col("vec_id") % 50 == 0))


ORACLES["op5_topk"] = """
WITH v AS (
    SELECT vec_id, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS e FROM embeddings
    WHERE embedding IS NOT NULL AND vec_id IS NOT NULL
      AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
    SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.e, c.e) AS BIGINT) AS score
    FROM v q JOIN v c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id
)
SELECT query_id, CAST(row_number() OVER best AS INTEGER) AS rank, vec_id, score FROM scored
WINDOW best AS (PARTITION BY query_id ORDER BY score DESC, vec_id)
QUALIFY row_number() OVER best <= 5
"""


@register
def op3_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's licence phrases and the labels its blocks meet."""
    found = licenses.scan_documents(table(spark, sf_dir, "documents"))
    return found.select(
        "doc_id",
        "n_words",
        "n_base",
        "first_word",
        "last_word",
        F.array_join("base_labels", ",").alias("base_labels"),
        F.array_join("labels", ",").alias("labels"),
        "score",
    )


@register
def op9_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page's main text."""
    return extract.extract(table(spark, sf_dir, "pages"))


@register
def op6_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without its repeated strings of 100 bytes, as digests."""
    left = dedup.remove_repeats(table(spark, sf_dir, "documents"))
    return left.select(
        "doc_id",
        "n_bytes",
        (F.col("n_bytes") - F.octet_length("kept")).cast("long").alias("n_removed"),
        F.size("starts").cast("long").alias("n_spans"),
        sha256_hex(F.col("kept")).alias("kept_sha256"),
    )


ORACLES["op6_suffix_dedup"] = """
WITH d AS (
    SELECT doc_id, hex(encode(coalesce(text, ''))) AS h, octet_length(encode(coalesce(text, ''))) AS n FROM documents
), w AS (
    SELECT doc_id, i, substr(h, 2 * i + 1, 200) AS g FROM d, LATERAL (SELECT unnest(range(0, n - 99)) AS i) WHERE n >= 100
), later AS (
    SELECT doc_id, i FROM w QUALIFY row_number() OVER (PARTITION BY g ORDER BY doc_id, i) > 1
), marked AS (
    SELECT doc_id, i, CASE WHEN i <= lag(i) OVER (PARTITION BY doc_id ORDER BY i) + 100 THEN 0 ELSE 1 END AS fresh FROM later
), numbered AS (SELECT doc_id, i, sum(fresh) OVER (PARTITION BY doc_id ORDER BY i) AS run FROM marked
), runs AS (SELECT doc_id, min(i) AS a, max(i) + 100 AS b FROM numbered GROUP BY doc_id, run
), pieces AS (
    SELECT r.doc_id, a, b, substr(h, 2 * coalesce(lag(b) OVER (PARTITION BY r.doc_id ORDER BY a), 0) + 1,
           2 * (a - coalesce(lag(b) OVER (PARTITION BY r.doc_id ORDER BY a), 0))) AS piece
    FROM runs r JOIN d ON r.doc_id = d.doc_id
), kept AS (
    SELECT doc_id, sum(b - a) AS n_removed, count(*) AS n_spans, max(b) AS last, string_agg(piece, '' ORDER BY a) AS front
    FROM pieces GROUP BY doc_id
)
SELECT d.doc_id, CAST(n AS BIGINT) AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed,
       CAST(coalesce(n_spans, 0) AS BIGINT) AS n_spans,
       sha256(unhex(coalesce(front, '') || substr(h, 2 * coalesce(last, 0) + 1))) AS kept_sha256
FROM d LEFT JOIN kept ON d.doc_id = kept.doc_id
"""


@register
def op11_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every vector's near copies of the same label: how many, and the least id they connect it with."""
    return vectors.near_copies(table(spark, sf_dir, "embeddings"))


@register
def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every node of the trie of rebuilt conversations."""
    return prefixes.prefix_trie(table(spark, sf_dir, "conversations"))


ORACLES["op13_prefix_trie"] = r"""
WITH t AS (
    SELECT conv_id, turn, coalesce(text, '') AS x,
           left(sha256(octet_length(encode(coalesce(role, '')))::VARCHAR || ':' || coalesce(role, '') || coalesce(text, '')), 32) AS dig
    FROM conversations WHERE conv_id IS NOT NULL
), d AS (
    SELECT conv_id, dig, len(regexp_extract_all(x, '[^\x20\x09-\x0D]+')) AS words,
           row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, dig) - 1 AS pos FROM t
), c AS (
    SELECT conv_id, conv_id - conv_id % 20 AS base, xor(4294967295, list_reduce(
               list_concat([4294967295], list_transform(string_split(conv_id::VARCHAR, ''), lambda z: ascii(z)::BIGINT)),
               lambda a, b: list_reduce(list_concat([xor(a, b)], [0, 0, 0, 0, 0, 0, 0, 0]),
                                        lambda v, z: xor(v >> 1, 3988292384 * (v & 1))))) % 4 AS h
    FROM (SELECT DISTINCT conv_id FROM t)
), sizes AS (SELECT conv_id AS base, count(*) AS n FROM d GROUP BY 1
), rebuilt AS (
    SELECT c.conv_id, d.pos AS place, dig, words FROM c JOIN d ON d.conv_id = c.base AND d.pos < c.h
    UNION ALL
    SELECT c.conv_id, d.pos - c.h + least(c.h, coalesce(n, 0)), dig, words
    FROM c JOIN d ON d.conv_id = c.conv_id AND d.pos >= c.h LEFT JOIN sizes USING (base)
), paths AS (
    SELECT conv_id, place + 1 AS depth, string_agg(dig, '') OVER (PARTITION BY conv_id ORDER BY place) AS path, words FROM rebuilt
    UNION ALL SELECT conv_id, 0, '', 0 FROM c
), ends AS (SELECT conv_id, max(depth) AS size FROM paths GROUP BY 1
), nodes AS (
    SELECT path, depth, min(conv_id) AS conv_id, count(*) AS n_convs, min(words) AS words,
           string_agg(CASE WHEN depth = size THEN conv_id::VARCHAR END, ',' ORDER BY conv_id) AS enders
    FROM paths JOIN ends USING (conv_id) GROUP BY path, depth
), kids AS (SELECT left(path, len(path) - 32) AS path, count(*) AS n FROM nodes WHERE depth > 0 GROUP BY 1
), below AS (
    SELECT p.path, sum(CASE WHEN k.n IS NULL THEN 1 ELSE 0 END) AS n_leaves, sum((u.n_convs - 1) * u.words) AS saved
    FROM nodes u LEFT JOIN kids k ON k.path = u.path JOIN paths p ON p.conv_id = u.conv_id AND p.depth <= u.depth GROUP BY p.path
)
SELECT v.conv_id, CAST(v.depth AS BIGINT) AS depth, CASE WHEN v.depth > 0 THEN up.conv_id END AS parent_conv_id,
       CAST(v.n_convs AS BIGINT) AS n_convs, CAST(coalesce(k.n, 0) AS BIGINT) AS n_children,
       CAST(b.n_leaves AS BIGINT) AS n_leaves, CAST(b.saved AS BIGINT) AS saved_tokens,
       sha256(coalesce(v.enders, '')) AS ends_sha256
FROM nodes v JOIN below b ON b.path = v.path LEFT JOIN kids k ON k.path = v.path
LEFT JOIN nodes up ON v.depth > 0 AND up.path = left(v.path, len(v.path) - 32)
"""


@register
def op12_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's tokens by two tokenizers, laid beside each other and counted over all documents."""
    path = public_tokenizers.path
    files = alignment.load(spark, path("byte_bpe_50k.json"), path("piece_bpe_32k.model"), public_tokenizers.PATTERN)
    return alignment.align(table(spark, sf_dir, "documents"), files)
