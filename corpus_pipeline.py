"""A training corpus from raw documents: five stages, each written as Parquet and read again.

Every stage is a function of (session, documents, folder of tables) and works on all
that the stage before it kept. All but the last return the columns of the documents.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from contrail.llm import bpe, decontaminate, pii, simhash, toxicity
from contrail.llm.text import bound_batches, free_name
from contrail.session import written


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model, learned from the labels that are not held out, does not reject."""
    bound_batches(spark)
    model = toxicity.train(docs, _table(spark, sf_dir, "labels"))
    name = free_name(docs, "toxicity")
    scored = docs.select(*docs.columns, toxicity.score(F.col("text"), model).getField("score").alias(name))
    return scored.filter(F.col(name) < toxicity.THRESHOLD).select(*docs.columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near copies, the one with the smallest id."""
    bound_batches(spark)
    return simhash.representatives(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which test items cover less than a twentieth; they stay as they are."""
    bound_batches(spark)
    name = free_name(docs, "hits")
    hits = decontaminate.with_hits(docs, _table(spark, sf_dir, "benchmark"), column=name)
    return hits.filter(~F.col(name).getField("contaminated")).select(*docs.columns)


def mask_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with marks in place of personal data; ``n_chars`` follows the text."""
    bound_batches(spark)
    new = free_name(docs, "masked")
    masked = docs.select(*docs.columns, pii.redacted(F.col("text")).alias(new))
    changed = F.col("text") != F.col(new)
    columns = {
        "text": F.col(new),
        "n_chars": F.when(changed, F.char_length(new).cast("long")).otherwise(F.col("n_chars")),
    }
    return masked.select(*[columns.get(name, F.col(name)).alias(name) for name in docs.columns])


def tokenise(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents as packed token ids, with the digest of the bytes they decode to."""
    bound_batches(spark)
    ranks = bpe.load(spark, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
    coded = bpe.encode_documents(docs, ranks)
    return coded.select(
        "doc_id",
        "lang",
        "source",
        "n_chars",
        (F.octet_length("token_ids") / 4).cast("long").alias("n_tokens"),
        "token_ids",
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", drop_toxic),
    ("near_dedup", drop_near_copies),
    ("decontamination", drop_contaminated),
    ("pii", mask_personal_data),
    ("bpe", tokenise),
]

# the first stage learns a model, which SQL cannot express; tests hold each stage against brute force
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of a folder."""
    docs = _table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
