"""From raw documents to packed training sequences: each stage is written as Parquet and read again by the next.

Each stage works on all that its predecessor kept and returns the columns of documents, but for the last, which returns
the packed pieces with their token ids.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemill.llm import langid, mixing, packing, pii, simjoin
from tidemill.llm.common import stored, table

#: Words of a block of the mix: longer than the operator's own, so that parts stay long.
MIX_BLOCK = 512


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is known stay: not ``und``, and the best language has at least half of the probability."""
    return langid.identified(docs, langid.train(docs))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of near copies the document with the smallest doc_id stays. Rows that share both
    doc_id and text are copies; rows that share only one of them are compared like others. One without a doc_id stays only
    where no row of its class has one."""
    id_, row = F.col("doc_id").cast("long"), F.struct(*(F.col(f"`{c}`") for c in docs.columns))
    key = F.xxhash64(id_.isNull(), id_, F.col("text").isNull(), "text")
    classes = simjoin.classes(docs.select(key.alias("doc_id"), "text")).select(F.col("doc_id").alias("key"), "class_id").distinct()
    ids = docs.select(key.alias("key"), id_.alias("id")).distinct()
    first = classes.join(ids, "key").groupBy("class_id").agg(F.min(F.struct(F.col("id").isNull(), "id", "key")).alias("first")).select("first.key")
    # Documents whose 64-bit keys happen to be equal are told apart by their ids and the digests of their texts.
    rows = docs.select(key.alias("key"), id_.alias("id"), F.sha2(F.col("text").cast("binary"), 256).alias("digest"), row.alias("row")).join(first, "key", "left_semi")
    return rows.groupBy("key", "id", "digest").agg(F.first("row").alias("row")).select("row.*")


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document stays; personal data in its text gives way to the kind in brackets."""
    return pii.redacted(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix at the sources' target weights: one row for each part of a document that it takes."""
    return mixing.mixed(docs, block_words=MIX_BLOCK)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of 4096 tokens, a row for each piece."""
    return packing.pack(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language", language),
    ("near_duplicates", near_duplicates),
    ("personal_data", personal_data),
    ("mix", mix),
    ("pack", pack),
]

#: Language models, chosen paths and permutations have no SQL; tests compare the stages with brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = stored(docs, f"stage-{name}")
    return docs.withColumn("ids", F.hex("ids"))
