"""A corpus pipeline of five stages: toxicity, exact and near duplicates, decontamination, encoding.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last keep the columns
of documents. Every row is judged for itself, also where rows share a doc_id: stages that must find
rows again number them once and write them with their numbers. Null texts count as empty. No stage
moves texts by itself: rows leave by an anti-join with the written list of those that go, which the
planner broadcasts if its size allows.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ligature.llm import bpe, common, decontaminate, exact_dedup, near_copies, toxicity

def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 5: documents that it predicts toxic go."""
    return toxicity.untoxic(docs, toxicity.trained(docs, common.read(spark, sf_dir, "labels")))


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 1: of equal documents the one that it keeps stays."""
    base = common.numbered(docs)
    return common.without(base, exact_dedup.exact_groups(common.texts_of(base)).where("not kept"))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 8 at five words and a similarity of 0.8: one document of each group stays."""
    base = common.numbered(docs)
    return common.without(base, near_copies.near_groups_of(base).where("uid <> keep"))


def drop_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 4: documents that hold a window of a test item go."""
    base = common.numbered(docs)
    return common.without(base, decontaminate.matches(base, common.read(spark, sf_dir, "benchmark")).where(F.size("items") > 0))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids, ids_sha256, decoded_sha256."""
    return bpe.bpe_encode(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", drop_toxic),
    ("exact_dedup", drop_copies),
    ("simhash_near_dedup", drop_near_copies),
    ("decontamination", drop_benchmark),
    ("bpe_encoding", encode),
]

#: The trained first stage, shingles and tokens aren't expressible in SQL; see tests/llm.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written as Parquet and read again by the next."""
    docs = common.read(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            path = f"{common.shared_folder(spark)}/stage-{i}-{uuid.uuid4().hex}"
            docs.write.parquet(path)
            docs = spark.read.parquet(path)
    return docs
