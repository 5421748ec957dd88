"""Fusion of edge candidates from several sources into one edge each, with a confidence."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Relation types whose direction doesn't matter.
SYMMETRIC = ("interacts_with", "binds_to", "cooccurs_with", "associated_with")


def canonical_key(source: str = "source", target: str = "target", kind: str = "relation_type") -> tuple[Column, Column]:
    """Endpoints upper-cased, and in order where the relation type has no direction."""
    a, b = F.upper(F.trim(source)), F.upper(F.trim(target))
    same = F.col(kind).isin(*SYMMETRIC)
    return F.when(same, F.least(a, b)).otherwise(a).alias("key_a"), F.when(same, F.greatest(a, b)).otherwise(b).alias("key_b")


def base_confidence(source: str = "data_source", score: str = "base") -> Column:
    """Confidence of one candidate by its source."""
    x = F.col(score)
    strong = 0.5 * (0.5 + 0.5 * F.least(x / 5.0, F.lit(1.0)))
    return F.when(F.col(source) == "STRING", F.coalesce(0.9 * F.least(x, F.lit(1.0)), F.lit(0.63))).when(F.col(source) == "llm", F.lit(0.7)).when(F.col(source) == "cooccurrence", F.when(x > 2.0, strong).otherwise(0.25)).otherwise(0.0)


def fuse(candidates: DataFrame) -> DataFrame:
    """One row per canonical edge of candidates (source, target, relation_type, data_source, base,
    evidence_id, seq): orientation of the first candidate, distinct sorted evidence ids, sources,
    best score, and confidence. One partial aggregation; no group is brought together unreduced."""
    keyed = candidates.withColumns(dict(zip(("key_a", "key_b"), canonical_key(), strict=True)))
    g = keyed.groupBy("key_a", "key_b", "relation_type").agg(
        F.min_by("source", "seq").alias("source"),
        F.min_by("target", "seq").alias("target"),
        F.sort_array(F.collect_set("evidence_id")).alias("evidence_ids"),
        F.sort_array(F.collect_set("data_source")).alias("sources"),
        F.max(base_confidence()).alias("best"),
    )
    extra = F.least(0.1 * F.greatest(F.size("evidence_ids") - 1, F.lit(0)), F.lit(0.2))
    confidence = F.least(F.lit(1.0), F.col("best") + 0.15 * (F.size("sources") - 1) + extra)
    return g.select("source", "target", "relation_type", "evidence_ids", "sources", (F.size("sources") > 1).alias("is_multi_source"), confidence.alias("confidence"))


def incremental(existing: DataFrame, arrived: DataFrame) -> DataFrame:
    """Candidates of both, for a new fusion; rows already there (all columns equal) come once."""
    return existing.unionByName(arrived).distinct()
