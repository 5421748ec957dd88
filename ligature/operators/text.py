"""Sentences, chunks and provenance checks over article text."""

from __future__ import annotations

import difflib
from collections import Counter
from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LEAST_CHARS, CHUNK_TOKENS = 10, 5000


def sentences(text: str = "abstract") -> Column:
    """Sentences of over LEAST_CHARS characters; an end mark counts before white space or the end."""
    parts = F.split(F.coalesce(F.col(text), F.lit("")), r"(?<=[.?!])(?=[ \n\t]|$)")
    return F.filter(F.transform(parts, lambda x: F.regexp_replace(x, r"^[ \n\t\r]+|[ \n\t\r]+$", "")), lambda x: F.char_length(x) > LEAST_CHARS)


def numbered(found: Column) -> Column:
    return F.array_join(F.transform(found, lambda x, i: F.concat(F.lit("["), (i + 1).cast("string"), F.lit("] "), x)), "\n")


def tokens(text: str = "abstract") -> Column:
    return F.floor(F.char_length(F.coalesce(F.col(text), F.lit(""))) / 4).cast("long")


def greedy_chunks(articles: DataFrame, group: str, order: str, limit: int = CHUNK_TOKENS) -> DataFrame:
    """(group, order, chunk): articles packed in order into chunks of at most ``limit`` tokens.

    The fold carries state from row to row, so each group is one task; groups are streams of
    articles (a source, a day), of which there are many, and rows hold sizes only."""
    schema = f"{group} string, {order} long, chunk long"

    def pack(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(order)
        chunk, held, out = 0, 0, []
        for n in pdf["tokens"]:
            if held and held + n > limit:
                chunk, held = chunk + 1, 0
            held += n
            out.append(chunk)
        return pd.DataFrame({group: pdf[group], order: pdf[order], "chunk": out})

    return articles.select(group, order, tokens().alias("tokens")).groupBy(group).applyInPandas(pack, schema)


def provenance(claims: DataFrame, articles: DataFrame) -> DataFrame:
    """Claims (claim, pmid, indices) with pmid_valid, evidence_valid, similarity, and the evidence
    text: the cited sentences, counted from 1, that exist."""
    counted = articles.select("pmid", sentences().alias("found"))
    joined = claims.join(counted, "pmid", "left")
    known = F.coalesce(F.filter("indices", lambda i: (i >= 1) & (i <= F.coalesce(F.size("found"), F.lit(0)))), F.array().cast("array<int>"))
    size = F.size("indices")
    return joined.select(
        "claim", "pmid", F.col("found").isNotNull().alias("pmid_valid"),
        ((size > 0) & (F.size(known) == size)).alias("evidence_valid"),
        F.when(size > 0, F.size(known) / size).otherwise(0.0).alias("similarity"),
        F.array_join(F.transform(known, lambda i: F.get("found", i - 1)), " ").alias("evidence"),
    )


def best_ratio(evidence: str | None, found: Iterable[str] | None) -> float:
    """The highest sequence-matching ratio over all sentences, 1 if one holds the evidence, 0 if there
    is nothing to compare. Sentences whose upper bounds don't exceed the best are passed over."""
    wanted, best = (evidence or "").lower().strip(), 0.0
    lowered = [s.lower() for s in found if s] if wanted and found is not None else []
    if any(wanted in s for s in lowered):
        return 1.0
    held = Counter(wanted)
    for s in lowered:
        size = len(wanted) + len(s)
        if 2.0 * min(len(wanted), len(s)) / size > best and 2.0 * (held & Counter(s)).total() / size > best:
            best = max(best, difflib.SequenceMatcher(None, wanted, s).ratio())
    return best


def fuzzy_evidence(claims: DataFrame, least: float = 0.7) -> DataFrame:
    """Claims (claim, evidence, found) with the best sequence-matching ratio over the sentences."""

    def match(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            best = [best_ratio(e, found) for e, found in zip(pdf["evidence"], pdf["found"], strict=True)]
            yield pd.DataFrame({"claim": pdf["claim"], "similarity": best, "valid": [b >= least for b in best]})

    return claims.mapInPandas(match, "claim long, similarity double, valid boolean")
