"""Exact deduplication over content-defined chunk recipes.

Each text is normalised (ASCII white space deleted), cut where a rolling gear hash says so, and
replaced by its recipe: the ordered list of its chunks' identifiers. A chunk's identifier is its
XXH64, verified over the whole corpus against 128 bits of its SHA-256 and its length; identifiers
that stand for several contents get a variant number each, so that equal recipes mean equal texts.
Only recipes move: the texts are read once and never shuffled.

Null counts as the empty text, whose recipe is the empty list. Rows repeated with equal doc_id and
text count each; of rows equal in length and doc_id one stays. Null doc_ids sort first.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ligature.llm.common import read, sliced, splitmix, whole_text, written

GEAR = np.array(splitmix(256), dtype=np.uint64)
#: Chunk sizes in bytes: no cut before LEAST, one at MOST at the latest, one in 2**BITS places.
LEAST, MOST, BITS = 512, 8192, 11
_SPACES = bytes([32, 9, 10, 11, 12, 13])
_PASS = pa.schema([("uid", pa.int64()), ("doc_id", pa.int64()), ("n_chars", pa.int64()), ("n_bytes", pa.int64()), ("text_sha256", pa.string()), ("keys", pa.list_(pa.int64())), ("lengths", pa.list_(pa.int64())), ("check1", pa.list_(pa.int64())), ("check2", pa.list_(pa.int64()))])
_DDL = "uid long, doc_id long, n_chars long, n_bytes long, text_sha256 string, keys array<long>, lengths array<long>, check1 array<long>, check2 array<long>"


def cuts(data: bytes, least: int = LEAST, most: int = MOST, bits: int = BITS) -> list[int]:
    """Ends of the chunks of ``data``; they depend on the 32 bytes before each and on the last cut."""
    n, ends, start = len(data), [], 0
    if n > least:
        h = GEAR[np.frombuffer(data, np.uint8)]
        for k in (1, 2, 4, 8, 16):
            h[k:] = h[k:] + (h[:-k] << np.uint64(k))
        for c in (np.flatnonzero(h >> np.uint64(64 - bits) == 0) + 1).tolist():
            while c - start > most:
                start += most
                ends.append(start)
            if c - start >= least:
                ends.append(start := c)
    while n - start > most:
        start += most
        ends.append(start)
    return ends + [n] * (start < n)


def _recipes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in sliced(batches):
        out: list[list] = [[] for _ in _PASS]
        for uid, doc_id, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            data = text.encode().translate(None, _SPACES)
            ends = cuts(data)
            parts = [data[a:b] for a, b in zip([0, *ends], ends, strict=False)]
            sums = np.frombuffer(b"".join(hashlib.sha256(p).digest()[:16] for p in parts), "<i8").reshape(-1, 2)
            keys = np.fromiter((xxhash.xxh64_intdigest(p) for p in parts), np.uint64, len(parts)).view(np.int64)
            for column, value in zip(out, (uid, doc_id, len(text), len(data), hashlib.sha256(data).hexdigest(), keys, list(map(len, parts)), sums[:, 0], sums[:, 1]), strict=True):
                column.append(value)
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(out, _PASS, strict=True)], schema=_PASS)


def recipes(base: DataFrame) -> DataFrame:
    """One row per row (uid, doc_id, text): sizes, digest of the normalised text, and its unverified recipe."""
    return base.mapInArrow(_recipes, _DDL)


def chunks(found: DataFrame) -> DataFrame:
    """One row per chunk of each recipe."""
    return found.select("uid", F.posexplode(F.arrays_zip("keys", "lengths", "check1", "check2")).alias("pos", "c")).select("uid", "pos", F.col("c.keys").alias("key"), F.col("c.lengths").alias("length"), F.col("c.check1").alias("check1"), F.col("c.check2").alias("check2"))


def dictionary(found: DataFrame) -> DataFrame:
    """One row per chunk identifier: occurrences, and whether it stands for one content."""
    names = ("length", "check1", "check2")
    held = chunks(found).groupBy("key").agg(F.count("*").alias("uses"), *(f(c).alias(f"{p}_{c}") for c in names for f, p in ((F.min, "min"), (F.max, "max"))))
    one = F.lit(True)
    for c in names:
        one &= F.col(f"min_{c}") == F.col(f"max_{c}")
    return held.select("key", "uses", F.col("min_length").alias("length"), one.alias("verified"))


def verified(found: DataFrame) -> DataFrame:
    """Recipes with ``variants``: empty, or numbers that tell apart contents with one identifier."""
    doubtful = dictionary(found).where(~F.col("verified")).select("key")
    if doubtful.isEmpty():
        return found.withColumn("variants", F.array().cast("array<int>"))
    from pyspark.sql import Window

    contents = chunks(found).join(doubtful, "key", "left_semi").select("key", "length", "check1", "check2").distinct()
    numbered = contents.withColumn("variant", F.row_number().over(Window.partitionBy("key").orderBy("length", "check1", "check2")))
    told = chunks(found).join(numbered, ["key", "length", "check1", "check2"]).groupBy("uid").agg(F.sort_array(F.collect_list(F.struct("pos", "variant"))).alias("v"))
    told = told.select("uid", F.flatten(F.transform("v", lambda x: F.array(x.pos.cast("int"), x.variant))).alias("variants"))
    return found.join(told, "uid", "left").withColumn("variants", F.coalesce("variants", F.array().cast("array<int>")))


def exact_groups(base: DataFrame) -> DataFrame:
    """One row per row (uid, doc_id, text): uid, doc_id, keep_id, group_size, kept, text_sha256, n_chunks."""
    found = verified(written(recipes(base), "recipes")).withColumn("code", F.xxhash64("keys", "n_bytes"))
    same = ["code", "n_bytes", "keys", "variants"]
    groups = found.groupBy(*same).agg(F.count("*").alias("group_size"), F.min(F.struct((-F.col("n_chars")).alias("less"), "doc_id", "uid")).alias("best"))
    return found.join(groups, same).select("uid", "doc_id", F.col("best.doc_id").alias("keep_id"), "group_size", (F.col("uid") == F.col("best.uid")).alias("kept"), "text_sha256", F.size("keys").cast("long").alias("n_chunks"))


def exact_dedup(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256, n_chunks.

    Of texts with equal recipes the row with the most code points, then the smallest doc_id stays.
    The recipes are written with their row numbers, and nothing else reads the texts.
    """
    return exact_groups(docs.select(F.monotonically_increasing_id().alias("uid"), F.col("doc_id").cast("long"), whole_text())).drop("uid")


def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(read(spark, sf_dir, "documents")).drop("n_chunks")


ORACLE = r"""
with n as (select doc_id, length(coalesce(text, '')) as n_chars, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') as x from documents),
k as (select doc_id, x, first_value(doc_id) over (partition by x order by n_chars desc, doc_id) as keep_id, count(*) over (partition by x) as group_size from n)
select doc_id, keep_id, group_size, doc_id = keep_id as kept, sha256(x) as text_sha256 from k
"""
